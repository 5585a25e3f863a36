"""Queries over the star schema with plain Spark operators (extensions), and batch forms of the streaming windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.plans import query
from siltstone.sources.tables import table
from siltstone.streaming import jobs


@query(
    "ext_pricing_summary",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def _pricing(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"),
    )


@query(
    "ext_nation_revenue",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
)
def _nation(spark, sf_dir):
    li, o, c, n = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query(
    "ext_semi_anti",
    """SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS buyers, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS others""",
)
def _semi(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    flags = c.join(o.select("o_custkey").distinct(), c.c_custkey == o.o_custkey, "left")
    return flags.agg(F.count("o_custkey").alias("buyers"), F.count(F.when(F.col("o_custkey").isNull(), 1)).alias("others"))


@query(
    "ext_cube",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) + 2 * grouping(l_linestatus) AS INTEGER) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
)
def _cube(spark, sf_dir):
    level = (F.grouping("l_returnflag") + 2 * F.grouping("l_linestatus")).cast("int")
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), level.alias("level"))


@query(
    "ext_top_orders",
    "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3",
)
def _top(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


@query("ext_set_ops", "SELECT p_brand FROM part WHERE p_size < 10 INTERSECT SELECT p_brand FROM part WHERE p_size > 40")
def _sets(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.where("p_size < 10").select("p_brand").intersect(p.where("p_size > 40").select("p_brand"))


@query(
    "tumbling",
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def _tumbling(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.tumbling(e, "ts", "1 hour", ["event_type"], "value")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "session_windows",
    """WITH d AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
       s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM d)
       SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, g""",
)
def _sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.sessions(e, "ts", ["user_id"], "6 hours")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(
    "asof_orders",
    """SELECT e.event_id, max(o.o_orderdate) IS NOT NULL AS seen FROM events e LEFT JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts GROUP BY 1""",
)
def _asof(spark, sf_dir):
    """As-of match by one sorted union: the last order of a customer before each event, without pairing them."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), F.lit(1).alias("side"), "event_id")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("event_id"))
    w = Window.partitionBy("k").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max(F.when(F.col("side") == 0, F.col("t"))).over(w)
    return e.unionByName(o).withColumn("last", seen).where("side = 1").select("event_id", F.col("last").isNotNull().alias("seen"))
