"""Queries of scores, fills and centred windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import scores
from siltstone.plans import query
from siltstone.sources.tables import table


@query(
    "regression_scores",
    """WITH t AS (SELECT CAST(l_extendedprice AS DOUBLE) AS a, CAST(l_quantity AS DOUBLE) * 1500 AS p FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL)
       SELECT count(*) AS n, round(avg(abs(a - p)), 3) AS mae, round(sqrt(avg((a - p) * (a - p))), 3) AS rmse, round(1 - avg((a - p) * (a - p)) / var_pop(a), 6) AS r2 FROM t""",
)
def _regression(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1500).alias("guess"))
    return scores.regression_scores(t, "l_extendedprice", "guess").select("n", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), F.round("r2", 6).alias("r2"))


@query(
    "class_scores",
    """WITH t AS (SELECT l_returnflag AS a, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity < 25 THEN 'A' ELSE 'X' END AS p FROM lineitem WHERE l_returnflag IS NOT NULL),
       c AS (SELECT a AS class FROM t UNION SELECT p FROM t),
       s AS (SELECT class, (SELECT count(*) FROM t WHERE a = class) AS support, (SELECT count(*) FROM t WHERE p = class) AS told, (SELECT count(*) FROM t WHERE a = class AND p = class) AS hits FROM c)
       SELECT class, support, round(CASE WHEN told > 0 THEN hits / told ELSE 0 END, 9) AS precision, round(CASE WHEN support > 0 THEN hits / support ELSE 0 END, 9) AS recall,
              round(2 * hits / (support + told), 9) AS f1 FROM s""",
)
def _classes(spark, sf_dir):
    guess = F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_quantity") < 25, "A").otherwise("X")
    out = scores.class_scores(table(spark, sf_dir, "lineitem").select("l_returnflag", guess.alias("guess")), "l_returnflag", "guess")
    return out.select("class", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "score_auc",
    """WITH t AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CAST(l_quantity AS DOUBLE) AS s FROM lineitem WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL),
       c AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM t GROUP BY s),
       r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
       SELECT CAST(sum(pos + neg) AS BIGINT) AS n, round(CAST(sum(pos * (below + neg / 2)) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE), 9) AS auc FROM r""",
)
def _auc(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").alias("y"), "l_quantity")
    return scores.binary_curve_area(t, "y", "l_quantity").select("n", F.round("auc", 9).alias("auc"))


@query(
    "series_fills",
    """WITH g AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS x, value FROM events)
       SELECT event_id, round(last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS forward,
              round(first_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS backward,
              round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS centre FROM g""",
)
def _fills(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("x", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    keys, order = ["user_id"], ["ts", "event_id"]
    return e.select(
        "event_id", F.round(scores.filled(e, keys, order, "x"), 6).alias("forward"), F.round(scores.filled(e, keys, order, "x", back=True), 6).alias("backward"),
        F.round(scores.centred_median(keys, order, "value", 5), 6).alias("centre"),
    )


@query(
    "midpoint_parts",
    """WITH t AS (SELECT o_orderkey, o_custkey, (sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) - o_totalprice / 2)
                 / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders)
       SELECT o_orderkey, CASE WHEN m < 0.7 THEN 'train' WHEN m < 0.85 THEN 'valid' ELSE 'test' END AS part FROM t""",
)
def _midpoints(spark, sf_dir):
    out = scores.midpoint_share(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", {"train": 0.7, "valid": 0.85, "test": 2.0})
    return out.select("o_orderkey", "part")
