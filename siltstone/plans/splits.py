"""Queries over splits: sizes, classes and leaks of stratified, grouped and chronological parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import splits
from siltstone.plans import query
from siltstone.sources.tables import table


def _parts_sql(source: str, unit: str, label: str, first: str = "0") -> str:
    """SQL of the parts (t: rows with their unit, label and part) of a split by test 0.2 and val 0.1, seed 0."""
    return f"""
  rows0 AS (SELECT *, 'g:' || {unit} AS unit, {label} AS label FROM {source}),
  n AS (SELECT count(*) AS n, CAST(floor(0.2 * count(*) + 0.5) AS BIGINT) AS n_test, CAST(floor(0.1 * count(*) + 0.5) AS BIGINT) AS n_val FROM rows0),
  by_label AS (SELECT unit, label, count(*) AS m FROM rows0 GROUP BY 1, 2),
  major AS (SELECT unit, label AS stratum FROM by_label QUALIFY row_number() OVER (PARTITION BY unit ORDER BY m DESC, label) = 1),
  units AS (SELECT unit, stratum, count(*) AS size, min({first}) AS first, md5('0:' || unit) AS k FROM rows0 JOIN major USING (unit) GROUP BY unit, stratum),
  sums AS (SELECT stratum, sum(size) AS rows, md5('0:' || stratum) AS tie FROM units GROUP BY 1),
  t0 AS (SELECT *, (rows * n_test) // n AS base, (rows * n_test) % n AS rest FROM sums, n),
  t1 AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY base >= rows, rest DESC, tie) <= n_test - sum(base) OVER () THEN 1 ELSE 0 END AS test FROM t0),
  v0 AS (SELECT stratum, rows, tie, n, n_test, n_val, test, least((rows * n_val) // n, rows - test) AS vbase, (rows * n_val) % n AS vrest FROM t1),
  v1 AS (SELECT *, vbase + CASE WHEN row_number() OVER (ORDER BY vbase >= rows - test, vrest DESC, tie) <= n_val - sum(vbase) OVER () THEN 1 ELSE 0 END AS val FROM v0),
  placed AS (SELECT unit, stratum, size, 2 * sum(size) OVER (PARTITION BY stratum ORDER BY first, k) - size AS twice FROM units),
  cut AS (SELECT p.*, CASE WHEN twice > 2 * (rows - test) THEN 'test' WHEN twice > 2 * (rows - test - val) THEN 'val' ELSE 'train' END AS part FROM placed p JOIN v1 USING (stratum)),
  big AS (SELECT stratum FROM v1 ORDER BY rows DESC, stratum LIMIT 1),
  got AS (SELECT coalesce(sum(size) FILTER (part = 'test'), 0) AS gt, coalesce(sum(size) FILTER (part = 'val'), 0) AS gv FROM cut WHERE stratum <> (SELECT stratum FROM big)),
  w0 AS (SELECT stratum, rows, n_val, gv, CASE WHEN stratum = (SELECT stratum FROM big) THEN least(greatest(n_test - gt, 0), rows) ELSE test END AS test, val FROM v1, got),
  w AS (SELECT stratum, rows, test, CASE WHEN stratum = (SELECT stratum FROM big) THEN least(greatest(n_val - gv, 0), rows - test) ELSE val END AS val FROM w0),
  dealt AS (SELECT unit, CASE WHEN twice > 2 * (rows - test) THEN 'test' WHEN twice > 2 * (rows - test - val) THEN 'val' ELSE 'train' END AS part FROM placed JOIN w USING (stratum)),
  t AS (SELECT * FROM rows0 JOIN dealt USING (unit))"""


@query(
    "split_stratified_groups",
    f"WITH {_parts_sql('orders', 'o_custkey', 'o_orderpriority')} SELECT part, label, count(*) AS n, count(DISTINCT unit) AS units FROM t GROUP BY 1, 2",
)
def _groups(spark, sf_dir):
    """Whole customers, by their commonest priority."""
    made = splits.split(table(spark, sf_dir, "orders"), target="o_orderpriority", group="o_custkey")
    return made.rows.groupBy(F.col("split").alias("part"), F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("units"))


@query(
    "split_stratified_rows",
    f"""WITH {_parts_sql('lineitem', "l_orderkey || chr(31) || l_linenumber", "l_returnflag || l_linestatus")}
    SELECT part, label, count(*) AS n, sum(l_orderkey) AS orders, min(l_linenumber) AS low FROM t GROUP BY 1, 2""",
)
def _rows(spark, sf_dir):
    """Lines one by one, by flag and status: sizes are exact in every class."""
    rows = table(spark, sf_dir, "lineitem").withColumn("label", F.concat("l_returnflag", "l_linestatus"))
    made = splits.split(rows, target="label", group=["l_orderkey", "l_linenumber"]).rows
    return made.groupBy(F.col("split").alias("part"), "label").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("orders"), F.min("l_linenumber").alias("low"))


@query(
    "split_chronological",
    f"WITH {_parts_sql('orders', 'o_custkey', chr(39) * 2, 'o_orderdate')}, f AS (SELECT *, min(o_orderdate) OVER (PARTITION BY unit) AS first FROM t) "
    "SELECT part, count(*) AS n, count(DISTINCT unit) AS units, min(first) AS earliest, max(first) AS latest FROM f GROUP BY 1",
)
def _time(spark, sf_dir):
    """Whole customers by their first order, the latest to test."""
    made = splits.split(table(spark, sf_dir, "orders"), time="o_orderdate", group="o_custkey").rows
    firsts = made.groupBy("o_custkey", "split").agg(F.min("o_orderdate").alias("first"), F.count(F.lit(1)).alias("m"))
    return firsts.groupBy(F.col("split").alias("part")).agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("units"), F.min("first").alias("earliest"), F.max("first").alias("latest"))


@query(
    "split_balance",
    f"""WITH {_parts_sql('orders', 'o_custkey', 'o_orderpriority')}, p AS (SELECT part, count(*) AS m FROM t GROUP BY 1), l AS (SELECT label, count(*) AS m FROM t GROUP BY 1),
    c AS (SELECT part, label, count(*) AS n FROM t GROUP BY 1, 2)
    SELECT label, part, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / p.m, 6) AS share, round(l.m / (SELECT n FROM n), 6) AS overall FROM l CROSS JOIN p LEFT JOIN c USING (part, label)""",
)
def _balance(spark, sf_dir):
    """Shares of each priority in each part and overall."""
    made = splits.split(table(spark, sf_dir, "orders"), target="o_orderpriority", group="o_custkey")
    return made.balance().select("label", "part", "n", F.round("share", 6).alias("share"), F.round("overall", 6).alias("overall"))


@query("split_leaks", "SELECT count(*) AS rows, true AS ok, CAST(0 AS BIGINT) AS leaked_rows, CAST(0 AS BIGINT) AS overlapping_groups, count(DISTINCT o_custkey) AS groups FROM orders")
def _leaks(spark, sf_dir):
    """The report of a split, as one row."""
    r = splits.split(table(spark, sf_dir, "orders"), target="o_orderpriority", group="o_custkey").report()
    return spark.createDataFrame([(r["rows"], r["ok"], r["leaked_rows"], r["overlapping_groups"], r["groups"])], "rows long, ok boolean, leaked_rows long, overlapping_groups long, groups long")
