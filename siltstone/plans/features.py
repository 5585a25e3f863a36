"""Queries of feature checks: what is wrong with the columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import features, linear
from siltstone.plans import query
from siltstone.sources.tables import table


def _found(spark, report):
    return spark.createDataFrame(report.rows(), "column string, kind string, severity string, other string")


@query(
    "feature_check",
    """WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS line_id, CAST(l_quantity AS DOUBLE) AS a, CAST(l_quantity AS DOUBLE) * 2 + 1 AS b, l_returnflag AS f FROM lineitem)
       SELECT 'line_id' AS "column", 'id_like' AS kind, 'high' AS severity, CAST(NULL AS VARCHAR) AS other FROM t HAVING count(DISTINCT line_id) > 0.98 * count(*)
       UNION ALL SELECT 'line_id', 'suspicious_name', 'low', NULL
       UNION ALL SELECT 'double_quantity', 'highly_correlated_with', 'medium', 'l_quantity' FROM t HAVING abs(corr(a, b)) > 0.95
       UNION ALL SELECT 'again', 'duplicate_of', 'high', 'l_tax' FROM lineitem HAVING count(*) FILTER (l_tax IS NULL) = 0
       UNION ALL SELECT 'fixed', 'constant', 'high', NULL
       UNION ALL SELECT 'flag', 'highly_correlated_with', 'medium', 'l_returnflag'
       UNION ALL SELECT 'gaps', 'high_missing', 'medium', NULL FROM lineitem HAVING avg(CAST(l_orderkey % 10 < 7 AS DOUBLE)) > 0.6
       UNION ALL SELECT 'day', 'date_as_string', 'low', NULL""",
)
def _check(spark, sf_dir):
    """Faults planted beside sound columns of lineitem; without a target, so leaks and importance are not asked."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), "l_quantity", (F.col("l_quantity") * 2 + 1).alias("double_quantity"), "l_tax", F.col("l_tax").alias("again"),
        F.lit("x").alias("fixed"), "l_returnflag", F.concat(F.lit("flag "), "l_returnflag").alias("flag"), F.when(F.col("l_orderkey") % 10 >= 7, F.col("l_discount")).alias("gaps"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
    )
    return _found(spark, features.check(rows))


@query(
    "feature_leaks",
    """SELECT 'answer' AS "column", 'leakage_suspect' AS kind, 'high' AS severity, CAST(NULL AS VARCHAR) AS other
       UNION ALL SELECT 'code', 'leakage_suspect', 'high', NULL""",
)
def _leaks(spark, sf_dir):
    """Two columns that know an order's status beside three that do not."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderstatus", "o_totalprice", "o_orderpriority", (F.ascii("o_orderstatus") + F.col("o_custkey") % 5 / 10).alias("answer"), F.concat(F.lit("s-"), "o_orderstatus", (F.col("o_orderkey") % 3).cast("string")).alias("code"),
    )
    found = [r for r in features.check(rows, "o_orderstatus").rows() if r[1] == "leakage_suspect"]
    return spark.createDataFrame(found, "column string, kind string, severity string, other string")


@query(
    "correlation_matrix",
    """WITH v AS (SELECT CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS p, CASE WHEN l_orderkey % 3 > 0 THEN CAST(l_discount AS DOUBLE) END AS d FROM lineitem)
       SELECT 'q' AS a, 'p' AS b, round(corr(q, p), 6) AS r, count(*) AS n FROM v WHERE q IS NOT NULL AND p IS NOT NULL
       UNION ALL SELECT 'q', 'd', round(corr(q, d), 6), count(*) FROM v WHERE q IS NOT NULL AND d IS NOT NULL
       UNION ALL SELECT 'p', 'd', round(corr(p, d), 6), count(*) FROM v WHERE p IS NOT NULL AND d IS NOT NULL""",
)
def _matrix(spark, sf_dir):
    """Correlations over the rows that each pair shares, from one set of sums of products."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", F.when(F.col("l_orderkey") % 3 > 0, F.col("l_discount")).alias("d"))
    sums = linear.gram(rows, [F.col(c) for c in rows.columns])
    r, names = sums.correlations(), "qpd"
    cells = [(names[i], names[j], round(float(r[i, j]), 6), int(sums.n[i, j])) for i in range(3) for j in range(i + 1, 3)]
    return spark.createDataFrame(cells, "a string, b string, r double, n long")
