"""Queries over column profiles, health findings and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import drift, health
from siltstone.operators.profile import profile_columns
from siltstone.plans import query
from siltstone.sources.tables import table

EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value", "props"]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _profile_sql(name: str, columns: list[str]) -> str:
    cells = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {name}" for c in columns)
    return f"""
      WITH cells AS ({cells}), per_value AS (SELECT col, v, count(*) AS n FROM cells GROUP BY col, v)
      SELECT col AS "column", CAST(sum(n) AS BIGINT) AS n_rows,
             CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS n_missing,
             count(v) AS n_unique, CAST(coalesce(max(n) FILTER (v IS NOT NULL), 0) AS BIGINT) AS top_count
      FROM per_value GROUP BY col"""


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


@query("profile_columns", _profile_sql("events", EVENT_COLUMNS))
def _profile_events(spark, sf_dir):
    return profile_columns(table(spark, sf_dir, "events"), EVENT_COLUMNS)


@query("profile_documents", _profile_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]))
def _profile_documents(spark, sf_dir):
    return profile_columns(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang", "source", "n_chars"])


@query(
    "health_missing",
    """SELECT 'quality' AS "column", round(avg(CAST(quality IS NULL AS DOUBLE)), 6) AS share, 'warning' AS severity
       FROM (SELECT CASE WHEN doc_id % 10 < 3 THEN NULL ELSE quality END AS quality FROM labels)""",
)
def _missing(spark, sf_dir):
    holes = table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 10 >= 3, F.col("quality")).alias("quality"))
    return _rounded(health.missing_findings(holes))


@query(
    "health_duplicates",
    """WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity, l_discount)
       SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates, round(sum(n - 1) / sum(n), 6) AS share FROM g""",
)
def _duplicates(spark, sf_dir):
    return _rounded(health.duplicate_rows(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"]))


@query(
    "health_cardinality",
    """WITH c AS (SELECT 'c_custkey' AS "column", count(DISTINCT c_custkey) AS n_unique, count(*) AS n FROM customer
                  UNION ALL SELECT 'c_name', count(DISTINCT c_name), count(*) FROM customer)
       SELECT "column", 'id_like' AS kind, n_unique, round(n_unique / n, 6) AS unique_ratio FROM c WHERE n_unique / n > 0.98""",
)
def _cardinality(spark, sf_dir):
    return _rounded(health.cardinality_findings(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")))


_IQR = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", q1, q3, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers,
        round(count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count({c}), 6) AS share
        FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem) GROUP BY q1, q3"""
    for c in LINE_NUMBERS
)


@query("iqr_outliers", f'SELECT "column", round(q1, 6) AS q1, round(q3, 6) AS q3, n_outliers, share FROM ({_IQR})')
def _iqr(spark, sf_dir):
    return _rounded(health.iqr_outliers(table(spark, sf_dir, "lineitem"), LINE_NUMBERS))


@query("skew", " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(skewness({c}), 6) AS skew FROM lineitem""" for c in LINE_NUMBERS))
def _skew(spark, sf_dir):
    return _rounded(health.skewness(table(spark, sf_dir, "lineitem"), LINE_NUMBERS))


_PAIRS = [(a, b) for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[i + 1 :]]


@query("corr_pairs", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM lineitem" for a, b in _PAIRS))
def _corr(spark, sf_dir):
    return _rounded(health.correlations(table(spark, sf_dir, "lineitem"), LINE_NUMBERS))


@query(
    "cramers_v",
    """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2),
       t AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM c),
       s AS (SELECT sum(n) * (sum(n * n / (na * nb)) - 1) AS chi2, CAST(sum(n) AS DOUBLE) AS o, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM t)
       SELECT round(chi2, 4) AS chi2, round(sqrt(greatest(0, chi2 / o - (ka - 1) * (kb - 1) / (o - 1))
              / (least(ka - (ka - 1) * (ka - 1) / (o - 1), kb - (kb - 1) * (kb - 1) / (o - 1)) - 1)), 6) AS v FROM s""",
)
def _cramer(spark, sf_dir):
    out = health.cramers_v(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")
    return out.select(F.round("chi2", 4).alias("chi2"), F.round("v", 6).alias("v"))


@query(
    "mapping_purity",
    """WITH c AS (SELECT p_brand AS f, p_size AS t, count(*) AS n FROM part GROUP BY 1, 2),
       b AS (SELECT max(n) AS best, sum(n) AS n FROM c GROUP BY f), k AS (SELECT sum(n) AS n FROM c GROUP BY t)
       SELECT round((SELECT sum(best) / sum(n) FROM b), 6) AS purity, round((SELECT max(n) / sum(n) FROM k), 6) AS baseline""",
)
def _purity(spark, sf_dir):
    return _rounded(health.mapping_purity(table(spark, sf_dir, "part"), "p_brand", "p_size"))


@query(
    "correlation_ratio",
    """WITH g AS (SELECT count(*) AS n, sum(o_totalprice) AS s, sum(o_totalprice * o_totalprice) AS q FROM orders GROUP BY o_orderpriority)
       SELECT round(sqrt(greatest(0, (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)))), 6) AS eta FROM g""",
)
def _eta(spark, sf_dir):
    return _rounded(health.correlation_ratio(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"))


@query(
    "class_balance",
    """WITH c AS (SELECT count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY toxic)
       SELECT count(*) AS n_classes, round(min(n) / sum(n), 6) AS minority,
       CASE WHEN count(*) = 1 OR min(n) / sum(n) < 0.01 THEN 'critical' WHEN min(n) / sum(n) < 0.1 THEN 'warning' ELSE 'ok' END AS severity FROM c""",
)
def _balance(spark, sf_dir):
    return _rounded(health.class_balance(table(spark, sf_dir, "labels"), "toxic"))


@query(
    "target_stump",
    """WITH d AS (SELECT n_chars AS v, toxic AS t FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL AND n_chars IS NOT NULL),
       c AS (SELECT v, sum(t) AS p, sum(1 - t) AS q FROM d GROUP BY v),
       r AS (SELECT sum(p) OVER (ORDER BY v) / sum(p) OVER () AS tp, sum(q) OVER (ORDER BY v) / sum(q) OVER () AS fp FROM c)
       SELECT round(max(greatest(0.5 + (tp - fp) / 2, 0.5 - (tp - fp) / 2)), 6) AS balanced_accuracy FROM r""",
)
def _stump(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return _rounded(health.best_stump(both, "n_chars", "toxic"))


@query("health_findings")
def _findings(spark, sf_dir):
    return _rounded(health.findings(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", *LINE_NUMBERS, "l_returnflag", "l_linestatus"]))


@query("health_score")
def _score(spark, sf_dir):
    return health.health_score(health.findings(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]))


@query(
    "column_kinds",
    """WITH d AS (SELECT 'k' AS "column", trim(json_extract_string(props, '$.k')) AS v FROM events UNION ALL SELECT 't', trim(event_type) FROM events)
       SELECT "column", round(avg(CAST(try_cast(v AS DOUBLE) IS NOT NULL AS DOUBLE)), 6) AS number_share, 0.0 AS date_share, count(*) AS n
       FROM d WHERE v IS NOT NULL AND v <> '' GROUP BY 1""",
)
def _kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("t"))
    return _rounded(health.column_kinds(rows, ["k", "t"]))


_SPLIT = "(SELECT *, ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) AS early FROM events)"


def halves(spark, sf_dir):
    """Events before and after the middle of their time span."""
    e = table(spark, sf_dir, "events")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    middle = F.lit(lo + (hi - lo) / 2).cast("timestamp_ntz")
    return e.where(F.col("ts") < middle), e.where(F.col("ts") >= middle)


_PSI_TAIL = """, s AS (SELECT b, count(*) FILTER (early) AS r, count(*) FILTER (NOT early) AS c FROM binned GROUP BY b),
 x AS (SELECT greatest(r / sum(r) OVER (), 1e-4) AS r, greatest(c / sum(c) OVER (), 1e-4) AS c FROM s)
 SELECT round(sum((c - r) * ln(c / r)), 6) AS psi FROM x"""


@query(
    "psi_numeric",
    f"""WITH e AS {_SPLIT}, q AS (SELECT list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS k FROM e WHERE early),
    binned AS (SELECT early, CASE WHEN value IS NULL THEN -1 ELSE len(list_filter(k, lambda x: x < value)) END AS b FROM e, q)""" + _PSI_TAIL,
)
def _psi_n(spark, sf_dir):
    return _rounded(drift.psi_numeric(*halves(spark, sf_dir), "value"))


@query("psi_categorical", f"WITH binned AS (SELECT early, event_type AS b FROM {_SPLIT})" + _PSI_TAIL)
def _psi_c(spark, sf_dir):
    return _rounded(drift.psi_categorical(*halves(spark, sf_dir), "event_type"))


@query(
    "psi_smoothed",
    f"""WITH s AS (SELECT event_type, count(*) FILTER (early) AS r, count(*) FILTER (NOT early) AS c FROM {_SPLIT} GROUP BY 1),
    x AS (SELECT (r + 0.5) / (sum(r) OVER () + 0.5 * count(*) OVER ()) AS r, (c + 0.5) / (sum(c) OVER () + 0.5 * count(*) OVER ()) AS c FROM s)
    SELECT round(sum((c - r) * ln(c / r)), 6) AS psi FROM x""",
)
def _psi_s(spark, sf_dir):
    return _rounded(drift.smoothed_psi(*halves(spark, sf_dir), "event_type"))


@query(
    "ks_stat",
    f"""WITH c AS (SELECT value, count(*) FILTER (early) AS r, count(*) FILTER (NOT early) AS c FROM {_SPLIT} WHERE value IS NOT NULL GROUP BY 1),
    w AS (SELECT abs(sum(r) OVER (ORDER BY value) / sum(r) OVER () - sum(c) OVER (ORDER BY value) / sum(c) OVER ()) AS gap, sum(r) OVER () AS nr, sum(c) OVER () AS nc FROM c)
    SELECT round(max(gap), 6) AS ks, CAST(max(nr) AS BIGINT) AS n_r, CAST(max(nc) AS BIGINT) AS n_c FROM w""",
)
def _ks(spark, sf_dir):
    return _rounded(drift.ks_statistic(*halves(spark, sf_dir), "value"))


@query(
    "chi2_stat",
    f"""WITH s AS (SELECT event_type, count(*) FILTER (early) AS r, count(*) FILTER (NOT early) AS c FROM {_SPLIT} GROUP BY 1),
    t AS (SELECT r, c, (r + c) * sum(r) OVER () / sum(r + c) OVER () AS er, (r + c) * sum(c) OVER () / sum(r + c) OVER () AS ec FROM s)
    SELECT round(sum((r - er) * (r - er) / er + (c - ec) * (c - ec) / ec), 6) AS chi2, count(*) - 1 AS df FROM t""",
)
def _chi2(spark, sf_dir):
    return _rounded(drift.chi2_statistic(*halves(spark, sf_dir), "event_type"))


@query("drift_report")
def _drift(spark, sf_dir):
    return _rounded(drift.detect(*halves(spark, sf_dir), ["value", "event_type", "user_id"]))
