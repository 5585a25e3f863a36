"""Queries of baselines that are learnt once and held against later rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators.baseline import Detector
from siltstone.plans import query
from siltstone.sources.tables import table

_HALF = "h AS (SELECT event_type, event_id, ts, CAST(value AS DOUBLE) AS v, event_id < (SELECT count(*) / 2 FROM events) AS old FROM events)"


def _halves(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value")
    half = e.count() / 2
    return e.where(F.col("event_id") < half), e.where(F.col("event_id") >= half)


def _scored(out):
    return out.where("anomaly").select("event_id", F.round("expected", 6).alias("expected"), F.round("score", 6).alias("score"))


@query(
    "baseline_zscore",
    f"""WITH {_HALF}, m AS (SELECT event_type, quantile_disc(v, 0.5) AS m FROM h WHERE old GROUP BY 1),
       e AS (SELECT event_type, v - m AS e FROM h JOIN m USING (event_type) WHERE old), c AS (SELECT event_type, quantile_disc(e, 0.5) AS c FROM e GROUP BY 1),
       s AS (SELECT event_type, 1.4826 * quantile_disc(abs(e - c), 0.5) AS s FROM e JOIN c USING (event_type) GROUP BY 1)
       SELECT event_id, round(m, 6) AS expected, round(abs(v - m) / s, 6) AS score FROM h JOIN m USING (event_type) JOIN s USING (event_type) WHERE NOT old AND abs(v - m) / s > 3""",
)
def _zscore(spark, sf_dir):
    """The second half of the events against the median and spread of the first."""
    old, new = _halves(spark, sf_dir)
    return _scored(Detector(["event_type"], "event_id", "value", "zscore").fit(old).score(new))


@query(
    "baseline_iqr",
    f"""WITH {_HALF}, m AS (SELECT event_type, quantile_disc(v, 0.5) AS m, (quantile_disc(v, 0.75) - quantile_disc(v, 0.25)) / 1.349 AS s FROM h WHERE old GROUP BY 1)
       SELECT event_id, round(m, 6) AS expected, round(abs(v - m) / s, 6) AS score FROM h JOIN m USING (event_type) WHERE NOT old AND abs(v - m) / s > 3""",
)
def _iqr(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return _scored(Detector(["event_type"], "event_id", "value", "iqr").fit(old).score(new))


@query(
    "baseline_season",
    f"""WITH {_HALF}, p AS (SELECT *, epoch_us(ts) // 3600000000 % 24 AS phase FROM h), w AS (SELECT event_type, quantile_disc(v, 0.5) AS middle, count(*) AS n FROM p WHERE old GROUP BY 1),
       o AS (SELECT event_type, phase, quantile_disc(v - middle, 0.5) AS o FROM p JOIN w USING (event_type) WHERE old GROUP BY 1, 2), c AS (SELECT event_type, quantile_disc(o, 0.5) AS c FROM o GROUP BY 1),
       f AS (SELECT event_type, phase, o - c AS off FROM o JOIN c USING (event_type)), x AS (SELECT event_type, event_id, ts, v - off AS v FROM p JOIN f USING (event_type, phase) WHERE old),
       l AS (SELECT event_type, quantile_disc(v, 0.5) AS level FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, v DESC) AS r FROM x) WHERE r <= 24 GROUP BY 1),
       b AS (SELECT event_type, quantile_disc(v, 0.5) AS b FROM x GROUP BY 1), e AS (SELECT event_type, v - b AS e FROM x JOIN b USING (event_type)), d AS (SELECT event_type, quantile_disc(e, 0.5) AS d FROM e GROUP BY 1),
       s AS (SELECT event_type, 1.4826 * quantile_disc(abs(e - d), 0.5) AS s FROM e JOIN d USING (event_type) GROUP BY 1),
       t AS (SELECT event_id, level + coalesce(off, 0) AS expected, abs(v - level - coalesce(off, 0)) / s AS score FROM p JOIN l USING (event_type) JOIN s USING (event_type) LEFT JOIN f USING (event_type, phase) WHERE NOT old)
       SELECT event_id, round(expected, 6) AS expected, round(score, 6) AS score FROM t WHERE score > 3""",
)
def _season(spark, sf_dir):
    """The second half against levels by hour of day of the first."""
    old, new = _halves(spark, sf_dir)
    return _scored(Detector(["event_type"], "ts", "value", "seasonal", seasonality=24, step=3600).fit(old).score(new))
