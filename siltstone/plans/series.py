"""Queries over event series: anomalies, energy, production, machines, monitors."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import anomaly, industry, joint, monitors, slopes
from siltstone.plans import ORACLES, query
from siltstone.plans.profiling import _rounded, halves
from siltstone.sources.tables import table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query(
    "ts_zscore",
    """WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS m, stddev_pop(value) AS sd FROM events GROUP BY 1),
       d AS (SELECT event_type, 1.4826 * quantile_cont(abs(value - m), 0.5) AS mad FROM events JOIN m USING (event_type) GROUP BY 1)
       SELECT event_id, round(m, 6) AS expected, round(abs(value - m) / CASE WHEN mad > 0 THEN mad ELSE sd END, 6) AS score
       FROM events JOIN m USING (event_type) JOIN d USING (event_type) WHERE abs(value - m) / CASE WHEN mad > 0 THEN mad ELSE sd END > 3""",
)
def _z(spark, sf_dir):
    return _rounded(anomaly.zscore(_events(spark, sf_dir), ["event_type"], "value").where("anomaly").select("event_id", "expected", "score"))


@query(
    "ts_iqr",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
       SELECT event_id, round(abs(value - m) / ((b - a) * (1 / 1.349)), 6) AS score FROM events JOIN q USING (event_type) WHERE abs(value - m) / ((b - a) * (1 / 1.349)) > 3""",
)
def _i(spark, sf_dir):
    return _rounded(anomaly.iqr(_events(spark, sf_dir), ["event_type"], "value").where("anomaly").select("event_id", "score"))


@query(
    "ts_rolling",
    """WITH w AS (SELECT event_id, event_type, value, quantile_cont(value, 0.5) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a,
         quantile_cont(value, 0.5) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS b FROM events),
       r AS (SELECT *, coalesce((a + b) / 2, a, b) AS e, value - coalesce((a + b) / 2, a, b) AS r FROM w),
       m AS (SELECT event_type, quantile_cont(r, 0.5) AS m FROM r GROUP BY 1),
       s AS (SELECT event_type, 1.4826 * quantile_cont(abs(r - m), 0.5) AS s FROM r JOIN m USING (event_type) GROUP BY 1)
       SELECT event_id, round(e, 6) AS expected, round(abs(value - e) / s, 6) AS score FROM r JOIN s USING (event_type) WHERE abs(value - e) / s > 3""",
)
def _r(spark, sf_dir):
    out = anomaly.rolling(_events(spark, sf_dir), ["event_type"], ["ts", "event_id"], "value")
    return _rounded(out.where("anomaly").select("event_id", "expected", "score"))


@query(
    "ts_ewma",
    """WITH o AS (SELECT event_type, event_id, value, row_number() OVER w AS i, quantile_cont(value, 0.5) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS g FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
       m AS (SELECT b.event_type, b.event_id, b.value, sum(a.g * CASE WHEN a.i = 1 THEN pow(0.7, b.i - 2) ELSE 0.3 * pow(0.7, b.i - 1 - a.i) END) AS expected
             FROM o b JOIN o a ON a.event_type = b.event_type AND a.i BETWEEN b.i - 100 AND b.i - 1 GROUP BY ALL),
       s AS (SELECT event_type, 1.4826 * quantile_cont(abs(value - expected), 0.5) AS s FROM m GROUP BY 1)
       SELECT event_id, round(expected, 6) AS expected, round(abs(value - expected) / s, 6) AS score FROM m JOIN s USING (event_type) WHERE abs(value - expected) / s > 3""",
)
def _ewma(spark, sf_dir):
    out = anomaly.ewma(_events(spark, sf_dir).select("event_id", "event_type", "ts", "value"), ["event_type"], ["ts", "event_id"], "value")
    return _rounded(out.where("anomaly").select("event_id", "expected", "score"))


@query(
    "ts_seasonal",
    """WITH m AS (SELECT hour(ts) AS h, quantile_cont(value, 0.5) AS m FROM events GROUP BY 1),
       r AS (SELECT event_id, value, m, abs(value - m) AS r FROM events JOIN m ON hour(ts) = h), s AS (SELECT 1.4826 * quantile_cont(r, 0.5) AS s FROM r)
       SELECT event_id, round(m, 6) AS expected, round(r / s, 6) AS score FROM r, s WHERE r / s > 3""",
)
def _seasonal(spark, sf_dir):
    out = anomaly.seasonal(_events(spark, sf_dir), [F.hour("ts")], "value")
    return _rounded(out.where("anomaly").select("event_id", "expected", "score"))


_VOTES = " UNION ALL ".join(f"SELECT event_id FROM ({ORACLES[n]})" for n in ("ts_zscore", "ts_iqr", "ts_rolling"))


@query("ts_vote", f"SELECT event_id, CAST(count(*) AS INTEGER) AS votes, true AS anomaly FROM ({_VOTES}) GROUP BY 1 HAVING count(*) * 2 > 3")
def _vote(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "event_type", "ts", "value")
    frames = [anomaly.zscore(e, ["event_type"], "value"), anomaly.iqr(e, ["event_type"], "value"), anomaly.rolling(e, ["event_type"], ["ts", "event_id"], "value")]
    return anomaly.vote(frames, ["event_id"]).where("anomaly")


@query(
    "longest_run",
    """WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g, event_type FROM events),
       l AS (SELECT user_id, count(*) AS n FROM r GROUP BY user_id, event_type, g) SELECT user_id, max(n) AS longest FROM l GROUP BY 1""",
)
def _runs(spark, sf_dir):
    return anomaly.longest_run(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type")


@query(
    "step_change",
    """WITH w AS (SELECT event_id, event_type, value, quantile_cont(value, 0.5) OVER a AS a, quantile_cont(value, 0.5) OVER b AS b, count(value) OVER a AS n, abs(value - lag(value) OVER o) AS d FROM events
         WINDOW o AS (PARTITION BY event_type ORDER BY ts, event_id), a AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
         b AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
       s AS (SELECT event_type, 1.4826 * quantile_cont(d, 0.5) / sqrt(2) AS s FROM w GROUP BY 1)
       SELECT event_id, round(b - a, 6) AS jump FROM w JOIN s USING (event_type) WHERE n = 10 AND s > 0 AND abs(b - a) >= 2 * s""",
)
def _steps(spark, sf_dir):
    return _rounded(anomaly.steps(_events(spark, sf_dir), ["event_type"], ["ts", "event_id"], "value", sensitivity=2.0).select("event_id", "jump"))


@query(
    "trend_lines",
    """SELECT event_type, round(regr_slope(value, event_id), 9) AS slope, round(regr_intercept(value, event_id), 6) AS intercept, round(regr_r2(value, event_id), 6) AS r2 FROM events GROUP BY 1""",
)
def _trend(spark, sf_dir):
    t = anomaly.trend(_events(spark, sf_dir), ["event_type"], "event_id", "value")
    return t.select("event_type", F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("dominant_period")
def _period(spark, sf_dir):
    return anomaly.dominant_period(_events(spark, sf_dir).select("event_type", "ts", "event_id", "value"), ["event_type"], ["ts", "event_id"], "value")


@query(
    "theil_sen",
    """WITH d AS (SELECT event_type, epoch_us(ts) // 86400000000 AS day, avg(value) AS v FROM events GROUP BY 1, 2), n AS (SELECT event_type, count(*) AS n FROM d GROUP BY 1),
       p AS (SELECT a.event_type, (b.v - a.v) / (b.day - a.day) AS s, sign(b.v - a.v) AS g FROM d a JOIN d b ON a.event_type = b.event_type AND a.day < b.day),
       m AS (SELECT event_type, quantile_cont(s, 0.5) AS slope, avg(g) AS tau FROM p GROUP BY 1)
       SELECT event_type, n, round(slope, 6) AS slope, round(tau, 6) AS tau FROM m JOIN n USING (event_type)""",
)
def _theil_sen(spark, sf_dir):
    """Trend of each event type's daily mean."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    daily = _events(spark, sf_dir).groupBy("event_type", day.alias("day")).agg(F.avg("value").alias("v"))
    return slopes.theil_sen(daily, ["event_type"], "day", "v").select("event_type", "n", F.round("slope", 6).alias("slope"), F.round("tau", 6).alias("tau"))


#: A second channel that follows the quantity, but in one line of some orders strays while it stays in range.
_LOAD = "l_quantity * 100 + l_discount * 500 + CASE WHEN l_orderkey % 97 = 0 AND l_linenumber = 1 THEN CASE WHEN l_quantity <= 25 THEN 1500 ELSE -1500 END ELSE 0 END"


@query(
    "joint_outliers",
    f"""WITH v AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS a, CAST({_LOAD} AS DOUBLE) AS b FROM lineitem),
       m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, corr(a, b) AS r FROM v),
       z AS (SELECT l_orderkey, l_linenumber, (a - ma) / sa AS x, (b - mb) / sb AS y, r FROM v, m)
       SELECT l_orderkey, l_linenumber FROM z WHERE greatest(abs(x - r * y), abs(y - r * x)) / sqrt(1 - r * r) > 6""",
)
def _joint(spark, sf_dir):
    """Lines whose two channels disagree; clean ones stay far below any cut, planted ones lie far above."""
    rows = table(spark, sf_dir, "lineitem").withColumn("load", F.expr(_LOAD)).select("l_orderkey", "l_linenumber", "l_quantity", "load")
    return joint.detect(rows, ["l_quantity", "load"]).where("anomaly").select("l_orderkey", "l_linenumber")


@query(
    "joint_fitted_once",
    f"""WITH v AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS a, CAST({_LOAD} AS DOUBLE) AS b, l_linenumber > 1 AS old FROM lineitem),
       m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, corr(a, b) AS r FROM v WHERE old),
       z AS (SELECT (a - ma) / sa AS x, (b - mb) / sb AS y, r FROM v, m WHERE NOT old)
       SELECT count(*) AS lines, count(*) FILTER (greatest(abs(x - r * y), abs(y - r * x)) / sqrt(1 - r * r) > 6) AS strays FROM z""",
)
def _joint_once(spark, sf_dir):
    """First lines held against what the other lines of all orders show."""
    rows = table(spark, sf_dir, "lineitem").withColumn("load", F.expr(_LOAD)).select("l_linenumber", "l_quantity", "load")
    made = joint.fit(rows.where("l_linenumber > 1"), ["l_quantity", "load"])
    return made.apply(rows.where("l_linenumber = 1")).agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("anomaly"), 1)).alias("strays"))


@query(
    "sensor_faults",
    """WITH v AS (SELECT event_type, event_id, ts, CASE WHEN event_id % 50 < 8 THEN 0.0 ELSE value END AS value FROM events),
       r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - row_number() OVER (PARTITION BY event_type, value ORDER BY ts, event_id) AS g FROM v),
       x AS (SELECT event_type, value, count(*) AS length FROM r GROUP BY event_type, value, g HAVING count(*) >= 2)
       SELECT event_type, 'stuck_at_zero' AS fault, length FROM x WHERE value = 0""",
)
def _faults(spark, sf_dir):
    v = _events(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 50 < 8, 0.0).otherwise(F.col("value")))
    out = anomaly.faults(v, ["event_type"], ["ts", "event_id"], "value", 2)
    return out.where("fault = 'stuck_at_zero'").select("event_type", "fault", "length")


_SLOTS = """s AS (SELECT date_trunc('hour', ts) AS slot, sum(value) AS total FROM events GROUP BY 1),
 c AS (SELECT unnest(generate_series((SELECT min(slot) FROM s), (SELECT max(slot) FROM s), INTERVAL 1 HOUR)) AS slot), slots AS (SELECT c.slot, total FROM c LEFT JOIN s USING (slot))"""


def slots(spark, sf_dir):
    """Hourly sums of the events' values."""
    return industry.grid(_events(spark, sf_dir), "ts", "value")


@query("hour_grid", f"WITH {_SLOTS} SELECT strftime(slot, '%Y-%m-%d %H') AS slot, round(total, 4) AS total FROM slots")
def _grid(spark, sf_dir):
    return slots(spark, sf_dir).select(F.date_format("slot", "yyyy-MM-dd HH").alias("slot"), F.round("total", 4).alias("total"))


@query(
    "phase_baseline",
    f"""WITH {_SLOTS} SELECT CAST(dayofweek(slot) + 1 AS INTEGER) AS dow, CAST(hour(slot) AS INTEGER) AS hour, round(quantile_cont(total, 0.5), 4) AS typical, count(*) AS n
        FROM slots WHERE total IS NOT NULL GROUP BY 1, 2""",
)
def _phase(spark, sf_dir):
    return industry.phase_baseline(slots(spark, sf_dir)).select("dow", "hour", F.round("typical", 4).alias("typical"), "n")


@query("energy_baseline")
def _ladder(spark, sf_dir):
    return _rounded(industry.baseline_ladder(slots(spark, sf_dir)))


@query(
    "standby_load",
    f"""WITH {_SLOTS}, n AS (SELECT CAST(slot AS DATE) AS d, min(total) AS low FROM slots WHERE hour(slot) < 5 AND total IS NOT NULL GROUP BY 1)
        SELECT round(least((SELECT quantile_cont(low, 0.5) FROM n), (SELECT quantile_cont(total, 0.5) FROM slots)), 4) AS standby""",
)
def _standby(spark, sf_dir):
    return industry.standby_load(slots(spark, sf_dir)).select(F.round("standby", 4).alias("standby"))


@query(
    "energy_cost",
    f"WITH {_SLOTS} SELECT strftime(slot, '%Y-%m-%d') AS day, round(sum(total * CASE WHEN hour(slot) BETWEEN 7 AND 21 THEN 0.30 ELSE 0.15 END), 4) AS cost FROM slots GROUP BY 1",
)
def _cost(spark, sf_dir):
    priced = industry.cost(slots(spark, sf_dir), {h: 0.30 if 7 <= h <= 21 else 0.15 for h in range(24)})
    return priced.groupBy(F.date_format("slot", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum("cost"), 4).alias("cost"))


@query("energy_forecast")
def _forecast(spark, sf_dir):
    return _rounded(industry.forecast(slots(spark, sf_dir)))


@query(
    "meter_differences",
    """WITH m AS (SELECT user_id, event_id, ts, event_id % 97 AS r FROM events), d AS (SELECT *, r - lag(r) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM m)
       SELECT user_id, CAST(sum(CASE WHEN d < 0 THEN r ELSE d END) AS BIGINT) AS used FROM d GROUP BY 1""",
)
def _meter(spark, sf_dir):
    m = _events(spark, sf_dir).select("user_id", "ts", (F.col("event_id") % 97).alias("r"))
    return industry.meter_differences(m, ["user_id"], "ts", "r").groupBy("user_id").agg(F.sum("used").alias("used"))


_LINES = """h AS (SELECT event_type, date_trunc('hour', ts) AS slot, count(*) FILTER (value > 40) AS units FROM events GROUP BY 1, 2)"""


def _lines(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("slot")).agg(
        F.count(F.when(F.col("value") > 40, 1)).alias("units")
    )


@query(
    "downtime_runs",
    f"""WITH {_LINES}, q AS (SELECT event_type, quantile_cont(units, 0.9) AS q FROM h WHERE units > 0 GROUP BY 1), d AS (SELECT h.*, units <= 0.05 * q AS down FROM h JOIN q USING (event_type)),
       r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY slot) - row_number() OVER (PARTITION BY event_type, down ORDER BY slot) AS g FROM d)
       SELECT event_type, strftime(min(slot), '%Y-%m-%d %H') AS first, count(*) AS slots FROM r WHERE down GROUP BY event_type, g""",
)
def _down(spark, sf_dir):
    return industry.downtime(_lines(spark, sf_dir), ["event_type"], "slot", "units").select("event_type", F.date_format("first", "yyyy-MM-dd HH").alias("first"), "slots")


@query(
    "production_oee",
    f"""WITH {_LINES}, q AS (SELECT event_type, quantile_cont(units, 0.9) AS q FROM h WHERE units > 0 GROUP BY 1),
       g AS (SELECT event_type, q, avg(CAST(units > 0.05 * q AS DOUBLE)) AS a, avg(units) FILTER (units > 0.05 * q) AS m FROM h JOIN q USING (event_type) GROUP BY 1, 2)
       SELECT event_type, round(a, 6) AS availability, round(least(1.0, m / q), 6) AS performance, round(a * least(1.0, m / q), 6) AS oee_partial FROM g""",
)
def _oee(spark, sf_dir):
    return _rounded(industry.production(_lines(spark, sf_dir), ["event_type"], "units"))


@query(
    "shift_units",
    f"""WITH {_LINES} SELECT strftime(CASE WHEN hour(slot) < 6 THEN slot - INTERVAL 1 DAY ELSE slot END, '%Y-%m-%d') AS day,
        CASE WHEN hour(slot) >= 22 OR hour(slot) < 6 THEN 'night' WHEN hour(slot) >= 14 THEN 'late' ELSE 'early' END AS shift, CAST(sum(units) AS BIGINT) AS units FROM h GROUP BY 1, 2""",
)
def _shift(spark, sf_dir):
    out = industry.by_shift(_lines(spark, sf_dir), "slot", "units", {"early": 6, "late": 14, "night": 22})
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "shift", "units")


@query(
    "rule_compliance",
    """WITH s AS (SELECT avg(CAST(value < 1 OR value > 150 AS DOUBLE)) AS h, avg(CAST((value < 5 OR value > 100) AND NOT (value < 1 OR value > 150) AS DOUBLE)) AS w FROM events)
       SELECT 'value' AS channel, round(h, 6) AS hard, round(w, 6) AS soft, round(greatest(100 * (h + 0.4 * w), CASE WHEN h > 0 THEN 25 WHEN w > 0 THEN 10 ELSE 0 END), 6) AS deficit FROM s""",
)
def _rules(spark, sf_dir):
    return _rounded(industry.rule_compliance(_events(spark, sf_dir), {"value": {"min": 1, "max": 150, "warn_min": 5, "warn_max": 100}}))


@query(
    "machine_health",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= ceil(count(*) OVER (PARTITION BY event_type) * 0.2) AS base FROM events),
       b AS (SELECT event_type, quantile_cont(value, 0.5) AS m, stddev_pop(value) AS s FROM r WHERE base GROUP BY 1),
       n AS (SELECT event_type, m, s, stddev_pop(value) AS sd, quantile_cont(value, 0.5) AS med, avg(CAST(abs(value - m) / s > 3.5 AS DOUBLE)) AS far, avg(CAST(value IS NULL AS DOUBLE)) AS gone
             FROM r JOIN b USING (event_type) WHERE NOT base GROUP BY 1, 2, 3),
       p AS (SELECT event_type, greatest(0, least(100, 100 * ln(greatest(sd / s, 1)) / ln(4))) AS stability, greatest(0, least(100, 100 * ln(greatest(abs(med - m) / s, 1)) / ln(1000))) AS level,
             greatest(0, least(100, 100 * coalesce(far, 0) / 0.1)) AS anomaly, greatest(0, least(100, 100 * gone)) AS availability FROM n),
       t AS (SELECT *, 100 - (0.3 * stability + 0.3 * level + 0.2 * anomaly + 0.2 * availability) AS score FROM p)
       SELECT event_type, round(stability, 6) AS stability, round(level, 6) AS level, round(anomaly, 6) AS anomaly, round(availability, 6) AS availability, round(score, 6) AS score,
              CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM t""",
)
def _health(spark, sf_dir):
    return _rounded(industry.machine_health(_events(spark, sf_dir), ["event_type"], "event_id", "value"))


@query(
    "remaining_life",
    """WITH w AS (SELECT event_type, event_id AS x, 100 - event_id / 200 + value / 100 AS score FROM events),
       e AS (SELECT event_type, quantile_cont(x, 0.5) AS mid, max(x) AS last FROM w GROUP BY 1),
       f AS (SELECT event_type, last, regr_slope(score, x) AS slope, regr_intercept(score, x) AS i FROM w JOIN e USING (event_type) WHERE x >= mid GROUP BY 1, 2)
       SELECT event_type, round(slope, 6) AS slope, round(CASE WHEN slope < 0 THEN greatest(0, (30 - i) / slope - last) END, 6) AS remaining FROM f""",
)
def _life(spark, sf_dir):
    worn = _events(spark, sf_dir).withColumn("score", 100 - F.col("event_id") / 200 + F.col("value") / 100)
    return _rounded(industry.remaining_life(worn, ["event_type"], "event_id", "score"))


@query(
    "failure_labels",
    """SELECT event_id, max(CAST(event_type = 'error' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) = 1 AS will_fail FROM events""",
)
def _labels(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("o", F.struct("ts", "event_id")).withColumn("failed", F.col("event_type") == "error")
    return industry.failure_labels(e, ["user_id"], "o", "failed").select("event_id", "will_fail")


@query(
    "window_features",
    """SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(stddev_pop(value) OVER w, 5) AS sd, min(value) OVER w AS low, max(value) OVER w AS high
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
def _features(spark, sf_dir):
    out = industry.window_features(_events(spark, sf_dir), ["user_id"], "event_id", "value")
    return out.select("event_id", F.round("mean", 6).alias("mean"), F.round("sd", 5).alias("sd"), "low", "high")


@query(
    "monitor_null_rate",
    """SELECT 'null_rate:v' AS monitor, CASE WHEN avg(CAST(event_id % 11 = 0 AS DOUBLE)) > 0.05 THEN 'failed' ELSE 'ok' END AS status,
       round(avg(CAST(event_id % 11 = 0 AS DOUBLE)), 6) AS value, 0.05 AS "limit" FROM events""",
)
def _nulls(spark, sf_dir):
    return _rounded(monitors.null_rate(_events(spark, sf_dir).withColumn("v", F.when(F.col("event_id") % 11 != 0, F.col("value"))), "v"))


@query(
    "monitor_latency",
    """SELECT 'latency_p95' AS monitor, CASE WHEN quantile_cont(value, 0.95) > 100 THEN 'failed' ELSE 'ok' END AS status, round(quantile_cont(value, 0.95), 6) AS value, 100.0 AS "limit"
       FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 500)""",
)
def _latency(spark, sf_dir):
    return _rounded(monitors.latency(monitors.last_records(_events(spark, sf_dir), ["ts", "event_id"], 500), "value", 100.0))


@query(
    "monitor_constant",
    """WITH l AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000),
       r AS (SELECT event_type, row_number() OVER (ORDER BY ts, event_id) - row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS g FROM l),
       n AS (SELECT count(*) AS n FROM r GROUP BY event_type, g) SELECT 'constant_output' AS monitor, 'ok' AS status, CAST(max(n) AS DOUBLE) AS value, 50.0 AS "limit" FROM n""",
)
def _constant(spark, sf_dir):
    return monitors.constant_output(monitors.last_records(_events(spark, sf_dir), ["ts", "event_id"]), ["ts", "event_id"], "event_type")


@query("monitors")
def _monitors(spark, sf_dir):
    early, late = halves(spark, sf_dir)
    return _rounded(monitors.run_all(early, late, "event_type", "ts", ["ts", "event_id"], ["event_type"], 10.0, latency_column="value"))
