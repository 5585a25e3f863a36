"""Meters, machines and production lines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid(df: DataFrame, time: str, value: str, step: str = "1 hour") -> DataFrame:
    """(slot, total, n): a regular calendar from the first to the last slot; slots without a reading stay empty (null)."""
    sums = df.groupBy(F.window(F.col(time).cast("timestamp"), step)["start"].alias("slot")).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    ends = sums.agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    calendar = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias("slot"))
    return calendar.join(sums, "slot", "left").select("slot", "total", F.coalesce("n", F.lit(0)).alias("n"))


def phase_baseline(slots: DataFrame) -> DataFrame:
    """(dow, hour, typical, n): median of the slots of each hour of the week."""
    return slots.where("total is not null").groupBy(F.dayofweek("slot").alias("dow"), F.hour("slot").alias("hour")).agg(
        F.percentile("total", 0.5).alias("typical"), F.count(F.lit(1)).alias("n")
    )


def baseline_ladder(slots: DataFrame, least: int = 3) -> DataFrame:
    """slots with expected and level: the median of the finest phase all of whose members have ``least`` readings."""
    known = slots.where("total is not null")
    levels = [("dow_hour", [F.dayofweek("slot"), F.hour("slot")]), ("hour", [F.hour("slot")]), ("flat", [])]
    for name, keys in levels:
        named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
        cols = [f"_k{i}" for i in range(len(keys))]
        medians = known.select("total", *named).groupBy(*cols).agg(F.percentile("total", 0.5).alias("expected"), F.count(F.lit(1)).alias("_n"))
        low = medians.agg(F.min("_n")).first()[0]
        if not cols or (low or 0) >= least:
            rows = slots.select("*", *named)
            joined = rows.join(medians, cols, "left") if cols else rows.join(F.broadcast(medians))  # one row
            return joined.select(*slots.columns, "expected", F.lit(name).alias("level"))
    raise AssertionError("the flat level always serves")


def standby_load(slots: DataFrame, night: tuple[int, int] = (0, 5)) -> DataFrame:
    """standby: the median over nights of the least reading of a night, the overall median at most."""
    nights = slots.where((F.hour("slot") >= night[0]) & (F.hour("slot") < night[1]) & F.col("total").isNotNull())
    least = nights.groupBy(F.to_date("slot").alias("d")).agg(F.min("total").alias("low")).agg(F.percentile("low", 0.5).alias("s"))
    middle = slots.agg(F.percentile("total", 0.5).alias("m"))
    return least.join(F.broadcast(middle)).select(F.least("s", "m").alias("standby"))  # one row each


def cost(slots: DataFrame, tariff: float | dict[int, float]) -> DataFrame:
    """slots with cost, by a flat rate or one for each hour of the day."""
    if isinstance(tariff, dict):
        rate = F.create_map(*[F.lit(x) for k, v in tariff.items() for x in (k, float(v))])[F.hour("slot")]
    else:
        rate = F.lit(float(tariff))
    return slots.withColumn("cost", F.col("total") * rate)


def forecast(slots: DataFrame, periods: int = 24) -> DataFrame:
    """(slot, expected) of the slots to come: the phase medians."""
    end = slots.agg(F.max("slot").alias("b"))
    ahead = end.select(F.explode(F.expr(f"sequence(b + interval 1 hour, b + interval {periods} hours, interval 1 hour)")).alias("slot"))
    base = phase_baseline(slots)
    keyed = ahead.withColumn("dow", F.dayofweek("slot")).withColumn("hour", F.hour("slot"))
    return keyed.join(base, ["dow", "hour"], "left").select("slot", F.col("typical").alias("expected"))


def meter_differences(df: DataFrame, series: list[str], time: str, reading: str) -> DataFrame:
    """used: the difference to the reading before; a meter that falls back starts again from zero."""
    by = Window.partitionBy(*series).orderBy(time)
    d = F.col(reading) - F.lag(reading).over(by)
    return df.withColumn("used", F.when(d < 0, F.col(reading)).otherwise(d))


def downtime(df: DataFrame, line: list[str], order: str, units: str, low: float = 0.05, absorb: int = 3) -> DataFrame:
    """Stops of a line: runs of slots with at most ``low`` of its high rate (90th percentile of positive slots).

    Up to ``absorb`` unknown slots within a stop belong to it. Rows: line, first, last, slots.
    """
    high = df.where(F.col(units) > 0).groupBy(*line).agg(F.percentile(units, 0.9).alias("_h"))
    state = F.when(F.col(units).isNull(), F.lit(None)).otherwise((F.col(units) <= low * F.col("_h")).cast("int"))
    rows = df.join(high, line).withColumn("_down", state)
    by = Window.partitionBy(*line).orderBy(order)
    filled = F.coalesce("_down", F.when((F.last("_down", True).over(by.rowsBetween(-absorb, -1)) == 1) & (F.first("_down", True).over(by.rowsBetween(1, absorb)) == 1), 1).otherwise(0))
    rows = rows.withColumn("_d", filled)
    rows = rows.withColumn("_g", F.row_number().over(by) - F.row_number().over(Window.partitionBy(*line, "_d").orderBy(order)))
    return rows.where("_d = 1").groupBy(*line, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("slots")).drop("_g")


def production(df: DataFrame, line: list[str], units: str) -> DataFrame:
    """Per line: availability (share of known slots that are up), performance (mean of up slots over the high rate) and their product."""
    high = df.where(F.col(units) > 0).groupBy(*line).agg(F.percentile(units, 0.9).alias("high"))
    up = F.col(units) > 0.05 * F.col("high")
    out = df.join(high, line).groupBy(*line, "high").agg(
        F.avg(F.when(F.col(units).isNotNull(), up.cast("double"))).alias("availability"), F.avg(F.when(up, F.col(units))).alias("_m")
    )
    performance = F.least(F.lit(1.0), F.col("_m") / F.col("high"))
    return out.select(*line, "availability", performance.alias("performance"), (F.col("availability") * performance).alias("oee_partial"))


def by_shift(df: DataFrame, time: str, units: str, starts: dict[str, int]) -> DataFrame:
    """(day, shift, units): slots dealt to shifts by starting hour; the hours before the first shift belong to the day before."""
    order = sorted(starts.items(), key=lambda x: x[1])
    hour, name = F.hour(time), F.lit(order[-1][0])
    for shift, start in order:
        name = F.when(hour >= start, shift).otherwise(name)
    day = F.when(hour < order[0][1], F.date_sub(F.to_date(time), 1)).otherwise(F.to_date(time))
    return df.groupBy(day.alias("day"), name.alias("shift")).agg(F.sum(units).alias("units"))


def rule_compliance(df: DataFrame, rules: dict[str, dict[str, float]]) -> DataFrame:
    """Per channel: shares of hard and soft breaches of its range (min, max, warn_min, warn_max) and the deficit, 0 to 100."""
    parts = []
    for c, r in rules.items():
        hard, soft = F.lit(False), F.lit(False)
        for key, test in (("min", lambda v, b: v < b), ("max", lambda v, b: v > b)):
            if key in r:
                hard = hard | test(F.col(c), r[key])
            if f"warn_{key}" in r:
                soft = soft | test(F.col(c), r[f"warn_{key}"])
        parts.append(F.struct(F.lit(c).alias("channel"), F.coalesce(hard, F.lit(False)).alias("hard"), F.coalesce(soft & ~hard, F.lit(False)).alias("soft")))
    long = df.select(F.explode(F.array(*parts)).alias("s")).select("s.*")
    g = long.groupBy("channel").agg(F.avg(F.col("hard").cast("double")).alias("hard"), F.avg(F.col("soft").cast("double")).alias("soft"))
    raw = 100 * (F.col("hard") + 0.4 * F.col("soft"))
    floor = F.when(F.col("hard") > 0, 25).when(F.col("soft") > 0, 10).otherwise(0)
    return g.withColumn("deficit", F.greatest(raw, floor.cast("double")))


#: Weights of the machine health score's parts.
WEIGHTS = {"stability": 0.30, "level": 0.30, "anomaly": 0.20, "availability": 0.20}


def machine_health(df: DataFrame, machine: list[str], order: str, value: str, baseline: float = 0.2) -> DataFrame:
    """Per machine: deficits in stability, level, anomalies and availability against its first share of rows, score and grade."""
    by = Window.partitionBy(*machine).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*machine))
    rows = df.withColumn("_base", F.row_number().over(by) <= F.ceil(n * baseline))
    base = rows.where("_base").groupBy(*machine).agg(F.percentile(value, 0.5).alias("_m"), F.stddev_pop(value).alias("_s"))
    now = rows.where("not _base").join(base, machine)
    z = F.abs(F.col(value) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s"))
    g = now.groupBy(*machine, "_m", "_s").agg(
        F.stddev_pop(value).alias("sd"), F.percentile(value, 0.5).alias("med"), F.avg((z > 3.5).cast("double")).alias("far"),
        F.avg(F.col(value).isNull().cast("double")).alias("gone"),
    )
    cap = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    ratio = F.greatest(F.col("sd") / F.col("_s"), F.lit(1.0))
    spreads = F.greatest(F.abs(F.col("med") - F.col("_m")) / F.col("_s"), F.lit(1.0))
    parts = {
        "stability": cap(100 * F.ln(ratio) / math.log(4)),
        "level": cap(100 * F.ln(spreads) / math.log(1000)),
        "anomaly": cap(100 * F.coalesce(F.col("far"), F.lit(0.0)) / 0.10),
        "availability": cap(100 * F.col("gone")),
    }
    lost, weight = F.lit(0.0), F.lit(0.0)
    for k, w in WEIGHTS.items():
        lost = lost + F.coalesce(parts[k] * w, F.lit(0.0))
        weight = weight + F.when(parts[k].isNotNull(), w).otherwise(0.0)
    score = 100 - lost / weight
    return g.select(*machine, *[c.alias(k) for k, c in parts.items()], score.alias("score"), grade(score).alias("grade"))


def grade(score: Column) -> Column:
    """A from 90, B from 80, C from 70, D from 60, else F."""
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def remaining_life(df: DataFrame, machine: list[str], x: str, score: str, threshold: float = 30.0) -> DataFrame:
    """Per machine: slope of its score over the recent half, and how much x is left until the line meets the threshold (null: never)."""
    ends = df.groupBy(*machine).agg(F.percentile(x, 0.5).alias("_mid"), F.max(x).alias("_last"))
    recent = df.join(ends, machine).where(F.col(x) >= F.col("_mid"))
    fit = recent.groupBy(*machine, "_last").agg(F.regr_slope(score, x).alias("slope"), F.regr_intercept(score, x).alias("_i"))
    left = (threshold - F.col("_i")) / F.col("slope") - F.col("_last")
    return fit.select(*machine, "slope", F.when(F.col("slope") < 0, F.greatest(F.lit(0.0), left)).alias("remaining"))


def failure_labels(df: DataFrame, machine: list[str], order: str, failed: str, horizon: int = 10) -> DataFrame:
    """df with will_fail: whether a failure follows within ``horizon`` rows."""
    by = Window.partitionBy(*machine).orderBy(order).rowsBetween(0, horizon)
    return df.withColumn("will_fail", F.max(F.col(failed).cast("int")).over(by).cast("boolean"))


def window_features(df: DataFrame, machine: list[str], order: str, value: str, width: int = 10) -> DataFrame:
    """df with mean, deviation, extremes and slope over the last ``width`` rows."""
    by = Window.partitionBy(*machine).orderBy(order)
    frame = by.rowsBetween(1 - width, 0)
    rows = df.withColumn("_i", F.row_number().over(by))
    return rows.select(
        *df.columns, F.avg(value).over(frame).alias("mean"), F.stddev_pop(value).over(frame).alias("sd"), F.min(value).over(frame).alias("low"),
        F.max(value).over(frame).alias("high"), F.regr_slope(F.col(value), F.col("_i").cast("double")).over(frame).alias("slope"),
    )
