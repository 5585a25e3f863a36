"""A series' normal behaviour learnt once and kept: level, spread and season as small tables that later batches and streams are held against.

Learning is a few aggregations by series; only the last rows of each series are looked at one
by one. Scoring joins the tables and looks at no other row of the batch, so it neither shifts the
baseline nor depends on what comes later, and works on a stream as it does on a table. Quantiles
are exact: mergeable sketches bound each, and the values between the bounds are counted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.anomaly import MAD_SIGMA
from siltstone.operators.splits import running

METHODS = ("auto", "all", "zscore", "iqr", "rolling", "seasonal", "ewma")
#: A sketch is off by at most one rank in ACCURACY; bounds lie MARGIN times as far from the rank asked for. Quartiles' width of a normal value's deviation.
ACCURACY, MARGIN, QUARTILES = 100_000, 4, 1.349
#: A spread below this share of the largest value is rounding; weight of the newest value; weights below this are nothing.
NOISE, ALPHA, TINY = 1e-12, 0.3, 1e-12
#: Series up to this many have their baselines broadcast (at most about 100 bytes each).
FEW_SERIES = 100_000


def quantiles(rows: DataFrame, keys: list[str], value: Column, shares: list[float], name: str) -> DataFrame:
    """keys with ``name``: for each share the known value of that rank (rounded up) among those of the keys, exactly; rows are read twice.

    Values between the bounds of a share are counted one by one: a few in ACCURACY of the keys' values.
    """
    known = rows.select(*keys, value.alias("x")).where("x is not null")
    step = MARGIN / ACCURACY
    bounds = [min(max(s + d, 0.0), 1.0) for s in shares for d in (-step, step)]
    ranged = known.groupBy(*keys).agg(F.percentile_approx("x", bounds, ACCURACY).alias("b"), F.count(F.lit(1)).alias("of"))
    places = range(len(shares))
    inside = [(F.col("x") >= F.col("b")[2 * i]) & (F.col("x") <= F.col("b")[2 * i + 1]) for i in places]
    near = reduce(Column.__or__, inside)
    below = [F.count_if(F.col("x") < F.col("b")[2 * i]).alias(f"below {i}") for i in places]
    cells = known.join(ranged, keys).groupBy(*keys, "of", "b", F.when(near, F.col("x")).alias("x")).agg(F.count(F.lit(1)).alias("n"), *below)
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    placed = cells.select(*keys, "x", "of", *[(F.sum(f"below {i}").over(whole) + F.sum(F.when(c, F.col("n")).otherwise(0)).over(upto)).alias(f"upto {i}") for i, c in enumerate(inside)], *[c.alias(f"in {i}") for i, c in enumerate(inside)])
    hits = [F.min(F.when(F.col(f"in {i}") & (F.col(f"upto {i}") >= F.ceil(F.col("of") * s)), F.col("x"))) for i, s in enumerate(shares)]
    return placed.groupBy(*keys).agg(F.array(*hits).alias(name))


@dataclass
class Detector:
    """Learns baselines by ``fit`` and holds batches against them by ``score``.

    method: zscore (median, and deviations from it), iqr (spread of the quartiles), rolling (median of the last values,
    spread about the neighbours), ewma (weighted mean of the last values), seasonal (an offset for each phase); auto: rolling
    for series of 30 values or more, else zscore. A vote of all methods needs whole series, so "all" is fitted as auto.
    Phases of a season are ``step`` seconds of the time column long, or, without a step, single rows counted on from the end
    of the history (batches only). Values that are null or not finite have no score.
    """

    series: list[str]
    order: str
    value: str
    method: str = "auto"
    sensitivity: float = 3.0
    seasonality: int | None = None
    step: float | None = None
    warnings: list[str] = field(default_factory=list)
    table: DataFrame | None = None
    profile: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method}; methods are {', '.join(METHODS)}")
        if not self.sensitivity > 0 or (self.seasonality is not None and self.seasonality < 2) or (self.step is not None and not self.step > 0):
            raise ValueError("sensitivity and step must be above 0, a season at least 2 phases long")
        if self.method == "seasonal" and not self.seasonality:
            raise ValueError("a seasonal baseline needs the number of phases of a season")

    def _known(self, df: DataFrame) -> Column:
        v = F.col(self.value).cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < math.inf), v)

    def _phase(self, df: DataFrame) -> Column:
        return F.pmod(F.floor(F.unix_micros(F.col(self.order).cast("timestamp")) / (self.step * 1e6)), F.lit(self.seasonality)).cast("int")

    def fit(self, history: DataFrame) -> Detector:
        """Learns each series' baseline; a series without a value has none."""
        rows = history.select(*self.series, F.col(self.order).alias("at"), self._known(history).alias("v")).where("v is not null")
        self.fitted = {"all": "auto"}.get(self.method, self.method)
        if self.method == "all":
            self.warnings.append("a vote of methods needs whole series; the baseline was fitted as 'auto'")
        n = rows.groupBy(*self.series).agg(F.count(F.lit(1)).alias("n"))
        if not n.limit(1).count():
            raise ValueError("cannot fit on an empty history")
        whole = rows.groupBy(*self.series).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("v").alias("sd"), F.max(F.abs("v")).alias("top"), F.max("at").alias("last"))
        whole = whole.join(quantiles(rows, self.series, F.col("v"), [0.25, 0.5, 0.75], "q"), self.series)
        kind = F.lit(self.fitted) if self.fitted != "auto" else F.when(F.col("n") >= 30, "rolling").otherwise("zscore")
        whole = whole.withColumn("method", kind).checkpoint()  # a row for each series
        self.profile = None
        if self.fitted == "seasonal":
            self._fit_season(rows, whole)
        else:
            near = self._residuals(rows, whole)
            self.table = self._with_scale(near, whole).checkpoint()
        flat = self.table.where("scale is null").count()
        if flat:
            self.warnings.append(f"{flat} series do not vary: none of their points can be an anomaly")
        self.n_series = self.table.count()
        return self

    def _tail(self, rows: DataFrame, whole: DataFrame, size: Column) -> DataFrame:
        """The last ``size`` rows of each series with ``back``: 0 for the last one."""
        back = F.row_number().over(Window.partitionBy(*self.series).orderBy(F.desc("at"), F.desc("v"))) - 1  # only the last rows are kept by each task
        most = whole.agg(F.max(size)).first()[0] or 0
        last = rows.withColumn("back", back).where(F.col("back") < int(most))
        return last.join(whole.select(*self.series, size.alias("size")), self.series).where("back < size")

    def _residuals(self, rows: DataFrame, whole: DataFrame) -> DataFrame:
        """(series, level, residual of each value)."""
        by = Window.partitionBy(*self.series).orderBy("at", "v")
        if self.fitted in ("zscore", "iqr"):
            return rows.join(whole.select(*self.series, F.col("q")[1].alias("level")), self.series).select(*self.series, "level", (F.col("v") - F.col("level")).alias("e"))
        if self.fitted == "ewma":
            reach = math.ceil(math.log(TINY) / math.log(1 - ALPHA))
            # Weights beyond ``reach`` values are below TINY, so the recursion is a sum over a bounded window.
            guard = F.sort_array(F.collect_list("v").over(by.rowsBetween(-1, 1)))
            smooth = rows.withColumn("g", (F.get(guard, F.floor((F.size(guard) - 1) / 2).cast("int")) + F.get(guard, F.floor(F.size(guard) / 2).cast("int"))) / 2)
            past = F.collect_list("g").over(by.rowsBetween(-reach, -1))
            mean = F.aggregate(F.slice("p", 2, reach), F.get("p", F.lit(0)), lambda s, x: s * (1 - ALPHA) + x * ALPHA)
            out = smooth.withColumn("p", past).withColumn("m", F.when(F.size("p") > 0, mean))
            tail = self._tail(smooth.select(*self.series, "at", F.col("g").alias("v")), whole, F.lit(reach))
            newest = tail.groupBy(*self.series).agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("k"), "v"))).alias("l"))
            level = F.aggregate(F.slice(F.transform("l", lambda x: x["v"]), 2, reach), F.get("l", F.lit(0))["v"], lambda s, x: s * (1 - ALPHA) + x * ALPHA)
            return out.join(newest.select(*self.series, level.alias("level")), self.series).select(*self.series, "level", (F.col("v") - F.coalesce("m", "v")).alias("e"))
        # rolling and auto: neighbours' medians; series of under 30 values fall back to their median
        sides = [F.sort_array(F.collect_list("v").over(by.rowsBetween(*r))) for r in ((-5, -1), (1, 5))]
        halves = [(F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2 for s in sides]
        around = rows.withColumn("m", F.coalesce((halves[0] + halves[1]) / 2, *halves))
        tail = self._tail(rows, whole, F.greatest(F.lit(7), F.floor(F.col("n") / 20)))
        newest = self._middles(tail, F.col("v"), "newest")
        both = around.join(newest, self.series).join(whole.select(*self.series, "method", F.col("q")[1].alias("middle")), self.series)
        rolls = F.col("method") == "rolling"
        level = F.when(rolls, F.col("newest")).otherwise(F.col("middle"))
        return both.select(*self.series, level.alias("level"), (F.col("v") - F.when(rolls, F.coalesce("m", "v")).otherwise(F.col("middle"))).alias("e"))

    def _middles(self, rows: DataFrame, value: Column, name: str, *more: str) -> DataFrame:
        """(series, more, name): the median of a value, the lesser of two in the middle."""
        keys = [*self.series, *more]
        return quantiles(rows, keys, value, [0.5], name).withColumn(name, F.col(name)[0])

    def _with_scale(self, near: DataFrame, whole: DataFrame) -> DataFrame:
        """whole with level, scale and its kind: the spread asked for, else the median distance, else the deviation; null if all are rounding."""
        q = near.groupBy(*self.series, "level").agg(F.stddev_pop("e").alias("esd")).join(self._middles(near, F.col("e"), "em"), self.series).checkpoint()  # a row for each series
        mad = self._middles(near.join(q.select(*self.series, "em"), self.series), F.abs(F.col("e") - F.col("em")), "mad")
        all_ = whole.join(q, self.series).join(mad, self.series)
        floor = F.greatest(F.col("top"), F.lit(1e-300)) * NOISE
        ladder = [("mad", MAD_SIGMA * F.col("mad")), ("std", F.col("esd"))]
        if self.fitted == "iqr":
            ladder.insert(0, ("iqr", (F.col("q")[2] - F.col("q")[0]) / QUARTILES))  # residuals are the values less one level
        scale, kind = F.lit(None).cast("double"), F.lit("none")
        for name, s in reversed(ladder):
            scale, kind = F.when(s > floor, s).otherwise(scale), F.when(s > floor, name).otherwise(kind)
        return all_.select(*self.series, "method", "n", "last", "level", scale.alias("scale"), kind.alias("scale_kind"))

    def _fit_season(self, rows: DataFrame, whole: DataFrame) -> None:
        period = self.seasonality
        if self.step:
            phased = rows.withColumn("phase", F.pmod(F.floor(F.unix_micros(F.col("at").cast("timestamp")) / (self.step * 1e6)), F.lit(period)).cast("int"))
        else:
            one = rows.withColumn("place", F.struct("at", "v", F.monotonically_increasing_id().alias("tie"))).withColumn("one", F.lit(1))
            phased = running(one, self.series, "place", "one").withColumn("phase", F.pmod(F.col("upto") - 1, F.lit(period)).cast("int")).drop("place", "one")
        middle = phased.join(whole.select(*self.series, F.col("q")[1].alias("middle")), self.series)
        offsets = self._middles(middle, F.col("v") - F.col("middle"), "offset", "phase").checkpoint()  # a row for each phase
        centre = self._middles(offsets, F.col("offset"), "c")
        self.profile = offsets.join(centre, self.series).select(*self.series, "phase", (F.col("offset") - F.col("c")).alias("offset")).checkpoint()
        clean = phased.join(self.profile, [*self.series, "phase"]).withColumn("v", F.col("v") - F.col("offset"))
        tail = self._tail(clean.select(*self.series, "at", "v"), whole, F.lit(period))
        level = self._middles(tail, F.col("v"), "newest")
        middles = self._middles(clean, F.col("v"), "level").checkpoint()  # a row for each series
        near = clean.join(middles, self.series).select(*self.series, "level", (F.col("v") - F.col("level")).alias("e"))
        table = self._with_scale(near, whole).join(level, self.series).withColumn("level", F.col("newest")).drop("newest")
        self.table = table.withColumn("next_phase", F.pmod(F.col("n"), F.lit(period)).cast("int")).checkpoint()

    def score(self, df: DataFrame) -> DataFrame:
        """df with expected, score, anomaly and confidence; rows of a series that was not learnt have none of them."""
        if self.table is None:
            raise ValueError("this detector is not fitted yet; call fit(history) first")
        for c in ("expected", "score", "anomaly", "confidence"):
            if c in df.columns:
                raise ValueError(f"there is a column {c} already")
        small = self.n_series <= FEW_SERIES
        known = self.table.select(*[F.col(c).alias(f"key {c}") for c in self.series], *[F.col(c).alias(f"base {c}") for c in ("level", "scale", *(["next_phase"] if self.profile is not None and not self.step else []))])
        same = [F.col(c).eqNullSafe(F.col(f"key {c}")) for c in self.series] or [F.lit(True)]
        out = df.join(F.broadcast(known) if small else known, same, "left")  # at most FEW_SERIES rows
        expected = F.col("base level")
        if self.profile is not None:
            if self.step:
                out = out.withColumn("base phase", self._phase(df))
            else:
                place = F.row_number().over(Window.partitionBy(*self.series).orderBy(self.order))
                out = out.withColumn("base phase", F.pmod(F.col("base next_phase") + place - 1, F.lit(self.seasonality)).cast("int"))
            season = self.profile.select(*[F.col(c).alias(f"of {c}") for c in self.series], F.col("phase").alias("of phase"), "offset")
            on = [F.col(c).eqNullSafe(F.col(f"of {c}")) for c in self.series] + [F.col("base phase") == F.col("of phase")]
            out = out.join(F.broadcast(season) if small and self.n_series * self.seasonality <= FEW_SERIES else season, on, "left")
            expected = expected + F.coalesce("offset", F.lit(0.0))
        v = self._known(df)
        score = F.when(v.isNotNull() & expected.isNotNull(), F.coalesce(F.abs(v - expected) / F.col("base scale"), F.lit(0.0)))
        out = out.withColumn("expected", expected).withColumn("score", score)
        hit = F.coalesce(F.col("score") > self.sensitivity, F.lit(False))
        return out.withColumn("anomaly", hit).withColumn("confidence", F.when(hit, 1 - self.sensitivity / F.col("score")).otherwise(0.0)).select(*[f"`{c}`" for c in df.columns], "expected", "score", "anomaly", "confidence")
