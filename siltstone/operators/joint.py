"""Rows in which channels disagree though each looks normal: what every channel's others predict, from one set of sums.

Of each channel the residual of its regression on all others is taken, in units of its deviation;
all come from the inverse of one k x k correlation matrix, that of sums over the rows. The cut
grows with the logarithm of rows times channels, so a clean table of any size has about the
chance of one flag that the sensitivity gives a single reading.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.linear import gram
from siltstone.operators.models import _number

#: Below this many rows a distance from the centre is taken; most rows that are flagged, as a share (fixed values).
LEAST_ROWS, MOST = 50, 0.01
#: Channels beyond which readings alone are compared with the cut (fixed value).
MOST_CHANNELS = 60


def cut(cells: int, sensitivity: float) -> float:
    """Deviations beyond which one of so many normal readings lies with the probability with which one reading lies beyond ``sensitivity``."""
    tail = math.erfc(sensitivity / math.sqrt(2)) / max(int(cells), 1)
    low, high = 0.0, 38.0  # erfc is zero beyond
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if math.erfc(middle / math.sqrt(2)) > tail else (low, middle)
    return max(float(sensitivity), (low + high) / 2)


@dataclass
class Joint:
    """A fitted comparison of channels: small, and applied to batches and streams alike."""

    channels: list[str]
    medians: list[float]
    means: list[float]
    spreads: list[float]
    weights: list[list[float]]  # rows by channel of the input, columns by channel of the residual
    scales: list[float]
    cut: float
    method: str
    notes: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        """df with disagreement (the largest of the channels', in deviations), channel (whose), severity (1 at the cut) and anomaly."""
        for c in ("disagreement", "channel", "severity", "anomaly"):
            if c in df.columns:
                raise ValueError(f"there is a column {c} already")
        if len(self.channels) < 2:
            return df.withColumns({"disagreement": F.lit(0.0), "channel": F.lit(None).cast("string"), "severity": F.lit(0.0), "anomaly": F.lit(False)})
        at = len(df.columns)
        names = pa.array(self.channels)
        medians, means, spreads, weights, scales = (np.array(x) for x in (self.medians, self.means, self.spreads, self.weights, self.scales))
        distance = self.method == "distance"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[at:]], axis=1)
                z = (np.where(np.isfinite(x), x, medians) - means) / spreads
                if distance:
                    worst = np.sqrt(np.clip(((z @ weights) * z).sum(axis=1), 0, None))
                    worst = (worst - scales[0]) / scales[1]
                    which = np.abs(z @ weights).argmax(axis=1)
                else:
                    parts = np.abs(z @ weights) / scales
                    which = parts.argmax(axis=1)
                    worst = parts[np.arange(len(parts)), which] if len(parts) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(worst), names.take(pa.array(which))], [*batch.schema.names[:at], "disagreement", "channel"])

        known = [_number(df, c).alias(f"value of {i}") for i, c in enumerate(self.channels)]
        schema = df.withColumns({"disagreement": F.lit(0.0).cast("double"), "channel": F.lit("").cast("string")}).schema
        for f in schema.fields[at:]:
            f.nullable = True
        out = df.select("*", *known).mapInArrow(run, schema)
        return out.withColumn("severity", F.col("disagreement") / self.cut).withColumn("anomaly", F.col("disagreement") >= self.cut)


def fit(df: DataFrame, channels: list[str], sensitivity: float = 3.0, contamination: float | None = None) -> Joint:
    """Learns how channels move together. contamination: the share of rows to flag, in place of the cut by sensitivity.

    Channels that do not vary are left out; a missing reading is taken as its channel's median. With fewer than 50 rows the
    distance from the centre is used. More than one row in a hundred is never flagged unless asked for.
    """
    if not sensitivity > 0 or (contamination is not None and not 0 < contamination < 1):
        raise ValueError("sensitivity must be above 0, contamination between 0 and 1")
    gone = [c for c in channels if c not in df.columns]
    if gone:
        raise ValueError(f"no column {gone}")
    asked = [F.count(F.lit(1))]
    for c in channels:
        v = _number(df, c)
        asked += [F.percentile_approx(v, 0.5, 10_000), F.min(v), F.max(v), F.count(v)]
    one = df.agg(*asked).first()
    n, notes = one[0], []
    usable = [(c, one[1 + 4 * i]) for i, c in enumerate(channels) if one[2 + 4 * i] is not None and one[2 + 4 * i] < one[3 + 4 * i]]
    left = [c for c in channels if c not in [u[0] for u in usable]]
    if left:
        notes.append(f"channels without variation were left out: {', '.join(left)}")
    filled = {c: n - one[4 + 4 * i] for i, c in enumerate(channels) if c not in left and one[4 + 4 * i] < n}
    if filled:
        notes.append(f"{sum(filled.values())} missing readings of {', '.join(filled)} were taken as their channel's median")
    if len(usable) < 2 or n < 3:
        return Joint([], [], [], [], [], [], math.inf, "none", [*notes, "fewer than two channels vary, or there are fewer than three rows"])
    names, medians = [u[0] for u in usable], [float(u[1]) for u in usable]
    k = len(names)
    sums = gram(df, [F.coalesce(_number(df, c), F.lit(m)) for c, m in usable])
    cov = (sums.p - sums.s * sums.s.T / n) / n
    means = sums.centre + np.diag(sums.s) / n
    spreads = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    r = cov / np.outer(spreads, spreads) * (n / (n - 1))
    theta = np.linalg.pinv(r + max(1e-9, 1e-6 * float(np.trace(r)) / k) * np.eye(k))
    small, many = n < LEAST_ROWS, k > MOST_CHANNELS
    if many:
        notes.append(f"{k} channels are too many to compare each with the others: readings alone were")
    weights = theta if small else np.eye(k) if many else theta / np.sqrt(np.clip(np.diag(theta), 1e-12, None))
    made = Joint(names, medians, means.tolist(), spreads.tolist(), weights.tolist(), [0.0, 1.0] if small else [1.0] * k, 1.0, "distance" if small else "residuals", notes)
    if small:
        notes.append(f"only {n} rows: the distance from the centre was used")
        middle, spread = _robust(made.apply(df), "disagreement")
        made.scales = [middle, spread or 1.0]
        made.cut = float(sensitivity) if spread else math.inf
    else:
        made.scales = _spreads(df, made)
        made.cut = cut(n * k, sensitivity)
    scored = made.apply(df).select("disagreement")
    share = contamination if contamination is not None else None if small else MOST
    if share is not None:
        high = scored.agg(F.percentile_approx("disagreement", 1 - share, 20_000), F.count(F.when(F.col("disagreement") >= made.cut, 1))).first()
        if contamination is not None:
            made.cut = max(math.nextafter(high[0], math.inf), 1e-12)
        elif high[1] > n * MOST:
            made.cut = max(made.cut, high[0])
            notes.append(f"more than {MOST:.0%} of the rows looked unusual; only the most unusual are flagged")
    return made


def _robust(df: DataFrame, column: str) -> tuple[float, float]:
    """Median, and 1.4826 times the median distance from it."""
    middle = df.agg(F.percentile_approx(column, 0.5, 10_000)).first()[0] or 0.0
    return middle, 1.4826 * (df.agg(F.percentile_approx(F.abs(F.col(column) - middle), 0.5, 10_000)).first()[0] or 0.0)


def _spreads(df: DataFrame, made: Joint) -> list[float]:
    """Robust deviation of each residual, 1 at least: an ill-conditioned channel may stray further than its unit."""
    k = len(made.channels)
    known = [F.coalesce(_number(df, c), F.lit(m)) for c, m in zip(made.channels, made.medians)]
    z = df.select(*[((v - m) / s).alias(f"z{i}") for i, (v, m, s) in enumerate(zip(known, made.means, made.spreads))])
    weights = np.array(made.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) @ weights
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, i])) for i in range(k)], [f"e{i}" for i in range(k)])

    e = z.mapInArrow(run, ", ".join(f"e{i} double" for i in range(k)))
    middles = e.agg(*[F.percentile_approx(f"e{i}", 0.5, 10_000) for i in range(k)]).first()
    mads = e.agg(*[F.percentile_approx(F.abs(F.col(f"e{i}") - m), 0.5, 10_000) for i, m in enumerate(middles)]).first()
    return [max(1.0, 1.4826 * m) for m in mads]


def detect(df: DataFrame, channels: list[str], sensitivity: float = 3.0, contamination: float | None = None) -> DataFrame:
    """df with disagreement, channel, severity and anomaly, by what df itself shows."""
    return fit(df, channels, sensitivity, contamination).apply(df)
