"""Structured Streaming: event-time windows, monitors of batches, state per key.

Watermarks, triggers and late data are this engine's own; event time comes as a timestamp with a watermark.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.operators.drift import smoothed_psi

LOG = logging.getLogger(__name__)
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_time(df: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A stream with its event time as a timestamp under a watermark."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(df: DataFrame, time: str, length: str, keys: list[str], value: str, slide: str | None = None) -> DataFrame:
    """(start, keys, n, total) of fixed or sliding windows."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return df.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, time: str, keys: list[str], gap: str = "30 minutes") -> DataFrame:
    """(keys, start, end, n): events of a key until a pause of ``gap``."""
    g = df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows once a key within the watermark."""
    return df.dropDuplicatesWithinWatermark(keys)


def watch(df: DataFrame, reference: DataFrame, column: str, alert: Callable[[int, float], None], limit: float = 0.2):
    """A writer that compares each batch's column with a stored reference and calls ``alert``(batch, index) above the limit.

    An alert that fails is logged and does not stop the stream.
    """

    def check(batch: DataFrame, number: int) -> None:
        if not batch.limit(1).count():
            return
        index = smoothed_psi(reference, batch, column).first()[0] or 0.0
        if index > limit:
            try:
                alert(number, index)
            except Exception:  # noqa: BLE001
                LOG.exception("the alert of batch %s failed", number)

    return df.writeStream.foreachBatch(check)


def upsert_by_key(df: DataFrame, path: str, key: list[str], order: str):
    """A writer that keeps the latest row of each key in a folder of versions, one a batch; read_latest() reads the newest."""

    def merge(batch: DataFrame, number: int) -> None:
        from pyspark.sql import Window

        spark = batch.sparkSession
        newest = batch.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))).where("_r = 1").drop("_r")
        if number:
            old = spark.read.parquet(f"{path}/v{number - 1}")
            newest = old.join(newest.select(*key), key, "left_anti").unionByName(newest)
        newest.write.mode("overwrite").parquet(f"{path}/v{number}")

    return df.writeStream.foreachBatch(merge)


def read_latest(spark, path: str, number: int) -> DataFrame:
    """The table after a batch."""
    return spark.read.parquet(f"{path}/v{number}")


def frozen(df: DataFrame, key: str, time: str, value: str, least: int = 5) -> DataFrame:
    """(key, since, run): keys whose value has been the same ``least`` times in a row; state: the value and its run.

    Rows of a key are taken in the order of their time within a batch.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, run, since = state.get if state.exists else (None, 0, None)
        out = []
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        for t, v in zip(rows[time], rows[value]):
            if v == last:
                run += 1
            else:
                last, run, since = v, 1, t
            if run == least:
                out.append((k[0], pd.Timestamp(since), run))
        state.update((float(last), int(run), pd.Timestamp(since).to_pydatetime()))
        yield pd.DataFrame(out, columns=[key, "since", "run"]).astype({key: rows[key].dtype})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, since timestamp, run long", "last double, run long, since timestamp", "append", GroupStateTimeout.NoTimeout
    )


def health_updates(df: DataFrame, key: str, value: str, low: float, high: float) -> DataFrame:
    """(key, score, alert): per batch and key, the share of values in range, and whether it fell 20 points below the mean of the last three."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames))
        score = float(100 * rows[value].between(low, high).mean())
        alert = bool(past) and score < sum(past) / len(past) - 20
        state.update(((past + [score])[-3:],))
        yield pd.DataFrame({key: [k[0]], "score": [score], "alert": [alert]})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, score double, alert boolean", "past array<double>", "append", GroupStateTimeout.NoTimeout)
