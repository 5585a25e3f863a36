"""Session helpers shared by benches, tests and scripts."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session with the engine's defaults; cluster jobs bring their own session instead."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cores}]").appName("siltstone")
    options = DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions or cores), "spark.driver.memory": "8g"} | conf
    for key, value in options.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
