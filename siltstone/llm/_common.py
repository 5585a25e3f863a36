"""What the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words, as inside a Java or Python character class: space and the bytes 9 to 13.
SPACES = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of an input directory, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where spark.checkpoint.dir is unset, as in tests on one machine: a folder of our own.
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='siltstone-')}")
        root = _own[0]
    return root.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: cuts lineage, survives lost executors, is computed once."""
    path = f"{shared_folder(df.sparkSession)}/siltstone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstash(df: DataFrame) -> None:
    """Deletes the files of a stashed frame that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def python_ready(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, beside any place where they have it themselves."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def words(text: Column) -> Column:
    """Array of the words of a text (maximal runs without white space); of a null text: empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), "")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(taken: list[str], name: str) -> str:
    """A column name that no column of the input has, whatever its case."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name
