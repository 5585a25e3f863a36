"""Readers and writers of tables, texts, logs and transcripts, by any path that Spark reads.

Text tables are read as strings; ``typed`` then finds the narrowest type that loses nothing, in one aggregation
over all rows. Writers write folders of files, as Spark does.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that hold texts, the likeliest first.
TEXT_COLUMNS = ("text", "content", "body", "message", "sentence", "passage", "description")
#: Patterns of values that a type holds without loss, in the order of preference.
_INTEGER = r"^-?(0|[1-9][0-9]{0,17})$"
_DECIMAL = r"^-?(0|[1-9][0-9]{0,14})(\.[0-9]{1,15})?([eE][+-]?[0-9]{1,2})?$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?$"
_CUE = r"(?:([0-9]+):)?([0-9]{1,2}):([0-9]{2})[.,]([0-9]{3})"


def kind(path: str) -> str:
    """csv, tsv, parquet, json or txt, by the suffix of a path; ``.gz`` and the like are passed over."""
    found = re.search(r"\.(csv|tsv|parquet|pq|jsonl|ndjson|json|txt)(\.[a-z0-9]+)?/?$", path.lower())
    if not found:
        raise ValueError(f"cannot tell the format of {path}; known suffixes are .csv .tsv .parquet .pq .json .jsonl .txt")
    return {"pq": "parquet", "ndjson": "jsonl"}.get(found[1], found[1])


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8, or ISO-8859-1 where some line is not valid UTF-8."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1)
    return "ISO-8859-1" if broken.count() else "UTF-8"


def read_table(spark: SparkSession, path: str, encoding: str | None = None, infer: bool = True) -> DataFrame:
    """A table of a csv, tsv, parquet, json or jsonl path. Empty fields are null. Quoted fields may hold line ends."""
    form = kind(path)
    if form == "parquet":
        return spark.read.parquet(path)
    if form in ("json", "jsonl"):
        return spark.read.json(path, multiLine=form == "json")
    if form == "txt":
        return spark.read.text(path).withColumnRenamed("value", "text")
    raw = spark.read.csv(path, header=True, sep="\t" if form == "tsv" else ",", encoding=encoding or encoding_of(spark, path), multiLine=True, escape='"')
    return typed(raw) if infer else raw


def typed(df: DataFrame) -> DataFrame:
    """String columns get the first type of long, double, boolean, date and timestamp that holds all their values without loss.

    Values with leading zeros, more digits than a double holds, or impossible dates leave their column as it is, as
    does a column without values. Other columns stay.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df

    def ways(c: Column) -> dict[str, tuple[Column, Column]]:
        short = F.when(F.length(c) <= 26, c)
        return {
            "long": (c.rlike(_INTEGER), c.try_cast("long")),
            "double": (c.rlike(_DECIMAL), c.try_cast("double")),
            "boolean": (F.lower(short).isin("true", "false"), c.try_cast("boolean")),
            "date": (c.rlike(_DATE), c.try_cast("date")),
            "time": (c.rlike(_TIME), c.try_cast("timestamp_ntz")),
        }

    asked = []
    for i, name in enumerate(names):
        c = F.col(f"`{name}`")
        asked += [F.every(F.when(c.isNotNull(), ok & to.isNotNull())).alias(f"{k}{i}") for k, (ok, to) in ways(c).items()]
    told = df.agg(*asked).first()
    out = {}
    for i, name in enumerate(names):
        fit = [to for k, (_, to) in ways(F.col(f"`{name}`")).items() if told[f"{k}{i}"]]
        if fit:
            out[name] = fit[0]
    return df.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in df.columns])


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """Writes a table to a folder whose suffix names the format."""
    form = kind(path)
    if form == "parquet":
        df.write.mode(mode).parquet(path)
    elif form in ("json", "jsonl"):
        df.write.mode(mode).json(path, ignoreNullFields=False)
    elif form == "txt":
        df.write.mode(mode).text(path)
    else:
        df.write.mode(mode).csv(path, header=True, sep="\t" if form == "tsv" else ",", escape='"')


def text_column(df: DataFrame) -> str:
    """The column that most likely holds texts: by its name, else the string column with the longest values on average."""
    lower = {c.lower(): c for c in reversed(df.columns)}
    for name in TEXT_COLUMNS:
        if name in lower:
            return lower[name]
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        raise ValueError("no column holds texts")
    widths = df.agg(*[F.avg(F.char_length(f"`{c}`")).alias(str(i)) for i, c in enumerate(names)]).first()
    return names[max(range(len(names)), key=lambda i: (widths[i] or 0.0, -i))]


def read_texts(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """One row per text, in a column ``text``: lines of a txt file that are not blank, or a column of a table."""
    df = read_table(spark, path, infer=False)
    texts = df.select(F.col(f"`{column or text_column(df)}`").cast("string").alias("text"))
    return texts.where(F.trim("text") != "") if kind(path) == "txt" else texts.where(F.col("text").isNotNull())


def read_log(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of an append-only log of JSON lines; torn or foreign lines are left out."""
    of = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    lines = spark.read.text(path).select(F.from_json("value", T.StructType([*of.fields, T.StructField("_torn", T.StringType())]), {"columnNameOfCorruptRecord": "_torn"}).alias("r"))
    return lines.where(F.col("r").isNotNull() & F.col("r._torn").isNull()).select(*[F.col(f"r.`{f.name}`") for f in of.fields])


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files below a folder: path, length, modified and order (file names in natural order, numbers by value)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    number = r"([0-9]+)"
    padded = F.regexp_replace(F.lower("path"), number, "0000000000000000000$1")
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.regexp_replace(padded, r"0+([0-9]{20})", "$1").alias("order"))


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that ``known`` has not with the same path, length and time."""
    return files.join(known.select("path", "length", "modified"), ["path", "length", "modified"], "left_anti")


def write_split(df: DataFrame, path: str, split: str = "split", form: str = "parquet") -> dict:
    """Writes a table with one folder per split and a ``report`` folder of their sizes; returns the report."""
    out = df.write.partitionBy(split).mode("error")
    out.csv(f"{path}/data", header=True) if form == "csv" else out.parquet(f"{path}/data")
    rows = df.sparkSession.read.option("header", True).format(form).load(f"{path}/data").groupBy(split).count().collect()
    report = {"rows": sum(r["count"] for r in rows), "splits": {str(r[split]): r["count"] for r in sorted(rows, key=lambda r: str(r[split]))}}
    df.sparkSession.createDataFrame([(json.dumps(report),)], "value string").coalesce(1).write.text(f"{path}/report")
    return report


def load_report(spark: SparkSession, path: str) -> dict:
    """A JSON report, of one file or of the folder that write_split wrote."""
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def _seconds(text: Column, at: str) -> Column:
    part = [F.regexp_extract(text, at, i) for i in range(1, 5)]
    return F.coalesce(part[0].try_cast("int"), F.lit(0)) * 3600 + part[1].try_cast("int") * 60 + part[2].try_cast("int") + part[3].try_cast("int") / 1000


def parse_transcripts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Turns of WebVTT, SRT or ``Name: text`` transcripts: doc_id, turn (from 1), speaker, text, start, end (seconds, null without cues).

    Captions are parted by blank lines; a cue line gives their time, ``<v Name>`` or ``Name:`` the speaker. Elsewhere each
    line is a turn, and a line without a name goes on with the speaker before it. Neighbouring turns of one speaker are
    merged, their texts joined by spaces. Null and empty texts have no turns.
    """
    whole = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), "^﻿", "")
    captions = whole.rlike(_CUE + r"\s+-->\s+" + _CUE)
    parts = F.when(captions, F.split(whole, r"\n[ \t]*\n+")).otherwise(F.split(whole, "\n"))
    block = docs.select(F.col(doc_id).alias("id"), captions.alias("cued"), F.posexplode(parts).alias("at", "block"))
    cue = F.regexp_extract("block", rf"({_CUE}\s+-->\s+{_CUE})", 1)
    said = F.when(F.col("cued"), F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)$", 1)).otherwise(F.col("block"))
    voiced = F.regexp_extract(said, r"<v(?:\.[^ >]*)? ([^>]+)>", 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(said, r"</?[a-zA-Z][^>]*>", ""), r"\s+", " "))
    named = F.regexp_extract(plain, r"^([\p{Lu}][\p{L}\p{N} .'-]{0,40}):\s+\S", 1)
    rows = block.select(
        "id", "at", F.when(voiced != "", voiced).when(named != "", named).alias("own"),
        F.when((voiced == "") & (named != ""), F.regexp_replace(plain, r"^[^:]*:\s+", "")).otherwise(plain).alias("said"),
        F.when(F.col("cued"), _seconds(cue, _CUE)).alias("start"), F.when(F.col("cued"), _seconds(F.regexp_extract(cue, r"-->\s+(.*)$", 1), _CUE)).alias("end"), "cued",
    ).where((F.col("said") != "") & (~F.col("cued") | F.col("start").isNotNull()))
    w = Window.partitionBy("id").orderBy("at")
    rows = rows.withColumn("speaker", F.coalesce(F.last("own", ignorenulls=True).over(w), F.lit("Unknown")))
    rows = rows.withColumn("new", F.coalesce((F.col("speaker") != F.lag("speaker").over(w)).cast("int"), F.lit(1)))
    turns = rows.withColumn("turn", F.sum("new").over(w)).groupBy("id", "turn").agg(
        F.first("speaker").alias("speaker"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "said"))), lambda r: r["said"]), " ").alias("text"),
        F.min("start").alias("start"), F.max("end").alias("end"),
    )
    return turns.select(F.col("id").alias(doc_id), "turn", "speaker", "text", "start", "end")
