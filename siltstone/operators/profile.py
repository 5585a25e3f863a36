"""Column profiles in one aggregation pass, unpivoted to one row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def missing(df: DataFrame, name: str) -> Column:
    """True where a value is absent; NaN counts as absent in floating columns."""
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def profile_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: rows, missing rows, missing share and exact distinct values.

    Each (column, value) pair is aggregated before the distinct count, so a column
    that holds one value in most rows costs one partial row per task.
    """
    columns = columns or df.columns
    stacked = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.when(~missing(df, c), F.col(f"`{c}`").cast("string")).alias("value"))
                    for c in columns
                ]
            )
        ).alias("cell")
    ).select("cell.column", "cell.value")
    per_value = stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("n_missing"),
        F.count("value").alias("n_unique"),
        F.coalesce(F.max(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).cast("long").alias("top_count"),
    )
