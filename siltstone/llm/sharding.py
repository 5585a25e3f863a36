"""Sharding by histogram sort: equal bytes per shard.

Rows are ordered by (hash of the text, row key). Splitters are found by counting: each
round sums the exact bytes of the cells between candidate boundaries over all
partitions, keeps the cells that hold a splitter, and parts those into finer cells,
until every splitter is within tolerance of its target or stands between two rows.
Only rows in the few open cells are counted again, and only cell sums (a bounded
number) reach the driver. The rows are exchanged once.

Equal texts have one hash, so copies lie side by side in the order; a group of copies
that stands across a splitter is split by a hash of the row's key and number, also where
keys are equal or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm._common import free_name, stash

#: log2 of the cells into which one round parts an open cell.
BITS = 10
#: Rows that one task numbers at most, on average.
ROWS_A_SLICE = 250_000


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus 8 for its row; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8)).cast("long")


def find_splitters(keys: DataFrame, shards: int, tolerance: float) -> tuple[list[tuple[int, int]], int, int]:
    """Splitters (hash, key) of a frame with columns h, k (long) and size; also rows and bytes in all.

    A row belongs to the shard numbered by the splitters that are at most its (h, k).
    """
    low, high = -(1 << 63), 1 << 63
    lo, top, rows, total = keys.agg(F.min("k"), F.max("k"), F.count(F.lit(1)), F.sum("size")).first()
    if not rows:
        return [], 0, 0
    goals = [total * i // shards for i in range(1, shards)]
    slack = max(1, int(total / shards * tolerance))
    # An open cell: hashes [a, b) when b - a > 1, or one hash and keys [c, d); with the bytes below it and its splitters' goals.
    cells = [(low, high, lo, top + 1, 0, goals)]
    found: dict[int, tuple[int, int]] = {}
    while cells:
        parts = []
        for a, b, c, d, below, wanted in cells:
            by_hash = b - a > 1
            start, end = (a, b) if by_hash else (c, d)
            step = max(1, -(-(end - start) // (1 << BITS)))
            parts.append((a, b, by_hash, start, step))
        counts = _count(keys, parts)
        todo = []
        for number, (a, b, c, d, below, wanted) in enumerate(cells):
            _, _, by_hash, start, step = parts[number]
            end = b if by_hash else d
            at, left = below, list(wanted)
            for cell in sorted(counts.get(number, {})):
                size, n = counts[number][cell]
                inside = [g for g in left if g <= at + size]
                left = left[len(inside) :]
                x, y = start + cell * step, min(end, start + (cell + 1) * step)
                open_goals = []
                for g in inside:
                    # the nearer edge of the cell, if it is near enough or the cell can't be parted
                    edge, off = (x, g - at) if g - at < at + size - g else (y, at + size - g)
                    single = n == 1 or (not by_hash and y - x <= 1)
                    if off <= slack or single:
                        found[g] = (edge, c) if by_hash else ((a, edge) if edge < d else (a + 1, lo))
                    else:
                        open_goals.append(g)
                if open_goals:
                    todo.append((x, y, c, d, at, open_goals) if by_hash else (a, b, x, y, at, open_goals))
                at += size
        cells = todo
    return sorted(found[g] for g in goals), rows, total


def _count(keys: DataFrame, parts: list[tuple[int, int, bool, int, int]]) -> dict[int, dict[int, tuple[int, int]]]:
    """Bytes and rows of the candidate cells, by the number of the open cell."""
    which, cell = F.lit(None).cast("int"), F.lit(None).cast("long")
    for number, (a, b, by_hash, start, step) in enumerate(parts):
        inside = (F.col("h") >= F.lit(a)) & (F.col("h") <= F.lit(b - 1))
        if by_hash:  # cells are powers of two wide: a shift of the offset from the cell's start, as unsigned numbers
            offset = F.col("h").bitwiseXOR(F.lit(-(1 << 63))) - F.lit(_signed(start + (1 << 63)))
            place = F.shiftrightunsigned(offset, step.bit_length() - 1)
        else:
            inside = inside & (F.col("k") >= F.lit(start)) & (F.col("k") < F.lit(start + step * (1 << BITS)))
            place = F.expr(f"(k - ({start}L)) div {step}L")
        which = F.when(inside, F.lit(number)).otherwise(which)
        cell = F.when(inside, place).otherwise(cell)
    sums = (
        keys.select(which.alias("which"), cell.alias("cell"), "size")
        .where(F.col("which").isNotNull())
        .groupBy("which", "cell")
        .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    )
    out: dict[int, dict[int, tuple[int, int]]] = {}
    for r in sums.collect():  # at most 2^BITS sums for each open cell, of which there is one a splitter at most
        out.setdefault(r["which"], {})[r["cell"]] = (r["size"], r["n"])
    return out


def _signed(x: int) -> int:
    """An unsigned 64-bit number as Spark's long."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def shard_rows(
    df: DataFrame, shards: int, text: str = "text", key: str = "doc_id", tolerance: float = 0.0005, keep: list[str] | None = None
) -> DataFrame:
    """Columns of df (those in ``keep``, or all), then shard (int), slot (long, gapless from 0 in its shard) and size (long).

    Shards differ from equal bytes by at most ``tolerance`` of a shard, or by one row where a row is larger than that.
    Null texts have 8 bytes; null keys count as the smallest; repeated rows are rows of their own; an empty table gives
    no row. Columns of df that are named shard, slot or size are replaced.
    """
    keep = [c for c in (keep or df.columns) if c.lower() not in ("shard", "slot", "size")]
    h, k, part = (free_name(df.columns, x) for x in ("order_hash", "order_key", "slice"))
    wide = df.select(
        *[F.col(f"`{c}`") for c in keep],
        byte_size(F.col(text)).alias("size"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(h),
        # A number of the row parts what is equal in text and key; two bits fewer keep the splitters' sums within a long.
        F.shiftrightunsigned(F.xxhash64(F.col(key), F.monotonically_increasing_id()), 2).alias(k),
    )
    wide = stash(wide, "shard-rows")  # the rows' numbers are settled once, then counted and exchanged from the shared folder
    keys = wide.select(F.col(h).alias("h"), F.col(k).alias("k"), "size")
    splitters, rows, _ = find_splitters(keys, shards, tolerance)
    shard = F.lit(0)
    for a, b in splitters:
        if a < 1 << 63:
            shard = shard + ((F.col(h) > F.lit(a)) | ((F.col(h) == F.lit(a)) & (F.col(k) >= F.lit(b)))).cast("int")
    slices = max(1, -(-rows // shards // ROWS_A_SLICE))
    placed = wide.withColumn("shard", shard.cast("int")).withColumn(part, F.pmod(F.xxhash64(k, h), F.lit(slices)))
    at = Window.partitionBy("shard", part).orderBy(h, k)
    if slices == 1:
        return placed.withColumn("slot", (F.row_number().over(at) - 1).cast("long")).drop(h, k, part)
    sizes = placed.groupBy("shard", part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    numbered = placed.withColumn("slot", (F.row_number().over(at) - 1).cast("long"))
    return numbered.join(starts, ["shard", part]).withColumn("slot", F.col("slot") + F.col("n")).drop(h, k, part, "n")
