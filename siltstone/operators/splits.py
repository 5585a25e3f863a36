"""Train, validation and test parts of exact sizes that leak nothing: stratified, grouped, by time.

What must stay together is a unit: a group of rows, linked groups, or the equal copies of a
row. Units are narrow rows (unit, size, stratum, order), ordered by a hash of their name or by
time, and dealt to parts where their midpoint falls on the running total of their stratum.
Running totals are summed up within ranges and over the ranges, so no task holds a stratum.
Rows then find their part by comparing their own order with two bounds a stratum; only where
a unit's stratum or time is not in the row itself are rows joined with units.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.graph import components

PARTS = ("train", "val", "test")
#: Strata up to this many have their bounds broadcast (three short strings each) and are ranked by one task; others are shuffled and ranked by ranges.
FEW_STRATA = 10_000
MISSING, POOLED = "<missing>", "<pooled>"

# Words by which a column's name tells an identifier (fixed values).
ID_SUFFIXES = ["id", "ids", "uuid", "guid"]
ID_ANYWHERE = ["uuid", "guid"]
ENTITIES = [
    "customer", "user", "session", "subject", "patient", "account", "device", "household", "client", "member", "visitor", "participant", "person",
    "student", "employee", "player", "entity", "case", "tenant", "organisation", "organization", "org", "company", "merchant", "driver", "vehicle",
    "site", "store", "clinic", "hospital", "school", "family",
]
NUMBER_WORDS = ["no", "num", "number", "nbr", "code", "key", "ref"]
OTHER_IDS = ["orderid", "itemid", "productid", "docid", "fileid", "groupid", "recordid", "txid", "transactionid", "eventid", "requestid", "traceid"]


def is_id_like(name: str) -> bool:
    """Whether a column's name looks like that of an identifier: customer_id, userId, session_uuid, patient_no, account."""
    parts = [p for p in re.split(r"[^0-9A-Za-z]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", str(name)).lower()) if p]
    if not parts:
        return False
    glued, last = "".join(parts), parts[-1]
    return (
        last in ID_SUFFIXES
        or any(p in ID_ANYWHERE for p in parts)
        or glued in OTHER_IDS
        or (glued.endswith("id") and glued[:-2] in ENTITIES)
        or (len(parts) == 1 and last in ENTITIES)
        or (last in NUMBER_WORDS and any(p in ENTITIES for p in parts[:-1]))
    )


def id_columns(df: DataFrame, exclude: list[str] = ()) -> list[str]:
    """Columns with an identifier's name whose values repeat but are not all one; numbers with fractions are none."""
    named = [c for c in df.columns if c not in exclude and is_id_like(c)]
    if not named:
        return []
    asked = [F.count(F.lit(1)).alias("n")]
    for k, c in enumerate(named):
        asked.append(F.count_distinct(c).alias(f"d{k}"))
        real = isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))
        asked.append((F.coalesce(F.max(F.when(F.isnan(c) | F.col(c).isNull(), 0).otherwise(F.abs(F.col(c) % 1))), F.lit(0)) if real else F.lit(0)).alias(f"f{k}"))
    one = df.agg(*asked).first()
    return [c for k, c in enumerate(named) if 2 <= one[f"d{k}"] < one["n"] and not one[f"f{k}"]]


def as_text(df: DataFrame, column: str) -> Column:
    """A column as text, so that different values differ; null stays null."""
    kind = df.schema[column].dataType
    value = F.col(f"`{column}`")
    return F.hex(value) if isinstance(kind, T.BinaryType) else value.cast("string")


def _missing(df: DataFrame, column: str) -> Column:
    value = F.col(f"`{column}`")
    return value.isNull() | F.isnan(value) if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)) else value.isNull()


def content(df: DataFrame) -> Column:
    """A digest of a whole row; equal rows have equal ones."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("v"), as_text(df, c)), F.lit("n")) for c in df.columns]))


def running(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """df with ``upto``: the sum of ``value`` of the rows of the same keys up to each row, by ``order`` (no two rows of one order).

    Rows are sorted into ranges; sums within ranges and of the ranges before are added, so that a key's rows are shared out.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in keys], F.col(order)).withColumn("part of range", F.spark_partition_id()).checkpoint()
    own = ranged.groupBy(*keys, "part of range").agg(F.sum(value).alias("all of range"))
    before = Window.partitionBy(*keys).orderBy("part of range").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.withColumn("start of range", F.coalesce(F.sum("all of range").over(before), F.lit(0))).drop("all of range")  # a row for each key and range
    inner = Window.partitionBy(*keys, "part of range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("upto", F.sum(value).over(inner)).join(starts, [*keys, "part of range"])
    return placed.withColumn("upto", F.col("upto") + F.col("start of range")).drop("part of range", "start of range")


def apportioned(strata: DataFrame, total: int, rows: int, cap: str, name: str) -> DataFrame:
    """strata (stratum, rows, tie, ...) with ``name``: whole numbers that sum to ``total``, in proportion to ``rows``, at most ``cap``.

    Largest remainders are rounded up; ties go by ``tie``. Whole numbers only, so that no rounding of fractions decides.
    """
    share = F.expr(f"(rows * {total}L) div {max(rows, 1)}L")
    based = strata.withColumn("base", F.least(share, F.col(cap))).withColumn("rest", F.expr(f"(rows * {total}L) % {max(rows, 1)}L"))
    left = total - (based.agg(F.sum("base")).first()[0] or 0)
    if left <= 0:
        return based.withColumn(name, F.col("base")).drop("base", "rest")
    ordered = based.withColumn("turn", F.struct((F.col("base") >= F.col(cap)).alias("full"), (-F.col("rest")).alias("rest"), "tie")).withColumn("one", F.lit(1))
    few = strata.limit(FEW_STRATA + 1).count() <= FEW_STRATA
    placed = ordered.withColumn("upto", F.row_number().over(Window.orderBy("turn"))) if few else running(ordered, [], "turn", "one")  # one task of FEW_STRATA rows at most
    return placed.withColumn(name, F.col("base") + F.when((F.col("upto") <= left) & (F.col("base") < F.col(cap)), 1).otherwise(0)).drop("base", "rest", "turn", "one", "upto")


@dataclass
class Split:
    """``rows``: the input with its part in one more column; ``strategy`` and ``warnings`` tell how it was made."""

    rows: DataFrame
    column: str
    strategy: dict
    warnings: list[str] = field(default_factory=list)
    maker: Splitter | None = None

    def part(self, name: str) -> DataFrame:
        return self.rows.where(F.col(self.column) == name).drop(self.column)

    train = property(lambda self: self.part("train"))
    val = property(lambda self: self.part("val") if self.strategy["val_rows"] is not None else None)
    test = property(lambda self: self.part("test"))

    def balance(self) -> DataFrame:
        """(label, part, n, share, overall): rows of each class or bin of the target in each part, and its shares there and in all."""
        label = F.col("label") if self.strategy["target"] is None else self.maker._label
        counts = self.rows.groupBy(label.alias("label"), F.col(self.column).alias("part")).agg(F.count(F.lit(1)).alias("n"))
        sizes = counts.groupBy("part").agg(F.sum("n").alias("of_part"))
        labels = counts.groupBy("label").agg(F.sum("n").alias("of_label"))
        total = max(self.strategy["rows"], 1)
        grid = labels.crossJoin(F.broadcast(sizes))  # three parts at most: no part is left out where a class is absent
        full = grid.join(counts, ["label", "part"], "left")
        return full.select("label", "part", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("of_part")).alias("share"), (F.col("of_label") / total).alias("overall"))

    def report(self) -> dict:
        """Sizes and leakage, counted anew from the rows: ``ok`` if nothing leaks and no row is lost."""
        part, s = F.col(self.column), self.strategy
        sizes = {r[0]: r[1] for r in self.rows.groupBy(part).count().collect()}
        source = self.rows.drop(self.column)
        copies = self.rows.groupBy(content(source).alias("k")).agg(F.count(F.lit(1)).alias("n"), (F.min(part) != F.max(part)).alias("apart"))
        dup = copies.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("apart"), F.col("n"))), F.lit(0))).first()
        out = {"rows": sum(sizes.values()), "sizes": sizes, "duplicate_rows": dup[0], "leaked_rows": dup[1], "overlapping_groups": 0, "groups": None}
        if s["group"]:
            columns = [[c] for c in s["group"]] if s["group_mode"] == "linked" else [s["group"]]
            found = []
            for keys in columns:
                there = reduce(lambda a, b: a & b, [~_missing(source, c) for c in keys])
                sides = self.rows.where(there).groupBy(*keys).agg((F.min(part) != F.max(part)).alias("apart"))
                found.append(sides.agg(F.count(F.lit(1)), F.count(F.when(F.col("apart"), 1))).first())
            out |= {"groups": sum(f[0] for f in found), "overlapping_groups": sum(f[1] for f in found)}
        out["ordered"] = None
        if s["time"]:
            unit = self.maker._unit_times(source)
            spans = {r[0]: (r[1], r[2]) for r in self.rows.withColumns(unit).groupBy(part).agg(F.min("unit time"), F.max("unit time")).collect()}
            there = [spans[p] for p in PARTS if p in spans]
            out["ordered"] = all(a[1] <= b[0] for a, b in zip(there, there[1:]))
        out["balance_max_deviation"] = None
        if s["target"]:
            out["balance_max_deviation"] = self.balance().agg(F.max(F.abs(F.col("share") - F.col("overall")))).first()[0]
        out["ok"] = out["rows"] == s["rows"] and not out["overlapping_groups"] and not (s["dedupe"] and out["leaked_rows"]) and out["ordered"] is not False
        return out


class Splitter:
    """How to split; ``split`` does it.

    target: strata are its classes, or quantile bins of a number with over ``max_categories`` values. group: a column, a
    list of columns as one key, or "auto" for columns with an identifier's name (rows that share any of several stay
    together); rows without the key stand alone. time: oldest to train, newest to test; no strata then. test, val: a share
    below 1 or a number of rows. dedupe: equal rows stay together. Equal input, seed and parameters give equal parts
    however the input is partitioned.
    """

    def __init__(self, target: str | None = None, group: str | list[str] | None = None, time: str | None = None, test: float = 0.2, val: float = 0.1, seed: int = 0, dedupe: bool = True, stratify: bool | str = "auto", bins: int = 10, max_categories: int = 20, column: str = "split") -> None:
        for name, size in (("test", test), ("val", val)):
            if isinstance(size, bool) or not isinstance(size, (int, float)):
                raise TypeError(f"{name} must be a share or a number of rows")
            if size < 0 or (isinstance(size, float) and size >= 1):
                raise ValueError(f"{name} must be a share below 1 or a number of rows of 0 or more")
        if isinstance(test, float) and isinstance(val, float) and test + val >= 1:
            raise ValueError("test and val must leave rows for train")
        if stratify not in ("auto", True, False):
            raise ValueError("stratify must be 'auto', True or False")
        if isinstance(group, (list, tuple)) and not group:
            raise ValueError("the list of group columns is empty")
        if target is not None and target == time:
            raise ValueError("target and time must be different columns")
        self.target, self.group, self.time, self.test, self.val, self.seed = target, group, time, test, val, seed
        self.dedupe, self.stratify, self.bins, self.max_categories, self.column = dedupe, stratify, bins, max_categories, column

    def split(self, df: DataFrame) -> Split:
        low = [c.lower() for c in df.columns]
        if len(set(low)) < len(low):
            raise ValueError(f"columns of one name: {sorted({c for c in low if low.count(c) > 1})}")
        if self.column.lower() in low:
            raise ValueError(f"there is a column {self.column} already; name another by column=")
        warnings: list[str] = []
        columns, mode = self._group_columns(df, warnings)
        for c in [*(columns or []), *[x for x in (self.target, self.time) if x]]:
            if c not in df.columns:
                raise ValueError(f"no column {c}")
        n = df.count()
        n_test, n_val = (s if isinstance(s, int) else int(s * n + 0.5) for s in (self.test, self.val))
        if n_test + n_val > n:
            raise ValueError(f"test and val ask for {n_test + n_val} of {n} rows")
        has_val = self.val > 0
        if self.time and df.where(_missing(df, self.time)).limit(1).count():
            raise ValueError(f"{self.time} has missing values; fill them or leave those rows out")
        rows = self._units_of(df, columns, mode)
        kind, stratified, narrow = self._strata_of(df, rows, n, 3 if has_val else 2, warnings)
        units = self._units(narrow, stratified).checkpoint()
        dealt, strata = self._dealt(units, n, n_test, n_val)
        dealt = dealt.checkpoint()
        moved = self._repair(dealt, n_test, n_val)
        out = self._assigned(df, rows, dealt, strata, columns, mode, stratified, moved)
        self._columns, self._mode = columns, mode
        sizes = {r[0]: r[1] for r in dealt.groupBy("part").agg(F.sum("size")).collect()}
        for unit, size, old, new in moved:
            sizes[old] -= size
            sizes[new] = sizes.get(new, 0) + size
        for name, wanted in (("train", n - n_test - n_val), ("val", n_val), ("test", n_test)):
            if n and not sizes.get(name) and (wanted or name == "train"):
                warnings.append(f"{name} is empty: too few rows, or units that cannot be divided")
        if not n:
            warnings.append("the input has no rows")
        strategy = {"method": "chronological" if self.time else "stratified" if stratified else "random", "rows": n, "target": self.target, "target_kind": kind, "stratified": stratified}
        strategy |= {"n_strata": strata.count() if stratified else None, "group": columns, "group_mode": mode, "time": self.time, "dedupe": self.dedupe}
        strategy |= {"test_rows": n_test, "val_rows": n_val if has_val else None, "sizes": {k: v for k, v in sizes.items() if v}}
        return Split(out, self.column, strategy, warnings, self)

    def _group_columns(self, df: DataFrame, warnings: list[str]) -> tuple[list[str] | None, str | None]:
        if self.group is None:
            return None, None
        if self.group == "auto" and "auto" not in df.columns:
            found = id_columns(df, [c for c in (self.target, self.time) if c])
            if not found:
                warnings.append("no column with an identifier's name and repeated values; rows are split one by one")
                return None, None
            return found, "single" if len(found) == 1 else "linked"
        columns = [self.group] if isinstance(self.group, str) else list(self.group)
        return columns, "single" if len(columns) == 1 else "composite"

    def _units_of(self, df: DataFrame, columns: list[str] | None, mode: str | None) -> DataFrame:
        """df with ``unit name``, ``unit order`` and, of a numeric target in bins or a class, later ``label``."""
        own = F.concat(F.lit("d:"), content(df))
        if not self.dedupe:  # equal rows are numbered; any numbering is as good as another
            own = F.concat(own, F.lit(":"), F.row_number().over(Window.partitionBy(content(df)).orderBy(F.lit(0))).cast("string"))
        if columns is None:
            rows = df.withColumn("unit name", own)
        elif mode == "linked":
            ids = [F.when(~_missing(df, c), F.concat(F.lit(f"{k}:"), as_text(df, c))) for k, c in enumerate(columns)]
            pairs = df.select(F.coalesce(*ids).alias("a"), F.explode(F.array(*ids)).alias("b")).where("a is not null and b is not null and a <> b").distinct()
            roots = components(pairs)
            first = df.withColumn("first id", F.coalesce(*ids))
            rows = first.join(roots, F.col("first id") == F.col("node"), "left").withColumn("unit name", F.coalesce(F.concat(F.lit("g:"), F.coalesce("root", "first id")), own)).drop("node", "root", "first id")
        else:
            gone = reduce(lambda a, b: a | b, [_missing(df, c) for c in columns])
            rows = df.withColumn("unit name", F.when(gone, own).otherwise(F.concat(F.lit("g:"), F.concat_ws("\x1f", *[as_text(df, c) for c in columns]))))
        return rows.withColumn("unit order", F.md5(F.concat(F.lit(f"{self.seed}:"), F.col("unit name"))))

    def _strata_of(self, df: DataFrame, rows: DataFrame, n: int, splits: int, warnings: list[str]) -> tuple[str | None, bool, DataFrame]:
        """Kind of the target, whether strata are used, and (unit name, unit order, label, stratum, time, n) by unit and label."""
        self._label, kind = F.lit(""), None
        if self.target:
            kind, self._label = self._labels(df, n, splits)
        time = F.col(f"`{self.time}`") if self.time else F.lit(0)
        narrow = rows.select("unit name", "unit order", self._label.alias("label"), time.alias("time"))
        narrow = narrow.groupBy("unit name", "unit order", "label").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("time"))
        stratified = bool(self.target and self.stratify and not self.time and n)
        if stratified:
            narrow = narrow.checkpoint()
            classes = narrow.groupBy("label").agg(F.sum("n").alias("all"))
            rare = F.col("all") < splits
            one = classes.agg(F.count(F.lit(1)).alias("c"), F.count(F.when(rare, 1)).alias("r"), F.coalesce(F.sum(F.when(rare, F.col("all"))), F.lit(0)).alias("rows"), F.min(F.when(rare, F.col("label"))).alias("example"), F.coalesce(F.sum(F.when(F.col("label") == MISSING, F.col("all"))), F.lit(0)).alias("gone")).first()
            if one["gone"]:
                warnings.append(f"{self.target} is missing in {one['gone']} rows; they are a stratum of their own")
            if one["c"] < 2:
                warnings.append(f"{self.target} has a single class or too few rows for bins; the split is random")
                stratified = False
            elif one["r"] and (one["rows"] * 2 > n or one["r"] == one["c"]):
                warnings.append(f"{one['r']} of {one['c']} classes of {self.target} have fewer than {splits} rows ({one['rows']} of {n}); the split is random")
                stratified = False
            elif one["r"]:
                warnings.append(f"{one['r']} classes of {self.target} with fewer than {splits} rows were pooled, such as {one['example']}")
                few = classes.where(rare).select("label", F.lit(True).alias("few"))
                narrow = narrow.join(few, "label", "left").withColumn("stratum", F.when(F.col("few"), POOLED).otherwise(F.col("label"))).drop("few")
        if "stratum" not in narrow.columns:
            narrow = narrow.withColumn("stratum", F.col("label") if stratified else F.lit(""))
        return kind, stratified, narrow

    def _labels(self, df: DataFrame, n: int, splits: int) -> tuple[str, Column]:
        """The target's kind, and a row's class or bin as text."""
        kind, value = df.schema[self.target].dataType, F.col(f"`{self.target}`")
        gone = _missing(df, self.target)
        numeric = isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))
        if numeric and df.select(value).where(~gone).distinct().limit(self.max_categories + 1).count() > self.max_categories:
            bins = min(self.bins, max(1, n // (3 * splits)))
            number = F.unix_micros(value.cast("timestamp")) if not isinstance(kind, T.NumericType) else value
            cuts = df.where(~gone).agg(F.percentile_approx(number, [k / bins for k in range(1, bins)] or [1.0], 10_000)).first()[0]
            edges = sorted(set(cuts or [])) if bins > 1 else []
            place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < number)) if edges else F.lit(0)
            return "numeric", F.when(gone, MISSING).otherwise(F.format_string("bin %03d", place))
        return "categorical", F.when(gone, MISSING).otherwise(as_text(df, self.target))

    def _units(self, narrow: DataFrame, stratified: bool) -> DataFrame:
        """(unit name, order, stratum, size): a unit is of the stratum of most of its rows, of several the first by name."""
        by = narrow.groupBy("unit name", "unit order", "stratum").agg(F.sum("n").alias("n"), F.min("time").alias("time"))
        first = F.min(F.struct((-F.col("n")).alias("m"), "stratum"))["stratum"] if stratified else F.min("stratum")
        units = by.groupBy("unit name", "unit order").agg(F.sum("n").alias("size"), first.alias("stratum"), F.min("time").alias("time"))
        return units.select("unit name", F.struct("time", "unit order").alias("order"), "stratum", "size")

    def _dealt(self, units: DataFrame, n: int, n_test: int, n_val: int) -> tuple[DataFrame, DataFrame]:
        """units with part; strata with their targets. What strata of small units' rounding leaves over, the largest takes up."""
        strata = units.groupBy("stratum").agg(F.sum("size").alias("rows"))
        strata = strata.withColumn("tie", F.md5(F.concat(F.lit(f"{self.seed}:"), "stratum"))).checkpoint()
        strata = apportioned(strata, n_test, n, "rows", "test").withColumn("room", F.col("rows") - F.col("test"))
        strata = apportioned(strata, n_val, n, "room", "val").select("stratum", "rows", "test", "val").checkpoint()
        largest = strata.orderBy(F.desc("rows"), "stratum").limit(1).collect()
        placed = running(units, ["stratum"], "order", "size")
        if not largest:
            return placed.withColumn("part", F.lit("train")), strata
        big = largest[0]
        first = self._cut(placed.join(strata, "stratum"))
        of = lambda part: F.coalesce(F.sum(F.when(F.col("part") == part, F.col("size"))), F.lit(0))
        got = first.where(F.col("stratum") != big["stratum"]).agg(of("test"), of("val")).first()
        test = min(max(n_test - got[0], 0), big["rows"])
        val = min(max(n_val - got[1], 0), big["rows"] - test)
        here = F.col("stratum") == big["stratum"]
        strata = strata.withColumn("test", F.when(here, F.lit(test)).otherwise(F.col("test"))).withColumn("val", F.when(here, F.lit(val)).otherwise(F.col("val")))
        return self._cut(placed.join(strata, "stratum")).select("unit name", "order", "stratum", "size", "part"), strata

    @staticmethod
    def _cut(placed: DataFrame) -> DataFrame:
        twice = 2 * F.col("upto") - F.col("size")  # twice a unit's midpoint
        high = 2 * (F.col("rows") - F.col("test"))
        return placed.withColumn("part", F.when(twice > high, "test").when(twice > high - 2 * F.col("val"), "val").otherwise("train"))

    @staticmethod
    def _repair(dealt: DataFrame, n_test: int, n_val: int) -> list[tuple[str, int, str, str]]:
        """(unit, its size, from, to) of at most two units: a part that was asked for takes the last unit of another if it would be empty."""
        many = {r[0]: r[1] for r in dealt.groupBy("part").count().collect()}
        moved = []
        for target, wanted, donors in (("test", n_test, ("train", "val")), ("val", n_val, ("train",))):
            if not wanted or many.get(target):
                continue
            for donor in donors:
                if many.get(donor, 0) > (donor == "train"):
                    pool = dealt.where((F.col("part") == donor) & ~F.col("unit name").isin([m[0] for m in moved]))
                    unit = pool.orderBy(F.desc("order")).select("unit name", "size").first()
                    moved.append((unit[0], unit[1], donor, target))
                    many[donor] -= 1
                    many[target] = 1
                    break
        return moved

    def _assigned(self, df: DataFrame, rows: DataFrame, dealt: DataFrame, strata: DataFrame, columns: list[str] | None, mode: str | None, stratified: bool, moved: list) -> DataFrame:
        """The rows with their part."""
        if columns is not None and (stratified or self.time or mode == "linked"):
            parts = dealt.select("unit name", F.col("part").alias("part of unit"))
            out = rows.join(parts, "unit name")
        else:  # a row's own order and stratum say all
            bounds = dealt.groupBy("stratum").agg(F.min(F.when(F.col("part") == "test", F.col("order"))).alias("from test"), F.min(F.when(F.col("part") != "train", F.col("order"))).alias("from val"))
            time = F.col(f"`{self.time}`") if self.time else F.lit(0)
            out = rows.withColumn("row order", F.struct(time.alias("time"), "unit order"))
            if stratified:
                names = dealt.select("stratum").distinct()
                bounds = bounds.checkpoint()
                few = bounds.count() <= FEW_STRATA
                pooled = bounds.where(F.col("stratum") == POOLED).select(F.col("from test").alias("pooled test"), F.col("from val").alias("pooled val"), F.lit(True).alias("pool"))
                marked = out.withColumn("row stratum", self._label)
                out = marked.join(F.broadcast(bounds) if few else bounds, F.col("row stratum") == F.col("stratum"), "left")  # at most FEW_STRATA rows
                out = out.join(F.broadcast(pooled), F.col("stratum").isNull(), "left") if names.where(F.col("stratum") == POOLED).limit(1).count() else out.withColumns({"pooled test": F.col("from test"), "pooled val": F.col("from val")})  # one row
                out = out.withColumn("from test", F.when(F.col("stratum").isNull(), F.col("pooled test")).otherwise(F.col("from test")))
                out = out.withColumn("from val", F.when(F.col("stratum").isNull(), F.col("pooled val")).otherwise(F.col("from val")))
            else:
                out = out.crossJoin(F.broadcast(bounds))  # one row
            out = out.withColumn("part of unit", F.when(F.col("row order") >= F.col("from test"), "test").when(F.col("row order") >= F.col("from val"), "val").otherwise("train"))
        part = F.col("part of unit")
        for unit, _, _, new in moved:
            part = F.when(F.col("unit name") == unit, new).otherwise(part)
        return out.withColumn(self.column, part).select(*[f"`{c}`" for c in df.columns], self.column)

    def _unit_times(self, source: DataFrame) -> dict[str, Column]:
        """``unit time`` of each row: the first time of its group, by a window over the key (rows without one: their own)."""
        if not self._columns or self._mode == "linked":
            return {"unit time": F.col(f"`{self.time}`")}
        gone = reduce(lambda a, b: a | b, [_missing(source, c) for c in self._columns])
        whole = F.min(f"`{self.time}`").over(Window.partitionBy(*[f"`{c}`" for c in self._columns]))
        return {"unit time": F.when(gone, F.col(f"`{self.time}`")).otherwise(whole)}


def split(df: DataFrame, **how) -> Split:
    """Splits with the parameters of ``Splitter``."""
    return Splitter(**how).split(df)
