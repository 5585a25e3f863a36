"""Cleaning, schemas, leak-safe splits, feature checks and synthetic tables."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that mean a missing value (fixed values).
NA_TOKENS = ["", "na", "n/a", "nan", "null", "none", "-", "--", "?", "missing", "unknown"]
TRUE, FALSE = ["true", "yes", "y", "1", "t", "on"], ["false", "no", "n", "0", "f", "off"]


def clean_names(names: list[str]) -> list[str]:
    """Trimmed, inner white space as _, lower case; a name that is taken gets a number."""
    out: list[str] = []
    for n in names:
        base = re.sub(r"\s+", "_", n.strip()).lower() or "column"
        name, i = base, 2
        while name in out:
            name, i = f"{base}_{i}", i + 1
        out.append(name)
    return out


def na_to_null(c: Column) -> Column:
    """Trimmed text; tokens of absence become null."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin(NA_TOKENS), t)


def parse_number(c: Column) -> Column:
    """1,234 and $12.50 and (300) and 45% as numbers; codes with leading zeros stay text (null here)."""
    t = F.trim(c)
    minus = t.startswith("(") & t.endswith(")") & (F.length(t) > 1)
    bare = F.translate(F.when(minus, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t), "$€£, \t\n\r\f\v", "")
    percent = bare.endswith("%")
    value = F.when(percent, F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare).try_cast("double")
    value = F.when(percent, value / 100).otherwise(value)
    return F.when(~bare.rlike(r"^[+-]?0[0-9]"), F.when(minus, -value).otherwise(value))


def parse_bool(c: Column) -> Column:
    """yes and no, in their common spellings."""
    t = F.lower(F.trim(c))
    return F.when(t.isin(TRUE), True).when(t.isin(FALSE), False)


def parse_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per text column: share of known values that parse as number, boolean and ISO date."""
    cells = [F.struct(F.lit(c).alias("column"), na_to_null(F.col(c)).alias("v")) for c in columns]
    long = df.select(F.explode(F.array(*cells)).alias("s")).select("s.*").where("v is not null")
    share = lambda x: F.avg(x.isNotNull().cast("double"))
    return long.groupBy("column").agg(
        share(parse_number(F.col("v"))).alias("number"), share(parse_bool(F.col("v"))).alias("boolean"),
        share(F.when(F.col("v").rlike(r"^\d{4}-\d{2}-\d{2}"), F.col("v").try_cast("timestamp"))).alias("date"),
    )


@dataclass
class Cleaner:
    """What was learnt from a table: parsers by column, fills and fences. apply() is a plain projection, for batch and stream."""

    parsers: dict[str, str]
    fills: dict[str, object]
    fences: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, k: float = 3.0) -> Cleaner:
        """Numbers and dates when 90 percent parse, booleans when all do; medians, modes and fences of k interquartile ranges."""
        text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        parsers = {}
        if text:
            for r in parse_share(df, text).collect():
                parsers[r["column"]] = "boolean" if r["boolean"] == 1 else "number" if r["number"] >= 0.9 else "date" if r["date"] >= 0.9 else "text"
        parsed = cls(parsers, {}, {})._parsed(df)
        numbers = [f.name for f in parsed.schema.fields if isinstance(f.dataType, T.NumericType)]
        fills: dict[str, object] = {}
        fences = {}
        if numbers:
            q = parsed.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in numbers]).first()
            for c in numbers:
                if q[c]:
                    a, m, b = q[c]
                    fills[c], fences[c] = m, (a - k * (b - a), b + k * (b - a))
        for f in parsed.schema.fields:
            if isinstance(f.dataType, (T.StringType, T.BooleanType)):
                top = parsed.where(F.col(f.name).isNotNull()).groupBy(f.name).count().orderBy(F.desc("count"), f.name).limit(1).collect()
                if top:
                    fills[f.name] = top[0][0]
        return cls(parsers, fills, fences)

    def _parsed(self, df: DataFrame) -> DataFrame:
        cols = []
        for f in df.schema.fields:
            c = F.col(f.name)
            kind = self.parsers.get(f.name)
            if kind is not None:
                c = na_to_null(c)
                c = {"number": parse_number, "boolean": parse_bool, "date": lambda x: x.try_cast("timestamp"), "text": lambda x: x}[kind](c)
            cols.append(c.alias(f.name))
        return df.select(*cols)

    def apply(self, df: DataFrame, clip: bool = True) -> DataFrame:
        """Parsed, filled, clipped; names cleaned."""
        parsed = self._parsed(df)
        cols = []
        for f in parsed.schema.fields:
            c = F.col(f.name)
            if self.fills.get(f.name) is not None:
                c = F.coalesce(c, F.lit(self.fills[f.name]).cast(f.dataType))
            if clip and f.name in self.fences:
                a, b = self.fences[f.name]
                c = F.least(F.greatest(c.cast("double"), F.lit(a)), F.lit(b)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c
            cols.append(c.alias(f.name))
        return parsed.select(*cols).toDF(*clean_names(parsed.columns))


@dataclass
class Schema:
    """Rules of a table's columns: type, nullability, range, allowed values."""

    columns: dict[str, dict]

    @classmethod
    def infer(cls, df: DataFrame, categories: int = 50) -> Schema:
        """From the types and one pass of statistics."""
        out: dict[str, dict] = {}
        aggs = []
        for f in df.schema.fields:
            out[f.name] = {"type": f.dataType.simpleString()}
            aggs.append(F.count(F.when(F.col(f.name).isNull(), 1)).alias(f"n_{f.name}"))
            if isinstance(f.dataType, T.NumericType):
                aggs += [F.min(f.name).alias(f"lo_{f.name}"), F.max(f.name).alias(f"hi_{f.name}")]
            if isinstance(f.dataType, T.StringType):
                aggs.append(F.count_distinct(f.name).alias(f"k_{f.name}"))
        one = df.agg(*aggs).first().asDict()
        for name, spec in out.items():
            spec["nullable"] = one[f"n_{name}"] > 0
            if one.get(f"lo_{name}") is not None:
                spec["min"], spec["max"] = one[f"lo_{name}"], one[f"hi_{name}"]
            if 0 < one.get(f"k_{name}", 0) <= categories:
                spec["allowed"] = sorted(r[0] for r in df.select(name).where(F.col(name).isNotNull()).distinct().collect())
        return cls(out)

    def to_json(self) -> str:
        """The rules as text."""
        return json.dumps(self.columns, default=str, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Schema:
        """The inverse of to_json()."""
        return cls(json.loads(text))

    def validate(self, df: DataFrame) -> DataFrame:
        """(column, problem, n): absent, extra, type, null, below, above, not_allowed; one pass for all rows' rules."""
        fixed, aggs, names = [], [], []
        for name, s in self.columns.items():
            if name not in df.columns:
                fixed.append((name, "absent", 1))
                continue
            if df.schema[name].dataType.simpleString() != s["type"]:
                fixed.append((name, "type", 1))
            tests = [] if s.get("nullable", True) else [("null", F.col(name).isNull())]
            tests += [(kind, test(F.col(name), s[key])) for key, kind, test in (("min", "below", lambda c, v: c < v), ("max", "above", lambda c, v: c > v)) if key in s]
            if "allowed" in s:
                tests.append(("not_allowed", ~F.col(name).isin(s["allowed"])))
            for kind, test in tests:
                names.append((name, kind))
                aggs.append(F.count(F.when(test, 1)).alias(f"x{len(aggs)}"))
        fixed += [(c, "extra", 1) for c in df.columns if c not in self.columns]
        spark = df.sparkSession
        out = spark.createDataFrame(fixed, "column string, problem string, n long")
        if aggs:
            cells = ", ".join(f"'{c}', '{k}', x{i}" for i, (c, k) in enumerate(names))
            out = out.unionByName(df.agg(*aggs).select(F.expr(f"stack({len(names)}, {cells}) as (column, problem, n)")).where("n > 0"))
        return out

    def enforce(self, df: DataFrame, extra: str = "drop") -> DataFrame:
        """Columns in order, cast where they can be (else null); absent ones are null; extra ones go or stay at the end."""
        cols = []
        for name, s in self.columns.items():
            if name not in df.columns:
                cols.append(F.lit(None).cast(s["type"]).alias(name))
            elif s["type"] == "boolean" and isinstance(df.schema[name].dataType, T.StringType):
                cols.append(parse_bool(F.col(name)).alias(name))
            else:
                cols.append(F.col(name).try_cast(s["type"]).alias(name))
        return df.select(*cols, *[c for c in df.columns if c not in self.columns and extra == "keep"])


def guard(schema: Schema):
    """Decorator: the first argument that is a DataFrame is enforced."""

    def outer(f):
        @wraps(f)
        def inner(*args, **kwargs):
            done, out = False, []
            for a in args:
                if isinstance(a, DataFrame) and not done:
                    a, done = schema.enforce(a), True
                out.append(a)
            return f(*out, **kwargs)

        return inner

    return outer


def split(df: DataFrame, key: list[str], test: float = 0.2, val: float = 0.1, seed: int = 0) -> DataFrame:
    """df with split (train, val, test): all rows of one key land on one side, by a hash of the key; needs no shuffle."""
    u = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]), F.lit(1_000_000)) / 1_000_000
    return df.withColumn("split", F.when(u < test, "test").when(u < test + val, "val").otherwise("train"))


def time_split(df: DataFrame, time: str, test: float = 0.2, val: float = 0.1) -> DataFrame:
    """df with split by time: the last share is test, the one before it val; equal times stay together."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    a, b = df.agg(F.percentile(t, F.array(F.lit(1 - test - val), F.lit(1 - test)))).first()[0]
    return df.withColumn("split", F.when(t > b, "test").when(t > a, "val").otherwise("train"))


def split_report(df: DataFrame, key: list[str], columns: list[str], target: str | None = None) -> DataFrame:
    """One row: rows, keys on more than one side, equal rows on more than one side."""
    sides = df.groupBy(*key).agg(F.count_distinct("split").alias("n"))
    rows = df.groupBy(*columns).agg(F.count_distinct("split").alias("n"))
    a = sides.agg(F.count(F.when(F.col("n") > 1, 1)).alias("leaking_keys"), F.count(F.lit(1)).alias("keys"))
    b = rows.agg(F.count(F.when(F.col("n") > 1, 1)).alias("leaking_rows"))
    return a.join(F.broadcast(b))  # one row each


def linked_groups(df: DataFrame, id_columns: list[str], row: str) -> DataFrame:
    """(row, group): rows that share any id, directly or through others."""
    from siltstone.operators.graph import components

    ids = df.select(row, F.explode(F.array(*[F.concat(F.lit(f"{i}:"), F.col(c).cast("string")) for i, c in enumerate(id_columns)])).alias("k")).where("k is not null")
    hub = ids.groupBy("k").agg(F.min(row).alias("hub"))
    pairs = ids.join(hub, "k").select(F.col(row).alias("a"), F.col("hub").alias("b"))
    roots = components(pairs)
    return df.select(F.col(row).alias("row")).join(roots, F.col("row") == F.col("node"), "left").select("row", F.coalesce("root", "row").alias("group"))


def loo_mapping_accuracy(df: DataFrame, feature: str, target: str) -> DataFrame:
    """Accuracy of guessing the commonest other target of a feature's value, each row left out of its own guess."""
    cells = df.where(F.col(feature).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(feature).alias("f"), F.col(target).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("f").orderBy(F.col("n").desc(), "t")
    ranked = cells.withColumn("r", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("n").over(w), F.lit(0)))
    # A row of the leading class is right if the class still leads without it.
    right = F.when((F.col("r") == 1) & (F.col("n") - 1 > F.col("second") - 0), F.col("n")).otherwise(0)
    return ranked.agg((F.sum(right) / F.sum("n")).alias("accuracy"))


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """df with rank: average rank of equal values, from counts of distinct values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    ranked = counts.withColumn("rank", F.sum("_n").over(Window.orderBy(column)) - (F.col("_n") - 1) / 2).drop("_n")
    return df.join(ranked, column, "left")


class Synthesizer:
    """Gaussian copula: normal scores' correlation (one aggregation), sampled rows through the columns' quantiles."""

    def __init__(self, columns: list[str], quantiles: dict[str, list], correlation: list[list[float]], categories: dict[str, list[tuple]]) -> None:
        self.columns, self.quantiles, self.correlation, self.categories = columns, quantiles, correlation, categories

    @classmethod
    def fit(cls, df: DataFrame, numbers: list[str], categories: list[str] = (), points: int = 200) -> Synthesizer:
        """Quantiles at ``points`` places of each number, shares of each category, correlation of the numbers' normal scores."""
        import numpy as np

        grid = F.array(*[F.lit(i / points) for i in range(points + 1)])
        q = df.agg(*[F.percentile(c, grid).alias(c) for c in numbers]).first().asDict()
        scored = df.dropna(subset=list(numbers))
        for c in numbers:
            edges = F.array(*[F.lit(float(x)) for x in q[c]])
            place = F.size(F.filter(edges, lambda e: e <= F.col(c))) / (points + 2)
            scored = scored.withColumn(f"_z{c}", _probit(F.greatest(F.lit(0.002), F.least(F.lit(0.998), place))))
        pairs = [(i, j) for i in range(len(numbers)) for j in range(i)]
        r = np.eye(len(numbers))
        if pairs:
            one = scored.agg(*[F.corr(f"_z{numbers[i]}", f"_z{numbers[j]}").alias(f"r{i}_{j}") for i, j in pairs]).first()
            for i, j in pairs:
                r[i, j] = r[j, i] = one[f"r{i}_{j}"] or 0.0
        values, vectors = np.linalg.eigh(r)
        r = vectors @ np.diag(np.maximum(values, 1e-8)) @ vectors.T
        d = np.sqrt(np.diag(r))
        cats = {c: [(x[0], x[1]) for x in df.groupBy(c).count().orderBy(F.desc("count"), c).limit(1000).collect()] for c in categories}
        return cls(list(numbers), q, (r / np.outer(d, d)).tolist(), cats)

    def sample(self, spark, n: int, seed: int = 0) -> DataFrame:
        """n rows; each partition draws from its own stream of random numbers, so the rows don't depend on the cluster."""
        import numpy as np
        import pandas as pd

        low = np.linalg.cholesky(np.array(self.correlation) + 1e-9 * np.eye(len(self.columns)))
        columns, quantiles, cats = self.columns, self.quantiles, self.categories

        def run(batches):
            from statistics import NormalDist

            cdf = np.vectorize(NormalDist().cdf)
            for b in batches:
                rng = np.random.default_rng([seed, int(b["id"].iloc[0])])
                u = cdf(rng.standard_normal((len(b), len(columns))) @ low.T) if columns else np.zeros((len(b), 0))
                out = {c: np.interp(u[:, i], np.linspace(0, 1, len(quantiles[c])), quantiles[c]) for i, c in enumerate(columns)}
                for c, items in cats.items():
                    w = np.array([x[1] for x in items], float)
                    out[c] = [items[k][0] for k in rng.choice(len(items), len(b), p=w / w.sum())]
                yield pd.DataFrame(out)

        schema = ", ".join([f"`{c}` double" for c in columns] + [f"`{c}` string" for c in cats])
        return spark.range(n).mapInPandas(run, schema)


def _probit(p: Column) -> Column:
    """Inverse of the normal distribution function, by Hastings' rational approximation (fixed values)."""
    q = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.ln(q))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(p < 0.5, -z).otherwise(z)


def fidelity(real: DataFrame, synthetic: DataFrame, numbers: list[str], categories: list[str] = ()) -> DataFrame:
    """(column, kind, distance): Kolmogorov-Smirnov for numbers, total variation for categories."""
    from siltstone.operators.drift import _shares, ks_statistic

    out = None
    for c in numbers:
        one = ks_statistic(real, synthetic, c).select(F.lit(c).alias("column"), F.lit("ks").alias("kind"), F.col("ks").alias("distance"))
        out = one if out is None else out.unionByName(one)
    for c in categories:
        s = _shares(real, synthetic, F.col(c).cast("string"))
        tvd = s.agg((F.sum(F.abs(F.col("r") / F.col("rn") - F.col("c") / F.col("cn"))) / 2).alias("distance"))
        one = tvd.select(F.lit(c).alias("column"), F.lit("tvd").alias("kind"), "distance")
        out = one if out is None else out.unionByName(one)
    return out
