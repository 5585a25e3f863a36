"""Dataset health: findings about a table as a DataFrame, one row per finding."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.profile import profile_columns

#: Fixed values of the findings: penalty points by kind and severity, and grades.
PENALTIES = {
    "critical": 15.0,
    "warning": 5.0,
    "info": 0.5,
}
#: A sketch is off by at most one rank in ACCURACY; bounds of quartiles lie MARGIN times as far off.
ACCURACY, MARGIN = 20_000, 4
GRADES = [(90, "A"), (75, "B"), (50, "C"), (0, "D")]


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def missing_findings(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """column, share and severity of missing values: over half is critical, from 5 percent a warning, else info."""
    p = (profile or profile_columns(df)).where("n_missing > 0")
    share = F.col("n_missing") / F.col("n_rows")
    severity = F.when(share > 0.5, "critical").when(share >= 0.05, "warning").otherwise("info")
    return p.select("column", share.alias("share"), severity.alias("severity"))


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: rows, rows beyond the first of equal ones, their share."""
    counts = df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    total, extra = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return counts.agg(total.alias("n_rows"), extra.alias("n_duplicates")).select(
        "n_rows", "n_duplicates", (F.col("n_duplicates") / F.greatest("n_rows", F.lit(1))).alias("share")
    )


def constant_findings(df: DataFrame, near: float = 0.99, profile: DataFrame | None = None) -> DataFrame:
    """Columns with one value, or whose commonest value holds more than ``near`` of the known rows."""
    p = (profile or profile_columns(df)).withColumn("known", F.col("n_rows") - F.col("n_missing")).where("known > 0")
    share = F.col("top_count") / F.col("known")
    kind = F.when(F.col("n_unique") == 1, "constant").when(share > near, "near_constant")
    return p.select("column", kind.alias("kind"), share.alias("top_share")).where("kind is not null")


def cardinality_findings(df: DataFrame, unique: float = 0.98, categories: int = 50, profile: DataFrame | None = None) -> DataFrame:
    """Columns that look like row ids (share of distinct values) or have too many categories (text only)."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    p = (profile or profile_columns(df)).withColumn("known", F.col("n_rows") - F.col("n_missing")).where("known > 0")
    ratio = F.col("n_unique") / F.col("known")
    kind = F.when(ratio > unique, "id_like").when((F.col("n_unique") > categories) & F.col("column").isin(text), "high_cardinality")
    return p.select("column", kind.alias("kind"), "n_unique", ratio.alias("unique_ratio")).where("kind is not null")


def quartiles(df: DataFrame, columns: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """Each numeric column's quartiles by linear interpolation, exactly, in three reads.

    Sketches bound the ranks asked for, and only values between the bounds (a few in ACCURACY) are counted one by one:
    counting all values of a column takes room for each distinct one.
    """
    v = [F.col(f"`{c}`").cast("double") for c in columns]
    step = MARGIN / ACCURACY
    first = df.agg(*[F.percentile_approx(x, [0.25 - step, 0.25 + step, 0.75 - step, 0.75 + step], ACCURACY).alias(f"b{i}") for i, x in enumerate(v)], *[F.count(x).alias(f"n{i}") for i, x in enumerate(v)]).first()
    full = [i for i in range(len(v)) if first[f"n{i}"]]
    if not full:
        return {c: (None, None) for c in columns}
    # Of a small column all values are counted: its ranks lie next to the bounds.
    spans = {}
    for i in full:
        n, b = first[f"n{i}"], first[f"b{i}"]
        spans[i] = [(b[0], b[1]), (b[2], b[3])] if n >= ACCURACY else [(None, None)] * 2
    inside = lambda i, s: F.lit(True) if spans[i][s][0] is None else (v[i] >= spans[i][s][0]) & (v[i] <= spans[i][s][1])
    below = df.agg(*[(F.lit(0) if spans[i][s][0] is None else F.count_if(v[i] < spans[i][s][0])).alias(f"{i} {s}") for i in full for s in (0, 1)]).first()
    cells = [F.when(v[i].isNotNull() & inside(i, s), F.struct(F.lit(i).alias("i"), F.lit(s).alias("s"), v[i].alias("x"))) for i in full for s in (0, 1)]
    near = df.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.i", "c.s", "c.x").agg(F.count(F.lit(1)).alias("n"))
    upto = near.withColumn("upto", F.sum("n").over(Window.partitionBy("i", "s").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    at = {(i, s): (first[f"n{i}"] - 1) * (0.25, 0.75)[s] for i in full for s in (0, 1)}
    asked = [(i, s, rank + 1 - below[f"{i} {s}"]) for (i, s), p in at.items() for rank in {math.floor(p), math.ceil(p)}]
    ranks = df.sparkSession.createDataFrame(asked, "i int, s int, rank long")  # four rows a column at most
    found = {(r["i"], r["s"], r["rank"]): r["x"] for r in upto.join(F.broadcast(ranks), ["i", "s"]).where("upto >= rank and upto - n < rank").collect()}
    out: dict[str, tuple[float | None, float | None]] = {c: (None, None) for c in columns}
    for i in full:
        ends = []
        for s in (0, 1):
            p = at[i, s]
            low, high = (found[i, s, rank + 1 - below[f"{i} {s}"]] for rank in (math.floor(p), math.ceil(p)))
            ends.append(low if low == high or p == math.floor(p) else (math.ceil(p) - p) * low + (p - math.floor(p)) * high)
        out[columns[i]] = (ends[0], ends[1])
    return out


def iqr_outliers(df: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    """Per numeric column: quartiles (linear interpolation), fences, rows outside and their share."""
    found = quartiles(df, columns)
    asked = []
    for i, c in enumerate(columns):
        v, (low, high) = F.col(f"`{c}`").cast("double"), (F.lit(q).cast("double") for q in found[c])
        outside = (v < low - k * (high - low)) | (v > high + k * (high - low))
        asked += [F.first(low).alias(f"low{i}"), F.first(high).alias(f"high{i}"), F.count(v).alias(f"n{i}"), F.count_if(outside).alias(f"out{i}")]
    cells = [[f"{name}{i}" for i in range(len(columns))] for name in ("low", "high", "out", "n")]
    long = df.agg(*asked).select(F.expr(_stack(columns, *cells, ["column", "q1", "q3", "n_outliers", "n"])))
    return long.select("column", "q1", "q3", "n_outliers", (F.col("n_outliers") / F.nullif("n", F.lit(0))).alias("share"))


def _stack(columns: list[str], *rest) -> str:
    values, names = rest[:-1], rest[-1]
    cells = ", ".join(", ".join([f"'{c}'", *[v[i] for v in values]]) for i, c in enumerate(columns))
    return f"stack({len(columns)}, {cells}) as ({', '.join(names)})"


def skewness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bias-corrected skewness of each column."""

    def corrected(c: str) -> Column:
        n = F.count(c)
        return F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)

    wide = df.agg(*[corrected(c).alias(c) for c in columns])
    return wide.select(F.expr(_stack(columns, [f"`{c}`" for c in columns], ["column", "skew"])))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair of columns over rows where both are known, and the number of those rows."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(
        *[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)],
        *[F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n{i}") for i, (a, b) in enumerate(pairs)],
    )
    cells = ", ".join(f"'{a}', '{b}', r{i}, n{i}" for i, (a, b) in enumerate(pairs))
    return wide.select(F.expr(f"stack({len(pairs)}, {cells}) as (a, b, r, n)"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts n of each pair of values, with the totals na, nb and of."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    total = cells.agg(F.sum("n").alias("of"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"))
    return cells.join(rows, "a").join(cols, "b").join(F.broadcast(total))  # one row of totals


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Bias-corrected Cramer's V of two columns, with chi-square; absent cells count through n^2/(na nb)."""
    t = contingency(df, a, b)
    one = t.agg(
        (F.max("of") * (F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))) - 1)).alias("chi2"),
        F.max("of").alias("of"), F.max("ka").alias("ka"), F.max("kb").alias("kb"),
    )
    phi = F.greatest(F.lit(0.0), F.col("chi2") / F.col("of") - (F.col("ka") - 1) * (F.col("kb") - 1) / (F.col("of") - 1))
    ra, rb = (F.col(x) - (F.col(x) - 1) * (F.col(x) - 1) / (F.col("of") - 1) for x in ("ka", "kb"))
    return one.select("chi2", F.sqrt(phi / (F.least(ra, rb) - 1)).alias("v"))


def mapping_purity(df: DataFrame, feature: str, target: str) -> DataFrame:
    """How far a value of ``feature`` decides ``target``: purity, and that of always guessing the commonest class."""
    cells = df.where(F.col(feature).isNotNull() & F.col(target).isNotNull()).groupBy(feature, target).agg(F.count(F.lit(1)).alias("n"))
    best = cells.groupBy(feature).agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    purity = best.agg((F.sum("best") / F.sum("n")).alias("purity"))
    base = cells.groupBy(target).agg(F.sum("n").alias("n")).agg((F.max("n") / F.sum("n")).alias("baseline"))
    return purity.join(F.broadcast(base))  # one row each


def correlation_ratio(df: DataFrame, category: str, value: str) -> DataFrame:
    """eta: share of a value's variance that lies between categories, as a root."""
    known = df.where(F.col(category).isNotNull() & F.col(value).isNotNull())
    g = known.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")
    total = F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")
    return g.agg(F.sqrt(F.greatest(F.lit(0.0), between / total)).alias("eta"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Classes, the smallest one's share and the severity of the imbalance."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(F.count(F.lit(1)).alias("n_classes"), (F.min("n") / F.sum("n")).alias("minority"))
    severity = F.when((F.col("n_classes") == 1) | (F.col("minority") < 0.01), "critical").when(F.col("minority") < 0.1, "warning").otherwise("ok")
    return one.select("n_classes", "minority", severity.alias("severity"))


def best_stump(df: DataFrame, value: str, target: str) -> DataFrame:
    """Best balanced accuracy of one threshold on ``value`` for a 0/1 target, over all distinct values.

    Values are counted first; the running sums go over distinct values, range by range.
    """
    counts = df.where(F.col(value).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(value).alias("v")).agg(
        F.sum(F.col(target).cast("long")).alias("p"), F.sum(1 - F.col(target).cast("long")).alias("q")
    )
    lo, hi = counts.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        return counts.select(F.lit(None).cast("double").alias("balanced_accuracy")).limit(0)
    width = max((float(hi) - float(lo)) / 256, 1e-300)
    binned = counts.withColumn("bin", F.least(F.floor((F.col("v").cast("double") - float(lo)) / width), F.lit(255)).cast("int"))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy("bin").agg(F.sum("p").alias("bp"), F.sum("q").alias("bq")).select(
        "bin", F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("bq").over(before), F.lit(0)).alias("q0")
    )  # at most 256 rows
    total = counts.agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
    inside = Window.partitionBy("bin").orderBy("v")
    cut = binned.join(F.broadcast(bins), "bin").join(F.broadcast(total)).select(
        ((F.sum("p").over(inside) + F.col("p0")) / F.col("np")).alias("tp"), ((F.sum("q").over(inside) + F.col("q0")) / F.col("nq")).alias("fp")
    )
    return cut.agg(F.max(F.greatest(0.5 + (F.col("tp") - F.col("fp")) / 2, 0.5 - (F.col("tp") - F.col("fp")) / 2)).alias("balanced_accuracy"))


def findings(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All findings of a table: kind, column, severity, value."""
    columns = columns or df.columns
    part = df.select(*columns)
    numeric = [c for c in numeric_columns(part)]
    profile = profile_columns(part).checkpoint()  # a row for each column; three kinds of findings read it
    out = missing_findings(part, profile).select(F.lit("missing").alias("kind"), "column", "severity", F.col("share").alias("value"))
    dup = duplicate_rows(part).where("n_duplicates > 0")
    severity = F.when(F.col("share") >= 0.2, "critical").when(F.col("share") >= 0.01, "warning").otherwise("info")
    out = out.unionByName(dup.select(F.lit("duplicates").alias("kind"), F.lit(None).cast("string").alias("column"), severity.alias("severity"), F.col("share").alias("value")))
    out = out.unionByName(constant_findings(part, profile=profile).select("kind", "column", F.lit("warning").alias("severity"), F.col("top_share").alias("value")))
    out = out.unionByName(cardinality_findings(part, profile=profile).select("kind", "column", F.lit("info").alias("severity"), F.col("unique_ratio").alias("value")))
    if numeric:
        o = iqr_outliers(part, numeric).where("share > 0.05")
        out = out.unionByName(o.select(F.lit("outliers").alias("kind"), "column", F.lit("warning").alias("severity"), F.col("share").alias("value")))
        s = skewness(part, numeric).where("abs(skew) > 3")
        out = out.unionByName(s.select(F.lit("skew").alias("kind"), "column", F.lit("info").alias("severity"), F.col("skew").alias("value")))
    if len(numeric) > 1:
        c = correlations(part, numeric).where("abs(r) > 0.9")
        out = out.unionByName(c.select(F.lit("correlation").alias("kind"), F.concat_ws(",", "a", "b").alias("column"), F.lit("warning").alias("severity"), F.col("r").alias("value")))
    return out


def health_score(found: DataFrame) -> DataFrame:
    """One row: score (100 less the findings' penalties, 0 at least), grade and the number of findings."""
    points = F.create_map(*[F.lit(x) for k, v in PENALTIES.items() for x in (k, v)])
    one = found.agg(F.coalesce(F.sum(points[F.col("severity")]), F.lit(0.0)).alias("lost"), F.count(F.lit(1)).alias("n_findings"))
    score = F.greatest(F.lit(0.0), 100 - F.col("lost"))
    grade = F.lit(GRADES[-1][1])
    for least, name in reversed(GRADES):
        grade = F.when(score >= least, name).otherwise(grade)
    return one.select(score.alias("score"), grade.alias("grade"), "n_findings")


def column_kinds(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per text column: shares of known values that read as numbers and as dates."""
    cells = [F.struct(F.lit(c).alias("column"), F.trim(F.col(c)).alias("v")) for c in columns]
    long = df.select(F.explode(F.array(*cells)).alias("s")).select("s.*").where("v is not null and v <> ''")
    number = F.expr("try_cast(v as double)").isNotNull()
    date = F.col("v").rlike(r"^\d{4}-\d{2}-\d{2}") & F.expr("try_cast(v as timestamp)").isNotNull()
    return long.groupBy("column").agg(
        F.avg(number.cast("double")).alias("number_share"), F.avg(date.cast("double")).alias("date_share"), F.count(F.lit(1)).alias("n")
    )


