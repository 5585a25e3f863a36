"""Checks of the columns of a training table: dead, redundant, identifying, leaking and useless ones, over all rows.

All columns are profiled in one aggregation of (column, value) and one of numbers; all pairs are
correlated from one set of sums of products; shallow trees of single columns are fitted on one
half of the rows, told apart by a hash, and scored on the other, from counts of classes in
quantile bins that one aggregation gives for all columns. Only counts whose number is bounded by
columns, bins and classes leave Spark.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.linear import gram
from siltstone.operators.models import BACKGROUND, Inputs, _is_number, _number
from siltstone.operators.splits import as_text

#: Quantile bins of a number; most classes of a target; depth of a single column's tree.
BINS, CLASSES, DEPTH = 512, 1000, 3
SEVERITIES = ("high", "medium", "low")

# Words of a column's name that mark bookkeeping, and what they are called (fixed values).
NAME_WORDS = {
    "id": "id", "ids": "id", "uuid": "uuid", "guid": "uuid", "index": "index", "idx": "index", "key": "key", "timestamp": "timestamp",
    "row": "row", "rownum": "row", "rowid": "row", "rownumber": "row", "unnamed": "unnamed",
}
# Words that with "id" behind them name an identifier (fixed values).
GLUED = [
    "user", "customer", "cust", "client", "account", "acct", "session", "order", "item", "product", "record", "txn", "transaction", "event", "device",
    "member", "employee", "emp", "patient", "student", "obj", "object", "entity", "doc", "document", "msg", "message", "ticket", "invoice", "shipment",
    "vehicle", "visitor", "subscriber", "merchant", "store", "shop", "trip", "ride", "booking", "reservation", "loan", "policy", "claim", "case", "lead",
    "contact", "company", "org", "vendor", "supplier", "payment", "card", "house", "listing", "property", "tenant", "driver", "passenger", "flight",
    "node", "job", "task", "run", "batch", "file", "image", "video", "article", "post", "thread", "comment", "review", "campaign", "click", "request",
    "trace", "span", "sample", "person",
]
DATE_FORMATS = ["d/M/yyyy", "M/d/yyyy", "d.M.yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy/M/d"]


def suspicious_name(name: str) -> str | None:
    """What a column's name says of an identifier or of bookkeeping: id, uuid, index, key, timestamp, row, unnamed; else None."""
    for word in re.split(r"[^A-Za-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", str(name)).lower()):
        if word in NAME_WORDS:
            return NAME_WORDS[word]
    glued = re.sub(r"[^a-z0-9]", "", str(name).lower())
    return "id" if glued.endswith("id") and glued[:-2] in GLUED else None


@dataclass
class Finding:
    kind: str
    severity: str
    message: str
    detail: dict


@dataclass
class FeatureReport:
    """``features``: findings by column; ``drop``: columns with one of severity high or medium, worst first; ``keep``: the others."""

    features: dict[str, list[Finding]]
    notes: list[str]
    n_rows: int
    target: str | None
    drop: list[str] = field(default_factory=list)
    keep: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        for found in self.features.values():
            found.sort(key=lambda f: SEVERITIES.index(f.severity))
        bad = {c: f[0].severity for c, f in self.features.items() if f and f[0].severity != "low"}
        self.drop = sorted(bad, key=lambda c: SEVERITIES.index(bad[c]))  # stable: the table's order within a severity
        self.keep = [c for c in self.features if c not in bad]

    def rows(self) -> list[tuple[str, str, str, str | None]]:
        """(column, kind, severity, other column) of every finding."""
        return [(c, f.kind, f.severity, f.detail.get("other")) for c, found in self.features.items() for f in found]


def tree_predictions(counts: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The class that a tree over ordered bins says for each, from the classes' counts (bins x classes); least Gini impurity."""
    said = np.full(len(counts), int(counts.sum(axis=0).argmax()))
    total = counts.sum(axis=0)
    if depth == 0 or len(counts) < 2 or (total > 0).sum() < 2:
        return said
    left = np.cumsum(counts, axis=0)[:-1]
    right = total - left
    n, m = left.sum(axis=1), right.sum(axis=1)
    ok = (n > 0) & (m > 0)
    if not ok.any():
        return said
    with np.errstate(invalid="ignore", divide="ignore"):
        pure = np.where(ok, (left**2).sum(axis=1) / n + (right**2).sum(axis=1) / m, -np.inf)
    cut = int(pure.argmax()) + 1
    return np.concatenate([tree_predictions(counts[:cut], depth - 1), tree_predictions(counts[cut:], depth - 1)])


def tree_means(n: np.ndarray, s: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The number that a tree over ordered bins says for each, from the bins' rows and sums; least squared error."""
    said = np.full(len(n), s.sum() / max(n.sum(), 1))
    if depth == 0 or len(n) < 2:
        return said
    a, b = np.cumsum(n)[:-1], np.cumsum(s)[:-1]
    c, d = n.sum() - a, s.sum() - b
    ok = (a > 0) & (c > 0)
    if not ok.any():
        return said
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = np.where(ok, b * b / a + d * d / c, -np.inf)
    if gain.max() <= s.sum() ** 2 / n.sum() * (1 + 1e-12):
        return said
    cut = int(gain.argmax()) + 1
    return np.concatenate([tree_means(n[:cut], s[:cut], depth - 1), tree_means(n[cut:], s[cut:], depth - 1)])


class FeatureChecker:
    """Checks every column but the target; see ``check``.

    model_rows: rows, picked by a hash of their content, that the forest of the importance check learns from and is tested
    on; all other checks take all rows. model_categories: text columns with more values are left out of that check and of
    Cramer's V.
    """

    def __init__(self, correlation: float = 0.95, missing: float = 0.6, cardinality: float = 0.98, near_constant: float = 0.99, leak_score: float = 0.99, leak_correlation: float = 0.95, id_rows: int = 20, correlation_rows: int = 20, model_rows: int = 20_000, model_categories: int = 100, seed: int = 0) -> None:
        for name, value in (("correlation", correlation), ("missing", missing), ("cardinality", cardinality), ("near_constant", near_constant), ("leak_score", leak_score), ("leak_correlation", leak_correlation)):
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 < value <= 1:
                raise ValueError(f"{name} must be above 0 and at most 1")
        self.correlation, self.missing, self.cardinality, self.near_constant = correlation, missing, cardinality, near_constant
        self.leak_score, self.leak_correlation, self.id_rows, self.correlation_rows = leak_score, leak_correlation, id_rows, correlation_rows
        self.model_rows, self.model_categories, self.seed = model_rows, model_categories, seed

    def check(self, df: DataFrame, target: str | None = None) -> FeatureReport:
        low = [c.lower() for c in df.columns]
        if len(set(low)) < len(low):
            raise ValueError(f"columns of one name: {sorted({c for c in low if low.count(c) > 1})}")
        if target is not None and target not in df.columns:
            raise ValueError(f"no column {target}")
        columns = [c for c in df.columns if c != target]
        self.found: dict[str, list[Finding]] = {c: [] for c in columns}
        self.notes: list[str] = []
        self.n = df.count()
        if not columns or not self.n:
            self.notes.append("there is no column to check" if self.n else "the table has no rows; every check was skipped")
            return FeatureReport(self.found, self.notes, self.n, target)
        self._profile(df, columns)
        constant = self._basics(columns)
        live = [c for c in columns if c not in constant]
        dates = self._dates(df, live)
        ids = self._ids(live, dates)
        for c in live:
            word = suspicious_name(c)
            if word:
                self._add(c, "suspicious_name", "low", f"the name contains {word}: usually an identifier or bookkeeping", token=word)
        copies = self._copies(df, live)
        rest = [c for c in live if c not in copies]
        self._numeric_pairs(df, [c for c in rest if self.numeric[c]])
        self._text_pairs(df, [c for c in rest if not self.numeric[c] and c not in ids])
        if target is not None:
            self._target(df, target, rest, ids)
        return FeatureReport(self.found, self.notes, self.n, target)

    def _add(self, column: str, kind: str, severity: str, message: str, **detail) -> None:
        self.found[column].append(Finding(kind, severity, message, detail))

    def _profile(self, df: DataFrame, columns: list[str]) -> None:
        """Distinct values, the commonest, range and a signature of each column."""
        self.numeric = {c: _is_number(df, c) for c in columns}
        self.times = {c for c in columns if isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))}
        self.value = {c: _number(df, c) if self.numeric[c] else as_text(df, c) for c in columns}
        cells = [F.struct(F.lit(k).alias("k"), self.value[c].cast("string").alias("v")) for k, c in enumerate(columns)]
        long = df.select(F.explode(F.array(*cells)).alias("s")).select("s.*").where("v is not null")
        counts = long.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("k").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("known"), F.max(F.struct("n", "v")).alias("top")).collect()  # a row for each column
        self.values, self.known, self.top = dict.fromkeys(columns, 0), dict.fromkeys(columns, 0), dict.fromkeys(columns, (0, None))
        for r in best:
            c = columns[r["k"]]
            self.values[c], self.known[c], self.top[c] = r["values"], r["known"], (r["top"]["n"], r["top"]["v"])
        # Equal columns have equal signatures: sums over the rows of a hash of the value and of the whole row.
        row = F.xxhash64(*[self.value[c] for c in columns])
        asked = []
        for k, c in enumerate(columns):
            asked.append(F.sum(F.xxhash64(F.coalesce(self.value[c].cast("string"), F.lit("")), self.value[c].isNull(), row).cast("decimal(38,0)")).alias(f"s{k}"))
            if self.numeric[c]:
                asked += [F.min(self.value[c]).alias(f"l{k}"), F.max(self.value[c]).alias(f"h{k}"), F.max(F.abs(self.value[c] % 1)).alias(f"f{k}")]
        one = df.agg(*asked).first()
        self.signature = {c: one[f"s{k}"] for k, c in enumerate(columns)}
        self.span = {c: (one[f"l{k}"], one[f"h{k}"]) for k, c in enumerate(columns) if self.numeric[c]}
        self.whole = {c: one[f"f{k}"] == 0 for k, c in enumerate(columns) if self.numeric[c]}

    def _basics(self, columns: list[str]) -> set[str]:
        dead = set()
        for c in columns:
            gone = 1 - self.known[c] / self.n
            if self.values[c] <= 1:
                dead.add(c)
                self._add(c, "constant", "high", "every value is missing" if not self.known[c] else f"only one value ({self.top[c][1]})", nunique=self.values[c], missing=gone)
                continue
            if gone > self.missing:
                self._add(c, "high_missing", "high" if gone >= 0.95 else "medium", f"{gone:.1%} of the values are missing", missing=gone)
            share = self.top[c][0] / self.known[c]
            if share > self.near_constant:
                self._add(c, "near_constant", "medium", f"{share:.1%} of the known values are {self.top[c][1]}", share=share, value=self.top[c][1])
        if dead and self.n <= 3 and (self.n == 1 or 2 * len(dead) >= len(columns)):
            self.notes.append(f"only {self.n} row(s): columns look constant for want of rows")
        return dead

    def _dates(self, df: DataFrame, live: list[str]) -> set[str]:
        texts = [c for c in live if not self.numeric[c] and isinstance(df.schema[c].dataType, T.StringType)]
        if not texts:
            return set()
        asked = []
        for k, c in enumerate(texts):
            v = F.trim(F.col(f"`{c}`"))
            shaped = v.rlike(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|[A-Za-z]{3,9}\.?,? +\d{1,4}|\d{1,2} +[A-Za-z]{3,9}")
            read = F.coalesce(F.when(v.rlike(r"^\d{4}-"), v.try_cast("timestamp")), *[F.try_to_timestamp(v, F.lit(f)) for f in DATE_FORMATS])
            hit = F.when(shaped & read.isNotNull(), v)
            asked += [F.count(hit).alias(f"n{k}"), F.min(hit).alias(f"e{k}"), F.count(F.when(v != "", 1)).alias(f"m{k}")]
        one = df.agg(*asked).first()
        dates = {c: one[f"e{k}"] for k, c in enumerate(texts) if one[f"n{k}"] and one[f"n{k}"] >= 0.9 * one[f"m{k}"]}
        for c, example in dates.items():
            self._add(c, "date_as_string", "low", f"text that reads as dates, such as {example}", example=example)
        return set(dates)

    def _ids(self, live: list[str], dates: set[str]) -> set[str]:
        ids = set()
        for c in live:
            ratio = self.values[c] / self.known[c]
            if c in dates or self.known[c] < self.id_rows or ratio <= self.cardinality or (self.numeric[c] and c not in self.times and not self.whole[c]):
                continue
            ids.add(c)
            run = self.numeric[c] and self.span[c][1] - self.span[c][0] + 1 <= 1.05 * self.values[c]
            time = c in self.times
            self._add(c, "id_like", "medium" if time else "high", f"{ratio:.1%} of the known values are distinct" + (", one after another" if run else ""), ratio=ratio, consecutive=bool(run))
        return ids

    def _copies(self, df: DataFrame, live: list[str]) -> set[str]:
        """Columns that equal an earlier one: signatures pick the pairs, one pass compares their values."""
        by: dict[tuple, list[str]] = {}
        for c in live:
            by.setdefault((self.numeric[c], self.values[c], self.known[c], self.signature[c]), []).append(c)
        pairs = [(g[0], c) for g in by.values() for c in g[1:]]
        if not pairs:
            return set()
        one = df.agg(*[F.count(F.when(~self.value[a].eqNullSafe(self.value[b]), 1)) for a, b in pairs]).first()
        same = [(a, b) for (a, b), n in zip(pairs, one) if not n]
        for a, b in same:
            self._add(b, "duplicate_of", "high", f"equal to {a}", other=a)
        return {b for _, b in same}

    def _best_first(self, columns: list[str]) -> list[str]:
        """Columns that nothing speaks against and that miss fewest values come first, so that of a redundant group the best one stays."""
        return sorted(columns, key=lambda c: (any(f.severity != "low" for f in self.found[c]), self.n - self.known[c]))

    def _redundant(self, columns: list[str], measure, method: str) -> None:
        kept: list[str] = []
        for c in self._best_first(columns):
            hit = next(((k, r) for k in kept if (r := measure(k, c)) is not None and abs(r) > self.correlation), None)
            if hit is None:
                kept.append(c)
            else:
                self._add(c, "highly_correlated_with", "medium", f"{method} {hit[1]:+.3f} with {hit[0]}", other=hit[0], corr=hit[1], method=method)

    def _numeric_pairs(self, df: DataFrame, columns: list[str]) -> None:
        if len(columns) < 2:
            return
        sums = gram(df, [self.value[c] for c in columns])
        r = sums.correlations(max(self.correlation_rows, round(0.05 * self.n)))
        at = {c: k for k, c in enumerate(columns)}
        self._redundant(columns, lambda a, b: None if np.isnan(r[at[a], at[b]]) else float(r[at[a], at[b]]), "pearson")

    def _text_pairs(self, df: DataFrame, columns: list[str]) -> None:
        columns = [c for c in columns if 2 <= self.values[c] <= self.model_categories]
        pairs = list(combinations(columns, 2))
        if not pairs:
            return
        cells = [F.struct(F.lit(k).alias("k"), self.value[a].alias("a"), self.value[b].alias("b")) for k, (a, b) in enumerate(pairs)]
        long = df.select(F.explode(F.array(*cells)).alias("s")).select("s.*").where("a is not null and b is not null")
        counts = long.groupBy("k", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
        rows = counts.withColumn("na", F.sum("n").over(Window.partitionBy("k", "a"))).withColumn("nb", F.sum("n").over(Window.partitionBy("k", "b")))
        one = rows.groupBy("k").agg(F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("x"), F.sum("n").alias("n"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb")).collect()
        v = {}
        for r in one:
            n, ka, kb = r["n"], r["ka"], r["kb"]
            if n < 2 or min(ka, kb) < 2:
                continue
            most = min(ka - (ka - 1) ** 2 / (n - 1), kb - (kb - 1) ** 2 / (n - 1)) - 1
            if most > 0:
                v[pairs[r["k"]]] = min(1.0, (max(0.0, r["x"] - 1 - (ka - 1) * (kb - 1) / (n - 1)) / most) ** 0.5)
        self._redundant(columns, lambda a, b: v.get((a, b), v.get((b, a))), "cramers_v")

    def _target(self, df: DataFrame, target: str, columns: list[str], ids: set[str]) -> None:
        number = _is_number(df, target)
        y = _number(df, target) if number else as_text(df, target)
        rows = df.where(y.isNotNull())
        few = rows.select(y.alias("v")).distinct().limit(CLASSES + 1).agg(F.count(F.lit(1)), F.max(F.abs(F.col("v").try_cast("double") % 1))).first()
        used = rows.count()
        if few[0] < 2 or used < 4:
            self.notes.append(f"{target} has one value or fewer than 4 known ones: leakage and importance were not checked")
            return
        classes = not number or isinstance(df.schema[target].dataType, T.BooleanType) or (few[0] <= 20 and few[1] == 0)
        if classes and few[0] > CLASSES:
            self.notes.append(f"{target} has more than {CLASSES} classes: leakage and importance were not checked")
            return
        if used < self.n:
            self.notes.append(f"{self.n - used} rows without a {target} were left out of the leakage and importance checks")
        self.notes.append(f"{target} was taken as {'classes' if classes else 'a number'}")
        rows = rows.withColumn("the target", y.cast("string") if classes else y).withColumn("the fold", F.pmod(F.xxhash64(F.lit(self.seed), *[f"`{c}`" for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]), F.lit(2)).cast("int"))
        numbers = [c for c in columns if self.numeric[c]]
        texts = [c for c in columns if not self.numeric[c]]
        leaks: set[str] = set()
        if not classes and numbers:
            leaks = self._leaks_by_correlation(rows, target, numbers)
        self._leaks_by_tree(rows, target, [c for c in numbers if c not in leaks], classes)
        self._leaks_by_mapping(rows, target, texts, classes)
        self._importance(rows, target, [c for c in columns if c not in ids], classes)

    def _leak(self, column: str, target: str, message: str, score: float, baseline: float) -> None:
        self._add(column, "leakage_suspect", "high", message, target=target, score=score, baseline=baseline)

    def _leaks_by_correlation(self, rows: DataFrame, target: str, numbers: list[str]) -> set[str]:
        """Pearson of values, and of average ranks within quantile bins, with the target's."""
        edges = self._edges(rows, [*numbers, None])
        both = [self.value[c] for c in numbers] + [F.col("the target")]
        binned = [F.when(v.isNotNull(), self._bin(v, edges[c])) for v, c in zip(both, [*numbers, None])]
        plain, ranks = gram(rows, both).correlations(4), gram(rows, binned).correlations(4)
        out = set()
        for k, c in enumerate(numbers):
            best = float(np.nanmax([0.0, abs(plain[k, -1]), abs(ranks[k, -1])]))
            if best > self.leak_correlation:
                out.add(c)
                self._leak(c, target, f"correlates {best:.3f} with {target}", best, 0.0)
        return out

    def _edges(self, rows: DataFrame, columns: list[str | None]) -> dict[str | None, list[float]]:
        """Quantiles that part each column (None: the target) into BINS, in one aggregation of mergeable sketches."""
        marks = [k / BINS for k in range(1, BINS)]
        values = [F.col("the target") if c is None else self.value[c] for c in columns]
        one = rows.agg(*[F.percentile_approx(v, marks, 20 * BINS) for v in values]).first()
        return {c: sorted(set(e or [])) for c, e in zip(columns, one)}

    @staticmethod
    def _bin(value: Column, edges: list[float]) -> Column:
        """The number of edges below a value."""
        return F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e < value))

    def _leaks_by_tree(self, rows: DataFrame, target: str, numbers: list[str], classes: bool) -> None:
        if not numbers:
            return
        edges = self._edges(rows, numbers)
        cells = [F.struct(F.lit(k).alias("k"), F.when(self.value[c].isNotNull(), self._bin(self.value[c], edges[c])).alias("bin")) for k, c in enumerate(numbers)]
        long = rows.select("the fold", "the target", F.explode(F.array(*cells)).alias("s")).select("s.*", F.col("the fold").alias("fold"), F.col("the target").alias("y")).where("bin is not null")
        if classes:
            counts = long.groupBy("k", "fold", "bin", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))

            def score(g: pd.DataFrame) -> pd.DataFrame:
                names, bins = np.unique(g["y"]), int(g["bin"].max()) + 1
                table = np.zeros((2, bins, len(names)))
                np.add.at(table, (g["fold"].to_numpy(), g["bin"].to_numpy(), np.searchsorted(names, g["y"])), g["n"].to_numpy())
                right = sum(table[1 - f][np.arange(bins), tree_predictions(table[f])].sum() for f in (0, 1))
                n = table.sum()
                return pd.DataFrame({"k": [int(g["k"].iloc[0])], "score": [right / n], "baseline": [table.sum(axis=(0, 1)).max() / n], "n": [n], "classes": [len(names)]})
        else:
            counts = long.groupBy("k", "fold", "bin").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))

            def score(g: pd.DataFrame) -> pd.DataFrame:
                bins = int(g["bin"].max()) + 1
                n, s, q = (np.zeros((2, bins)) for _ in range(3))
                for t, c in ((n, "n"), (s, "s"), (q, "q")):
                    np.add.at(t, (g["fold"].to_numpy(), g["bin"].to_numpy()), g[c].to_numpy())
                lost = 0.0
                for f in (0, 1):
                    said = tree_means(n[f], s[f])
                    lost += (q[1 - f] - 2 * said * s[1 - f] + said * said * n[1 - f]).sum()
                whole = q.sum() - s.sum() ** 2 / n.sum()
                return pd.DataFrame({"k": [int(g["k"].iloc[0])], "score": [1 - lost / whole if whole > 0 else 0.0], "baseline": [0.0], "n": [n.sum()], "classes": [2]})

        # A group has at most 2 BINS rows for each class.
        found = counts.groupBy("k").applyInPandas(score, "k int, score double, baseline double, n double, classes int").collect()
        for r in sorted(found, key=lambda r: r["k"]):
            if r["n"] >= 4 and r["classes"] >= 2 and r["score"] > self.leak_score and r["score"] > r["baseline"]:
                self._leak(numbers[r["k"]], target, f"a tree of this column alone reaches {r['score']:.3f} on rows it has not seen (baseline {r['baseline']:.3f})", r["score"], r["baseline"])

    def _leaks_by_mapping(self, rows: DataFrame, target: str, texts: list[str], classes: bool) -> None:
        """Each row's target guessed from the other rows of its value; rows alone with theirs by the whole table."""
        texts = [c for c in texts if self.values[c] >= 2]
        if not texts:
            return
        cells = [F.struct(F.lit(k).alias("k"), self.value[c].alias("v")) for k, c in enumerate(texts)]
        long = rows.select(F.col("the target").alias("y"), F.explode(F.array(*cells)).alias("s")).select("s.*", "y").where("v is not null")
        if classes:
            counts = long.groupBy("k", "v", "y").agg(F.count(F.lit(1)).alias("n")).checkpoint()
            sides = counts.groupBy("k", "y").agg(F.sum("n").alias("n"))
            whole = sides.groupBy("k").agg(F.min(F.struct((-F.col("n")).alias("m"), "y")).alias("b"), F.sum("n").alias("of")).select("k", F.col("b.y").alias("common"), (-F.col("b.m")).alias("most"), "of")
            by = Window.partitionBy("k", "v").orderBy(F.desc("n"), "y")
            ranked = counts.withColumn("r", F.row_number().over(by)).withColumn("c2", F.coalesce(F.lead("n").over(by), F.lit(0))).withColumn("y2", F.lead("y").over(by))
            first = ranked.where("r = 1").join(F.broadcast(whole), "k")  # a row for each column
            alone = (F.col("n") == 1) & (F.col("c2") == 0)
            ahead = (F.col("n") - 1 > F.col("c2")) | ((F.col("n") - 1 == F.col("c2")) & (F.col("y") < F.col("y2")))
            right = F.when(alone, F.when(F.col("y") == F.col("common"), 1).otherwise(0)).otherwise(F.when(ahead, F.col("n")).otherwise(0))
            one = first.groupBy("k").agg((F.sum(right) / F.max("of")).alias("score"), (F.max("most") / F.max("of")).alias("baseline")).collect()
        else:
            sums = long.groupBy("k", "v").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")).checkpoint()
            whole = sums.groupBy("k").agg((F.sum("s") / F.sum("n")).alias("mean"), (F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")).alias("all"))
            n, s, q = F.col("n"), F.col("s"), F.col("q")
            lost = F.when(n > 1, (n * n * q - n * s * s) / ((n - 1) * (n - 1))).otherwise((s - F.col("mean")) * (s - F.col("mean")))
            one = sums.join(F.broadcast(whole), "k").groupBy("k").agg((1 - F.sum(lost) / F.max("all")).alias("score"), F.lit(0.0).alias("baseline")).where("score is not null").collect()
        for r in sorted(one, key=lambda r: r["k"]):
            if r["score"] > self.leak_score and r["score"] > r["baseline"]:
                self._leak(texts[r["k"]], target, f"its values decide {target}: {r['score']:.3f} from the other rows of each value (baseline {r['baseline']:.3f})", r["score"], r["baseline"])

    def _importance(self, rows: DataFrame, target: str, columns: list[str], classes: bool) -> None:
        """Columns that a forest needs no more than copies of columns whose values come from other rows."""
        wide = [c for c in columns if not self.numeric[c] and self.values[c] > self.model_categories]
        usable = [c for c in columns if c not in wide]
        if wide:
            self.notes.append(f"the importance check left out text columns with over {self.model_categories} values: {', '.join(wide)}")
        if not usable:
            return
        key = F.xxhash64(F.lit(self.seed + 1), *[f"`{c}`" for c in usable], "the target")
        picked = rows.withColumn("the key", key).orderBy("the key").limit(self.model_rows)
        inputs = Inputs.fit(picked, usable)
        k = len(inputs.names)
        names = [r[0] for r in picked.select(F.col("the target")).distinct().orderBy("the target").collect()] if classes else None
        goal = F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(names) for x in (v, float(i))]), F.col("the target")) if classes else F.col("the target")
        ready = inputs.columns(picked).select("the key", goal.alias("y"), *[f"`x {i}`" for i in range(k)]).checkpoint()
        if ready.count() < 50 or (classes and len(names) < 2):
            self.notes.append("too few rows to judge importance")
            return
        others = ready.orderBy(F.xxhash64("the key")).limit(BACKGROUND).collect()  # BACKGROUND rows
        shadows = sorted(set(np.linspace(0, k - 1, min(5, k)).round().astype(int).tolist()))
        take = lambda i, salt: F.element_at(F.array(*[F.lit(float(r[f"x {i}"])) for r in others]), F.pmod(F.xxhash64("the key", F.lit(salt)), F.lit(len(others))).cast("int") + 1)
        full = ready.withColumns({f"x {k + j}": take(i, 1000 + j) for j, i in enumerate(shadows)})
        m = k + len(shadows)
        vector = VectorAssembler(inputCols=[f"x {i}" for i in range(m)], outputCol="inputs")
        held = F.pmod(F.xxhash64("the key", F.lit(7)), F.lit(10)) < 3
        kind = RandomForestClassifier if classes else RandomForestRegressor
        forest = kind(featuresCol="inputs", labelCol="y", numTrees=40, maxDepth=6, minInstancesPerNode=2, seed=self.seed, maxBins=max(32, self.model_categories + 2)).fit(vector.transform(full.where(~held)))
        tried = full.where(held).withColumn("without", F.explode(F.array(*map(F.lit, range(-1, m)))))
        swapped = tried.withColumns({f"x {i}": F.when(F.col("without") == i, take(i if i < k else shadows[i - k], 2000 + i)).otherwise(F.col(f"x {i}")) for i in range(m)})
        out = forest.transform(vector.transform(swapped)).groupBy("without")
        if classes:
            one = {r[0]: r[1] for r in out.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).collect()}
            sizes = [r[0] for r in full.where(held).groupBy("y").count().select("count").collect()]
            base = max(sizes) / sum(sizes) if sizes else 1.0
        else:
            one = {r[0]: 1 - r[1] / r[2] if r[2] else 0.0 for r in out.agg(F.avg((F.col("prediction") - F.col("y")) ** 2), F.var_pop("y").alias("v")).collect()}
            base = 0.0
        if one.get(-1, 0.0) <= base:
            self.notes.append("the forest did no better than a constant: importance was not judged")
            return
        drop = {i: one[-1] - one[i] for i in range(m)}
        ceiling = max(0.0, *[drop[i] for i in range(k, m)])
        for i, c in enumerate(inputs.names):
            if drop[i] <= ceiling + 1e-12:
                self._add(c, "zero_importance", "low", f"a forest loses {drop[i]:+.4f} without it, by noise {ceiling:.4f}", importance=drop[i], noise=ceiling)


def check(df: DataFrame, target: str | None = None, **how) -> FeatureReport:
    """Checks with the parameters of ``FeatureChecker``."""
    return FeatureChecker(**how).check(df, target)
