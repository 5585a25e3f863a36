"""Boosted trees for outcomes and failures: held-out scores, importance, explanations, settings to hold.

Training is Spark ML's, so rows stay distributed. What a fitted model is asked afterwards
(dependence curves, contributions of one row, importance by permutation) is answered in one pass
each: rows are replicated with one value replaced, scored together and averaged by a grouping.
Reference rows for curves and contributions are BACKGROUND rows picked by a hash of their
content, as many whatever the input.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.industry import failure_labels
from siltstone.operators.scores import average_precision, binary_curve_area

#: Reference rows; settings tried for a number; values of a category that are told apart (the others share one more).
BACKGROUND, GRID, LEVELS = 200, 20, 1000
#: Whole numbers of up to this many values are classes (fixed value).
MAX_CLASSES = 10
#: A setting is good within this share of its curve's spread below the best; a curve must move this share of the predictions' spread (fixed values).
KEEP, LEAST_MOVE, LEAST_IMPORTANCE = 0.25, 0.20, 0.01
#: Probabilities from which a risk is medium and high (fixed values).
MEDIUM_RISK, HIGH_RISK = 0.25, 0.60

# Whole labels, in lower case with underscores, that name the good and the bad outcome (fixed values).
GOOD_WORDS = [
    "pass", "passed", "passing", "ok", "okay", "good", "accept", "accepted", "yes", "true", "success", "in_spec", "in-spec", "inspec", "conforming",
    "a", "grade_a", "healthy", "within_spec", "within-spec", "gut", "in_ordnung", "io", "goed", "bra", "god", "bueno", "buena", "aprobado", "conforme",
    "bom", "boa", "aprovado", "buono", "buona", "bon", "bonne", "reussi", "bun", "dobry", "dobre", "godny", "iyi", "uygun", "合格", "良", "良品", "合格品",
    "パス", "양품", "합격",
]
BAD_WORDS = [
    "fail", "failed", "failing", "failure", "defect", "defective", "reject", "rejected", "scrap", "bad", "no", "false", "ng", "nok", "out_of_spec",
    "out-of-spec", "nonconforming", "f", "grade_f", "faulty", "rework", "schlecht", "fehler", "ausschuss", "nicht_io", "nio", "slecht", "daarlig", "dalig",
    "malo", "mala", "rechazado", "defecto", "ruim", "reprovado", "rejeitado", "cattivo", "cattiva", "scarto", "mauvais", "mauvaise", "rebut", "echec",
    "rau", "zly", "zle", "brak", "kotu", "uygunsuz", "hatali", "不合格", "不良", "不良品", "不合格品", "불량", "불합격",
]


def _number(df: DataFrame, c: str) -> Column:
    value, kind = F.col(f"`{c}`"), df.schema[c].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")) / 1e6
    value = value.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < math.inf), value)


def _is_number(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


class Inputs:
    """How columns become the numbers that trees read: medians for missing numbers, numbered levels of categories."""

    def __init__(self, numbers: dict[str, float], levels: dict[str, list[str]]) -> None:
        self.numbers, self.levels = numbers, levels
        self.names = [*numbers, *levels]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> Inputs:
        """Medians in one aggregation, the LEVELS commonest levels of each category; columns without a value are left out."""
        numeric = [c for c in columns if _is_number(df, c)]
        medians = df.agg(F.count(F.lit(1)), *[F.percentile_approx(_number(df, c), 0.5, 10_000) for c in numeric]).first()[1:]
        levels = {}
        for c in columns:
            if c not in numeric:
                top = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(LEVELS).collect()
                if top:
                    levels[c] = [r["v"] for r in top]
        return cls({c: m for c, m in zip(numeric, medians) if m is not None}, levels)

    def columns(self, df: DataFrame, prefix: str = "x ") -> DataFrame:
        """df with one number for each input; a missing level is the commonest, one that was never seen comes after all others."""
        out = {}
        for k, (c, median) in enumerate(self.numbers.items()):
            out[f"{prefix}{k}"] = F.coalesce(_number(df, c), F.lit(median))
        for k, (c, names) in enumerate(self.levels.items(), len(self.numbers)):
            place = F.create_map(*[F.lit(x) for i, v in enumerate(names) for x in (v, float(i))])
            known = F.coalesce(F.element_at(place, F.col(f"`{c}`").cast("string")), F.lit(float(len(names))))
            out[f"{prefix}{k}"] = F.when(F.col(f"`{c}`").isNull(), 0.0).otherwise(known)
        return df.withColumns(out)

    def vector(self, df: DataFrame, prefix: str = "x ") -> DataFrame:
        """df with ``inputs``: a vector of those numbers; categories are marked as such."""
        marked = {}
        for k, names in enumerate(self.levels.values(), len(self.numbers)):
            marked[f"{prefix}{k}"] = F.col(f"{prefix}{k}").alias(f"{prefix}{k}", metadata={"ml_attr": {"type": "nominal", "vals": [str(i) for i in range(len(names) + 1)], "name": f"{prefix}{k}"}})
        columns = [f"{prefix}{k}" for k in range(len(self.names))]
        return VectorAssembler(inputCols=columns, outputCol="inputs").transform(df.withColumns(marked)).drop(*columns)


class Boosted:
    """Boosted trees over Inputs: of a number, or of classes (one set of trees for each but the first of two)."""

    def __init__(self, trees: int = 50, depth: int = 3, rate: float = 0.1, seed: int = 0) -> None:
        self.trees, self.depth, self.rate, self.seed = trees, depth, rate, seed

    def fit(self, df: DataFrame, columns: list[str], target: Column, classes: list[str] | None = None) -> Boosted:
        self.inputs, self.classes = Inputs.fit(df, columns), classes
        if not self.inputs.names:
            raise ValueError("no column with a value to learn from")
        bins = max([32, *[len(v) + 1 for v in self.inputs.levels.values()]])
        rows = self.inputs.vector(self.inputs.columns(df.withColumn("to learn", target))).select("inputs", "to learn").persist()
        how = dict(featuresCol="inputs", labelCol="goal", maxIter=self.trees, maxDepth=self.depth, stepSize=self.rate, seed=self.seed, maxBins=bins)
        if classes is None:
            self.models = [GBTRegressor(**how).fit(rows.withColumn("goal", F.col("to learn").cast("double")))]
        else:
            wanted = classes[1:] if len(classes) == 2 else classes
            self.models = [GBTClassifier(**how).fit(rows.withColumn("goal", (F.col("to learn") == c).cast("double"))) for c in wanted]
        rows.unpersist()
        return self

    def scored(self, df: DataFrame, ready: bool = False) -> DataFrame:
        """df with ``scores``: the number, or the probability of each class. ready: df has the columns of Inputs already."""
        out = self.inputs.vector(df if ready else self.inputs.columns(df))
        for k, model in enumerate(self.models):
            # A tree model's own columns are kept out of the way.
            model = model.copy({model.predictionCol: f"guess {k}"} | ({model.probabilityCol: f"share {k}", model.rawPredictionCol: f"raw {k}"} if self.classes else {}))
            out = model.transform(out)
        if self.classes is None:
            return out.withColumn("scores", F.array("guess 0")).drop("inputs", "guess 0")
        odds = [vector_to_array(f"share {k}")[1] for k in range(len(self.models))]
        total = sum(odds, F.lit(0.0))
        shares = [1 - odds[0], odds[0]] if len(self.classes) == 2 else [F.when(total > 0, p / total).otherwise(1 / len(odds)) for p in odds]
        gone = [x for k in range(len(self.models)) for x in (f"guess {k}", f"share {k}", f"raw {k}")]
        return out.withColumn("scores", F.array(*shares)).drop("inputs", *gone)

    @property
    def importance(self) -> dict[str, float]:
        """Share of the trees' gain by column, largest first."""
        total = [0.0] * len(self.inputs.names)
        for m in self.models:
            for k, v in enumerate(m.featureImportances.toArray()):
                total[k] += float(v)
        whole = sum(total) or 1.0
        return dict(sorted(((c, v / whole) for c, v in zip(self.inputs.names, total)), key=lambda x: (-x[1], x[0])))


def _folded(label: str) -> str:
    return "_".join(label.strip().lower().split())


def good_class(classes: list[str]) -> tuple[str, bool]:
    """(the class that names a good outcome, whether its name said so): else the one that is not bad, else the last."""
    good = [c for c in classes if _folded(c) in GOOD_WORDS]
    bad = [c for c in classes if _folded(c) in BAD_WORDS]
    if good:
        return good[0], True
    if bad and len(bad) < len(classes):
        return next(c for c in classes if c not in bad), True
    return classes[-1], False


class QualityModel:
    """Predicts an outcome from process parameters and tells what drives it.

    target text, boolean or whole numbers of up to ten values: classes; other numbers: the number itself. Rows without an
    outcome are left out. A share of the rows, picked by a hash of their content, is held out for ``metrics``; the model
    kept is fitted on all rows.
    """

    def __init__(self, task: str = "auto", trees: int = 50, depth: int = 3, seed: int = 0) -> None:
        if task not in ("auto", "classification", "regression"):
            raise ValueError("task must be auto, classification or regression")
        self.asked, self.trees, self.depth, self.seed = task, trees, depth, seed
        self.model: Boosted | None = None
        self.notes: list[str] = []

    def fit(self, df: DataFrame, target: str, features: list[str] | None = None, test: float = 0.2, good: str | None = None, higher_is_better: bool = True) -> QualityModel:
        if not 0 <= test < 1:
            raise ValueError("test must be a share from 0 to below 1")
        features = [c for c in (features or df.columns) if c != target]
        gone = [c for c in [target, *features] if c not in df.columns]
        if gone or not features:
            raise ValueError(f"no column {gone}" if gone else "no column to learn from")
        self.target, self.features, self.notes = target, features, []
        rows = df.where(self._known(df)).select(*[f"`{c}`" for c in dict.fromkeys([target, *features])])
        kind = self._kind(rows)
        self.task = kind if self.asked == "auto" else self.asked
        if self.task == "regression" and not _is_number(rows, target):
            raise ValueError(f"{target} is no number")
        goal = self._goal(rows)
        values = [r[0] for r in rows.select(goal.alias("v")).distinct().limit(LEVELS + 1).collect()]
        if len(values) < 2:
            raise ValueError(f"{target} has fewer than two outcomes: nothing to tell apart")
        if self.task == "classification" and len(values) > LEVELS:
            raise ValueError(f"{target} has more than {LEVELS} classes")
        self.classes = sorted(values) if self.task == "classification" else None
        self.higher = True if self.classes else higher_is_better
        if self.classes:
            if good is not None and str(good) not in self.classes:
                raise ValueError(f"{good} is no class of {target}")
            self.good, sure = (str(good), True) if good is not None else good_class(self.classes)
            if not sure:
                self.notes.append(f"no class is named like a good outcome; {self.good} was taken")
        side = F.pmod(F.xxhash64(F.lit(self.seed), *[f"`{c}`" for c in rows.columns]), F.lit(1_000_000)) < int(test * 1_000_000)
        make = lambda part: Boosted(self.trees, self.depth, seed=self.seed).fit(part, features, goal, self.classes)
        held = rows.where(side)
        learn = rows.where(~side)
        if held.limit(1).count() and learn.select(goal.alias("v")).distinct().limit(2).count() == 2:
            self.model = make(learn)
            self.metrics = self.evaluate(held)
        else:
            self.model = make(rows)
            self.metrics = self.evaluate(rows)
            self.notes.append("too few rows to hold any out: the scores are of rows that were learnt")
        if test and "learnt" not in " ".join(self.notes):
            self.model = make(rows)
        skipped = [c for c in features if c not in self.model.inputs.names]
        if skipped:
            self.notes.append(f"columns without a value were left out: {', '.join(skipped)}")
        picked = rows.orderBy(F.xxhash64(F.lit(self.seed), *[f"`{c}`" for c in rows.columns])).limit(BACKGROUND)
        self._background = self.model.inputs.columns(picked).select(*[f"`x {k}`" for k in range(len(self.model.inputs.names))]).collect()  # BACKGROUND rows
        self._spark = df.sparkSession
        return self

    def _known(self, df: DataFrame) -> Column:
        value = F.col(f"`{self.target}`")
        real = isinstance(df.schema[self.target].dataType, (T.FloatType, T.DoubleType))
        return value.isNotNull() & ~F.isnan(value) if real else value.isNotNull()

    def _kind(self, rows: DataFrame) -> str:
        kind, value = rows.schema[self.target].dataType, F.col(f"`{self.target}`")
        if not isinstance(kind, T.NumericType):
            return "classification"
        few = rows.select(value.alias("v")).distinct().limit(MAX_CLASSES + 1)
        n, broken = few.agg(F.count(F.lit(1)), F.count(F.when(F.col("v") % 1 != 0, 1))).first()
        return "classification" if n <= 2 or (n <= MAX_CLASSES and not broken) else "regression"

    def _goal(self, rows: DataFrame) -> Column:
        return F.col(f"`{self.target}`").cast("string") if self.task == "classification" else _number(rows, self.target)

    def _ready(self) -> Boosted:
        if self.model is None:
            raise ValueError("the model is not fitted yet")
        return self.model

    def predict(self, df: DataFrame) -> DataFrame:
        """df with prediction and, of classes, probabilities (in the order of ``classes``)."""
        gone = [c for c in self._ready().inputs.names if c not in df.columns]
        if gone:
            raise ValueError(f"no column {gone}")
        out = self.model.scored(df)
        if not self.classes:
            return out.withColumn("prediction", F.col("scores")[0]).drop("scores")
        names = F.array(*map(F.lit, self.classes))
        best = F.element_at(names, F.array_position("scores", F.array_max("scores")).cast("int"))
        return out.withColumn("prediction", best).withColumnRenamed("scores", "probabilities")

    def evaluate(self, df: DataFrame) -> dict:
        """Scores over rows with a known outcome: accuracy, precision, recall, f1 and roc_auc (of the good class; of more than two, weighted by class), or r2, mae and rmse."""
        out = self.predict(df.where(self._known(df))).withColumn("truth", self._goal(df))
        if not self.classes:
            e = F.col("prediction") - F.col("truth")
            one = out.agg(F.avg(F.abs(e)), F.sqrt(F.avg(e * e)), F.sum(e * e), F.var_pop("truth") * F.count(F.lit(1))).first()
            return {"r2": 1 - one[2] / one[3] if one[3] else None, "mae": one[0], "rmse": one[1]}
        asked = [self.good] if len(self.classes) == 2 else self.classes
        sums = [F.avg((F.col("prediction") == F.col("truth")).cast("double"))]
        for c in asked:
            p, t = F.col("prediction") == c, F.col("truth") == c
            sums += [F.count(F.when(p & t, 1)), F.count(F.when(p, 1)), F.count(F.when(t, 1))]
        one = out.agg(*sums).first()
        parts = [[h / p if p else 0.0, h / t if t else 0.0, t] for h, p, t in (one[k : k + 3] for k in range(1, len(one), 3))]
        whole = sum(t for *_, t in parts) or 1
        weigh = lambda f: sum(f(p, r) * t for p, r, t in parts) / whole
        area = None
        if len(self.classes) == 2:
            share = F.col("probabilities")[self.classes.index(self.good)]
            area = binary_curve_area(out.select((F.col("truth") == self.good).alias("y"), share.alias("s")), "y", "s").first()["auc"]
        return {"accuracy": one[0], "precision": weigh(lambda p, r: p), "recall": weigh(lambda p, r: r), "f1": weigh(lambda p, r: 2 * p * r / (p + r) if p + r else 0.0), "roc_auc": area}

    @property
    def importance(self) -> dict[str, float]:
        """Share of the trees' gain of each column given, largest first."""
        return self._ready().importance | {c: 0.0 for c in self.features if c not in self.model.inputs.names}

    def permutation_importance(self, df: DataFrame) -> DataFrame:
        """(feature, loss): how much worse rows are predicted with one value replaced by that of a reference row, in one pass."""
        n = len(self._ready().inputs.names)
        base = self.model.inputs.columns(df.where(self._known(df))).select(self._goal(df).alias("truth"), *[f"`x {k}`" for k in range(n)])
        pick = F.pmod(F.xxhash64(*[f"`x {k}`" for k in range(n)], "feature"), F.lit(len(self._background))).cast("int") + 1
        rows = base.withColumn("feature", F.explode(F.array(*map(F.lit, range(-1, n))))).withColumn("pick", pick)
        swapped = rows.withColumns({f"x {k}": F.when(F.col("feature") == k, F.element_at(F.array(*[F.lit(float(r[k])) for r in self._background]), F.col("pick"))).otherwise(F.col(f"x {k}")) for k in range(n)})
        out = self.model.scored(swapped, ready=True)
        wrong = (F.col("scores")[0] - F.col("truth")) ** 2
        if self.classes:
            place = F.element_at(F.create_map(*[F.lit(x) for k, c in enumerate(self.classes) for x in (c, k)]), F.col("truth"))
            wrong = -F.ln(F.greatest(F.coalesce(F.get("scores", place), F.lit(0.0)), F.lit(1e-9)))
        loss = out.groupBy("feature").agg(F.avg(wrong).alias("loss"))
        whole = loss.where("feature = -1").select(F.col("loss").alias("base"))
        names = F.element_at(F.array(*map(F.lit, self.model.inputs.names)), F.col("feature") + 1)
        return loss.where("feature >= 0").crossJoin(F.broadcast(whole)).select(names.alias("feature"), (F.col("loss") - F.col("base")).alias("loss"))  # one row

    def _replayed(self, changes: list[tuple[int, int, float]]) -> dict[tuple[int, int], float]:
        """Mean score of the reference rows for each (input, number, value) put into all of them; (-1, 0) is without a change. One pass."""
        n, spark = len(self.model.inputs.names), self._spark
        rows = spark.createDataFrame([tuple(map(float, r)) for r in self._background], ", ".join(f"`x {k}` double" for k in range(n)))
        asked = spark.createDataFrame([(-1, 0, 0.0), *changes], "feature int, number int, value double")
        grid = rows.crossJoin(F.broadcast(asked))  # BACKGROUND rows times GRID values of each input
        grid = grid.withColumns({f"x {k}": F.when(F.col("feature") == k, F.col("value")).otherwise(F.col(f"x {k}")) for k in range(n)})
        at = self.classes.index(self.good) if self.classes else 0
        got = self.model.scored(grid, ready=True).groupBy("feature", "number").agg(F.avg(F.col("scores")[at]).alias("s"), F.min(F.col("scores")[at]).alias("l"), F.max(F.col("scores")[at]).alias("h"))
        rows = got.collect()
        self._spread = next(r["h"] - r["l"] for r in rows if r["feature"] == -1)
        return {(r["feature"], r["number"]): r["s"] for r in rows}

    def explain(self, row: dict) -> dict:
        """{score, baseline, contributions}: how the reference rows' mean score moves toward the good if one of their values is the row's."""
        self._ready()
        names = [*self.model.inputs.names]
        gone = [c for c in names if c not in row]
        if gone:
            raise ValueError(f"no value of {gone}")
        schema = ", ".join(f"`{c}` {'double' if c in self.model.inputs.numbers else 'string'}" for c in names)
        values = [None if row[c] is None else float(row[c]) if c in self.model.inputs.numbers else str(row[c]) for c in names]
        one = self._spark.createDataFrame([tuple(values)], schema)
        numbers = self.model.inputs.columns(one).select(*[f"`x {k}`" for k in range(len(names))]).first()
        at = self.classes.index(self.good) if self.classes else 0
        score = self.model.scored(one).select(F.col("scores")[at]).first()[0]
        means = self._replayed([(k, 0, float(v)) for k, v in enumerate(numbers)])
        sign = 1.0 if self.higher else -1.0
        base = means[-1, 0]
        return {"score": score, "baseline": base, "contributions": {c: sign * (means[k, 0] - base) for k, c in enumerate(names)}}

    def curves(self, points: int = GRID) -> dict[str, list[tuple[float, float]]]:
        """Mean score of the reference rows at up to ``points`` settings of each number: quantiles of the reference rows' values."""
        import numpy as np

        self._ready()
        grids = []
        for k in range(len(self.model.inputs.numbers)):
            values = np.unique([r[k] for r in self._background])
            grids.append(values if len(values) <= points else np.unique(np.quantile([r[k] for r in self._background], np.linspace(0.02, 0.98, points))))
        means = self._replayed([(k, i, float(v)) for k, g in enumerate(grids) for i, v in enumerate(g)])
        return {c: [(float(v), means[k, i]) for i, v in enumerate(grids[k])] for k, c in enumerate(self.model.inputs.numbers)}

    def optimal_ranges(self, points: int = GRID) -> dict[str, tuple[float, float]]:
        """Settings of each number that stay near its best mean score; one that moves too little gets all its settings and is in ``uninformative``."""
        curves, sign = self.curves(points), 1.0 if self.higher else -1.0
        self.uninformative, out = [], {}
        for c in [c for c in self.importance if c in curves]:
            x, y = [p[0] for p in curves[c]], [sign * p[1] for p in curves[c]]
            move = max(y) - min(y)
            if self.importance[c] < LEAST_IMPORTANCE or move <= max(LEAST_MOVE * self._spread, 1e-12):
                self.uninformative.append(c)
                out[c] = (x[0], x[-1])
                continue
            low = high = y.index(max(y))
            floor = max(y) - KEEP * move
            while low > 0 and y[low - 1] >= floor:
                low -= 1
            while high < len(y) - 1 and y[high + 1] >= floor:
                high += 1
            out[c] = (x[low], x[high])
        return out


STATS = ["mean", "sd", "low", "high", "slope", "roughness"]


def channel_features(df: DataFrame, machine: list[str], order: str, channels: list[str], width: int) -> tuple[DataFrame, list[str]]:
    """df with six statistics of each channel over a machine's last ``width`` rows, and their names; roughness: mean squared step."""
    by = Window.partitionBy(*machine).orderBy(order)
    frame = by.rowsBetween(1 - width, 0)
    rows = df.withColumn("row of machine", F.row_number().over(by).cast("double"))
    added, names = {}, []
    rows = rows.withColumns({f"step of {c}": F.col(f"`{c}`") - F.lag(f"`{c}`").over(by) for c in channels})
    for c in channels:
        v, s = F.col(f"`{c}`").cast("double"), F.col(f"`step of {c}`")
        made = [F.avg(v), F.stddev_pop(v), F.min(v), F.max(v), F.regr_slope(v, F.col("row of machine")), F.avg(s * s)]
        for name, m in zip(STATS, made):
            added[f"{c} {name}"] = F.coalesce(m.over(frame), F.lit(0.0))
            names.append(f"{c} {name}")
    return rows.withColumns(added).drop("row of machine", *[f"step of {c}" for c in channels]), names


class MaintenanceModel:
    """Learns what channels look like before a labelled failure; scores rows by the probability of one within ``horizon`` rows."""

    def __init__(self, width: int | None = None, trees: int = 50, depth: int = 3, rate: float = 0.1, seed: int = 0) -> None:
        if width is not None and width < 2:
            raise ValueError("width must be at least 2 rows")
        self.width, self.trees, self.depth, self.rate, self.seed = width, trees, depth, rate, seed
        self.model: Boosted | None = None
        self.notes: list[str] = []

    def fit(self, df: DataFrame, machine: list[str], order: str, failed: str, channels: list[str], horizon: int = 10) -> MaintenanceModel:
        if horizon < 1:
            raise ValueError("horizon must be at least 1 row")
        self.machine, self.order, self.failed, self.channels, self.horizon = machine, order, failed, list(channels), horizon
        longest = df.groupBy(*machine).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        self.fitted_width = max(2, min(self.width or max(3, min(50, longest // 10)), max(longest, 2)))
        rows, names = self._rows(df)
        n, near, events = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("will_fail"), 1)), F.count(F.when(F.col(failed).cast("boolean"), 1))).first()
        if not events:
            raise ValueError("no failures are marked, so there is nothing to learn from; machine_health() and remaining_life() need none")
        if near == n:
            raise ValueError(f"every row counts as a failure at horizon {horizon}: there is nothing healthy to compare with")
        self.notes = [f"{near} of {n} rows lie within {horizon} rows of a failure"] + (["so few that the model is crude"] if near < 5 else [])
        goal = F.when(F.col("will_fail"), "yes").otherwise("no")
        self.model = Boosted(self.trees, self.depth, self.rate, self.seed).fit(rows, names, goal, ["no", "yes"])
        return self

    def _rows(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        rows, names = channel_features(df, self.machine, self.order, self.channels, self.fitted_width)
        if self.failed in df.columns:
            rows = failure_labels(rows.withColumn(self.failed, F.coalesce(F.col(self.failed).cast("int"), F.lit(0))), self.machine, self.order, self.failed, self.horizon)
        return rows, names

    def predict(self, df: DataFrame) -> DataFrame:
        """df with probability and risk (high, medium, low)."""
        if self.model is None:
            raise ValueError("the model is not fitted yet")
        rows, names = self._rows(df.drop(self.failed) if self.failed in df.columns else df)
        p = F.col("scores")[1]
        return self.model.scored(rows).withColumn("probability", p).withColumn("risk", F.when(p >= HIGH_RISK, "high").when(p >= MEDIUM_RISK, "medium").otherwise("low")).drop("scores", *names)

    def evaluate(self, df: DataFrame) -> dict:
        """Scores against the failures marked in df, at probability 0.5; null where one class is missing."""
        if self.model is None:
            raise ValueError("the model is not fitted yet")
        rows, _ = self._rows(df)
        out = self.model.scored(rows).select(F.col("will_fail").alias("t"), F.col("scores")[1].alias("p")).checkpoint()
        guess, truth = F.col("p") >= 0.5, F.col("t")
        n, pos, said, hit, right = out.agg(F.count(F.lit(1)), F.count(F.when(truth, 1)), F.count(F.when(guess, 1)), F.count(F.when(guess & truth, 1)), F.count(F.when(guess == truth, 1))).first()
        precision, recall = hit / said if said else 0.0, hit / pos if pos else 0.0
        both = 0 < pos < n
        return {
            "n_rows": n, "n_positive": pos, "positive_rate": pos / n if n else 0.0, "horizon": self.horizon,
            "roc_auc": binary_curve_area(out, "t", "p").first()["auc"] if both else None, "average_precision": average_precision(out, "t", "p").first()["ap"] if both else None,
            "accuracy": right / n if n else None, "precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall) if precision + recall else 0.0,
        }

    @property
    def importance(self) -> dict[str, float]:
        return self.model.importance if self.model else {}
