"""Conversations and prompts: participation, cues, complexity, routing, cache keys, grounding, rule labels."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import ascii_words, sentences_of

#: Cue phrases (fixed values), all readable by RE2.
DECISION = r"(?i)\b(we (have )?(decided|agreed)|let's go with|the decision is|we will go with|agreed to)\b"
ACTION = r"(?i)\b(i('| wi)ll|will (send|prepare|review|check|follow up|schedule|update|write)|action item|needs? to|todo|to do:)\b"
QUESTION = r"\?"
HEDGE = r"(?i)\b(maybe|perhaps|might|probably|not sure)\b"


def participation(turns: DataFrame, conv: str, role: str, text: str) -> DataFrame:
    """(conv, role, turns, words, share): how much each party says."""
    n = F.size(ascii_words(F.col(text)))
    g = turns.groupBy(conv, role).agg(F.count(F.lit(1)).alias("turns"), F.sum(n.cast("long")).alias("words"))
    total = F.sum("words").over(Window.partitionBy(conv))
    return g.withColumn("share", F.when(total > 0, F.col("words") / total).otherwise(0.0))


def merged_turns(turns: DataFrame, conv: str, order: str, role: str, text: str) -> DataFrame:
    """Adjacent turns of one speaker as one: (conv, first, role, text)."""
    w = Window.partitionBy(conv).orderBy(order)
    new = F.when(F.lag(role).over(w).eqNullSafe(F.col(role)), 0).otherwise(1)
    rows = turns.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    parts = F.sort_array(F.collect_list(F.struct(F.col(order), F.col(text).alias("_t"))))
    return rows.groupBy(conv, "_run", role).agg(F.min(order).alias("first"), parts.alias("_p")).select(
        conv, "first", role, F.array_join(F.transform("_p", lambda x: x["_t"]), " ").alias("text")
    )


def cues(turns: DataFrame, conv: str, order: str, text: str) -> DataFrame:
    """(conv, order, kind, confidence): decisions, actions and questions; a hedge lowers the confidence, a question is no decision."""
    rows = turns.select(conv, order, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    kinds = F.array(
        F.when(F.col("_t").rlike(DECISION) & ~F.col("_t").rlike(QUESTION), "decision"), F.when(F.col("_t").rlike(ACTION), "action"), F.when(F.col("_t").rlike(QUESTION), "question")
    )
    confidence = F.when(F.col("_t").rlike(HEDGE), 0.55).otherwise(0.8)
    return rows.select(conv, order, F.explode(F.array_compact(kinds)).alias("kind"), confidence.alias("confidence"))


def answered(turns: DataFrame, conv: str, order: str, role: str, text: str, within: int = 6) -> DataFrame:
    """(conv, order, answer): questions, and the first of the next ``within`` turns by another speaker that asks nothing itself."""
    q = turns.where(F.col(text).rlike(QUESTION)).select(F.col(conv).alias("c"), F.col(order).alias("o"), F.col(role).alias("r"))
    a = turns.where(~F.coalesce(F.col(text), F.lit("")).rlike(QUESTION)).select(F.col(conv).alias("c"), F.col(order).alias("ao"), F.col(role).alias("ar"))
    hit = q.join(a, "c").where((F.col("ao") > F.col("o")) & (F.col("ao") <= F.col("o") + within) & (F.col("ar") != F.col("r")))
    first = hit.groupBy("c", "o").agg(F.min("ao").alias("answer"))
    return q.join(first, ["c", "o"], "left").select(F.col("c").alias(conv), F.col("o").alias(order), "answer")


def overlaps(segments: DataFrame, call: str, speaker: str, start: str, end: str, grace: float = 0.5) -> DataFrame:
    """(call, speaker, interruptions): segments that begin while another speaker still has more than ``grace`` seconds to say.

    Each segment meets those of its call that start before its end and end after its start, by hours, so that a join on
    equal keys bounds the pairs.
    """
    hour = 3600.0
    s = segments.select(F.col(call).alias("c"), F.col(speaker).alias("s"), F.col(start).alias("a"), F.col(end).alias("b"))
    slots = lambda a, b: F.explode(F.sequence(F.floor(a / hour), F.floor(b / hour)))
    left = s.withColumn("h", slots(F.col("a"), F.col("b")))
    right = s.select("c", F.col("s").alias("s2"), F.col("a").alias("a2"), F.col("b").alias("b2")).withColumn("h", slots(F.col("a2"), F.col("b2")))
    hit = left.join(right, ["c", "h"]).where((F.col("s") != F.col("s2")) & (F.col("a") > F.col("a2")) & (F.col("b2") - F.col("a") > grace))
    return hit.select("c", "s", "a").distinct().groupBy(F.col("c").alias(call), F.col("s").alias(speaker)).agg(F.count(F.lit(1)).alias("interruptions"))


#: Weights of a prompt's complexity signals, and the bands.
SIGNALS = {"length": 0.15, "questions": 0.15, "reasoning": 0.35, "code": 0.15, "instructions": 0.20}
BANDS = (0.22, 0.45)
_REASON = r"(?i)\b(why|explain|prove|compare|derive|analy[sz]e|because|therefore|step by step|trade-?offs?)\b"
_CODE = r"(```|\bdef \b|\bclass \b|\bSELECT \b|\{|\};|=>|==)"
_INSTRUCT = r"(?i)\b(must|should|list|write|create|return|use|ensure|include|format)\b"


def complexity(prompt: Column) -> Column:
    """Struct of the signals (0 to 1 each), their weighted sum and the band."""
    t = F.coalesce(prompt, F.lit(""))
    count = lambda p: F.size(F.regexp_extract_all(t, F.lit(f"({p})" if not p.startswith("(?i)") else f"(?i)({p[4:]})"), 0))
    one = lambda c: F.least(F.lit(1.0), c)
    parts = {
        "length": one(F.size(F.array_remove(F.split(t, r"\s+"), "")) / 200),
        "questions": one(count(r"\?") / 3),
        "reasoning": one(count(_REASON) / 3),
        "code": one(count(_CODE) / 3),
        "instructions": one(count(_INSTRUCT) / 5),
    }
    score = sum((parts[k] * w for k, w in SIGNALS.items()), F.lit(0.0))
    band = F.when(score < BANDS[0], "simple").when(score < BANDS[1], "moderate").otherwise("complex")
    return F.struct(*[c.alias(k) for k, c in parts.items()], score.alias("score"), band.alias("band"))


def route(prompts: DataFrame, models: list[dict], prefer: dict[str, float] | None = None, tags: list[str] = (), max_cost: float | None = None) -> DataFrame:
    """Each prompt (id, band, tokens) with its ranked models: filters by tags, tokens and cost, then weighted cost, latency and quality.

    The catalog of models is a literal array, a few entries long.
    """
    w = prefer or {"cost": 0.4, "latency": 0.2, "quality": 0.4}
    able = [m for m in models if set(tags) <= set(m.get("tags", []))]
    floors = F.when(F.col("band") == "complex", 0.60).when(F.col("band") == "moderate", 0.35).otherwise(0.0)
    entries = F.array(*[F.struct(F.lit(m["name"]).alias("model"), F.lit(float(m["cost"])).alias("cost"), F.lit(float(m["latency"])).alias("latency"), F.lit(float(m["quality"])).alias("quality"), F.lit(int(m["max_tokens"])).alias("most")) for m in able])
    rows = prompts.withColumn("m", F.explode(entries)).select(*prompts.columns, "m.*").where(F.col("tokens") <= F.col("most"))
    if max_cost is not None:
        rows = rows.where(F.col("cost") * F.col("tokens") / 1000 <= max_cost)
    by = Window.partitionBy("id")
    score = w["cost"] * F.min("cost").over(by) / F.col("cost") + w["latency"] * F.min("latency").over(by) / F.col("latency") + w["quality"] * F.col("quality")
    scored = rows.withColumn("score", F.round(score, 6)).withColumn("low", F.col("quality") < floors)
    order = by.orderBy("low", F.col("score").desc(), "cost", "latency", F.col("quality").desc(), "model")
    return scored.withColumn("rank", F.row_number().over(order)).drop("most")


def cache_key(prompt: Column, params: dict | None = None) -> Column:
    """sha256 of the prompt's layout-free form and the sorted parameters."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(prompt, "\r\n?", "\n"), "[ \t]+\n", "\n"), "\n{3,}", "\n\n"))
    return F.sha2(F.concat(bare, F.lit("\x1f" + json.dumps(params or {}, sort_keys=True))), 256)


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests (key) with the cached value, unless it has expired (cache: key, value, expires)."""
    live = cache.where(F.col("expires").isNull() | (F.col("expires") > now))
    return requests.join(live, "key", "left").withColumn("hit", F.col("value").isNotNull())


def cache_upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new entries in place of old ones of their keys."""
    return cache.join(new.select("key"), "key", "left_anti").unionByName(new)


def cache_evict(cache: DataFrame, most: int) -> DataFrame:
    """The most recently used entries (accessed, size) of each namespace that fit in ``most`` bytes."""
    w = Window.partitionBy("namespace").orderBy(F.col("accessed").desc(), "key").rowsBetween(Window.unboundedPreceding, 0)
    return cache.withColumn("_used", F.sum("size").over(w)).where(F.col("_used") <= most).drop("_used")


_FACT = re.compile(r"\d+(?:[.,]\d+)*%?|\b(?:19|20)\d\d\b")
_STOP = frozenset("a an and are as at be by for from has have in is it its of on or that the this to was were will with".split())


def _content(text: str) -> list[str]:
    return [w for w in re.findall(r"[^\W_]+", text.lower()) if w not in _STOP]


def _grams(text: str) -> dict[str, int]:
    t = " ".join(text.lower().split())
    out: dict[str, int] = {}
    for i in range(len(t) - 3):
        out[t[i : i + 4]] = out.get(t[i : i + 4], 0) + 1
    return out


def _norm(counts: dict) -> float:
    return sum(n * n for n in counts.values()) ** 0.5


def _cos(a: dict, b: dict, norms: float) -> float:
    dot = sum(n * b[k] for k, n in a.items() if k in b)
    return dot / (norms or 1.0)


class _Measured:
    """A sentence or a span of some with its facts, content words and, once asked for, 4-grams."""

    def __init__(self, text: str) -> None:
        self.text, self.facts, self.words = text, set(_FACT.findall(text)), Counter(_content(text))
        self.norm = _norm(self.words)

    @cached_property
    def grams(self) -> tuple[dict[str, int], float]:
        counts = _grams(self.text)
        return counts, _norm(counts)


def _score(claim: _Measured, span: _Measured, least: float = 0.0) -> float:
    """See lexical_score(); 4-grams, which take longest, are left out where even their full weight leaves the score below ``least``."""
    common = sum(w in span.words for w in claim.words)
    cover = common / len(claim.words) if claim.words else 0.0
    words = 0.25 * _cos(claim.words, span.words, claim.norm * span.norm) if common else 0.0
    if 0.30 + words + 0.45 * cover < least - 1e-9:
        return 0.0
    (a, x), (b, y) = claim.grams, span.grams
    return min(1.0, 0.30 * _cos(a, b, x * y) + words + 0.45 * cover)


def lexical_score(claim: str, span: str) -> float:
    """0.30 cosine of 4-grams, 0.25 cosine of words, 0.45 share of the claim's content words in the span."""
    return _score(_Measured(claim), _Measured(span))


def grounding(threshold: float = 0.55):
    """A UDF (answer, sources array): share of the answer's sentences that the sources support, and the unsupported ones.

    A sentence is supported if a span of one to three source sentences scores at least the threshold and has all its numbers.
    """

    @F.pandas_udf("score double, claims long, unsupported array<string>")
    def run(answer: pd.Series, sources: pd.Series) -> pd.DataFrame:
        out = []
        for text, passages in zip(answer.fillna(""), sources):
            spans = []
            for p in [] if passages is None else passages:
                s = sentences_of(p or "")
                spans += [" ".join(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)]
            measured = [_Measured(s) for s in dict.fromkeys(spans)]
            claims = [c for c in sentences_of(text)]
            bad = []
            for c in map(_Measured, claims):
                if not c.facts and not c.words:
                    continue
                if not any(c.facts <= s.facts and _score(c, s, threshold) >= threshold for s in measured):
                    bad.append(c.text)
            out.append((100.0 * (1 - len(bad) / len(claims)) if claims else 100.0, len(claims), bad))
        return pd.DataFrame(out, columns=["score", "claims", "unsupported"])

    return run


@dataclass
class Rule:
    """A label for texts with all the keywords (whole words) that match the pattern and the SQL condition."""

    label: str
    keywords: list[str] = field(default_factory=list)
    pattern: str | None = None
    condition: str | None = None
    weight: float = 1.0

    def matches(self, text: Column) -> Column:
        """Whether a text matches all the parts that are given."""
        ok = F.lit(True)
        for k in self.keywords:
            ok = ok & text.rlike(r"(?i)(^|[^\p{L}\p{N}_])" + re.escape(k).replace(r"\ ", r"\s+") + r"($|[^\p{L}\p{N}_])")
        if self.pattern:
            ok = ok & text.rlike(self.pattern)
        if self.condition:
            ok = ok & F.expr(self.condition)
        return F.coalesce(ok, F.lit(False))


def rule_labels(df: DataFrame, text: str, rules: list[Rule]) -> DataFrame:
    """df with label and confidence: the label with the largest weight of matching rules (ties: the first rule's), and its share."""
    labels = list(dict.fromkeys(r.label for r in rules))
    totals = [sum((F.when(r.matches(F.col(text)), r.weight).otherwise(0.0) for r in rules if r.label == name), F.lit(0.0)) for name in labels]
    best, total = F.greatest(*totals) if len(totals) > 1 else totals[0], sum(totals, F.lit(0.0))
    label = F.lit(None).cast("string")
    for name, t in reversed(list(zip(labels, totals))):
        label = F.when(t == best, name).otherwise(label)
    return df.withColumn("label", F.when(total > 0, label)).withColumn("confidence", F.when(total > 0, best / total).otherwise(0.0))


def label_model(df: DataFrame, text: str, label: str = "label"):
    """A fitted pyspark.ml pipeline (hashed TF-IDF, logistic regression) of the rows that have a label."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer

    stages = [
        StringIndexer(inputCol=label, outputCol="_y", handleInvalid="skip"),
        RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\W+"),
        HashingTF(inputCol="_w", outputCol="_tf", numFeatures=1 << 14),
        IDF(inputCol="_tf", outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(df.where(F.col(label).isNotNull() & F.col(text).isNotNull()))
