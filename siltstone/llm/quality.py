"""Quality rules with adaptive thresholds, in Spark expressions only.

Per document, counts over its whole text; per language and source, a KLL sketch of
each metric's distribution over the documents that pass the base rules. Sketches
merge, so those of a language and of the whole corpus come from the same sketches,
and stand in for groups with too few documents. A document is rejected where a
metric lies beyond the far fence of its group: ``k`` interquartile ranges outside
the middle half. Only where a group hardly varies, as with rates that are 0 in most
documents, a small floor per metric stands for the range.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import free_name, stash, words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Fence:
    """A metric, the least interquartile range, and which side rejects."""

    metric: str
    floor: float
    low: bool
    high: bool


#: Mean characters of a word, symbols a word character, repeated lines a line, repeated words a word, logarithm of the words.
FENCES = [
    Fence("mean_word", 0.05, True, True),
    Fence("symbol_rate", 0.005, False, True),
    Fence("dup_line_rate", 0.02, False, True),
    Fence("repeat_rate", 0.015, False, True),
    Fence("log_words", 0.1, True, True),
]


@dataclass(frozen=True)
class Rules:
    """Parameters of the rules; the base rules are fixed cutoffs, everything else follows the corpus."""

    min_words: int = 10
    max_repeat_percent: int = 20
    k: float = 3.0
    least: int = 200
    sketch_k: int = 400
    fences: list[Fence] = field(default_factory=lambda: list(FENCES))


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the five counts and n_lines; columns of those names are replaced. A null text counts as empty.

    n_repeat_words: words in 5-word windows found twice or more in the text. Windows are compared by a 64-bit hash of
    their words. Only texts in which some hash repeats are sorted; the rest take one pass over a hash set.
    """
    w, lines, hashes, ordered, at = (free_name(df.columns, x) for x in ("_w", "_lines", "_hashes", "_ordered", "_at"))
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")
    keep = [c for c in df.columns if c.lower() not in {*COUNTS, "n_lines"}]
    cols = [F.col(f"`{c}`") for c in keep]
    one = df.select(
        *cols,
        words(F.col(text)).alias(w),
        F.char_length(bare).cast("long").alias("word_chars"),
        (F.char_length(bare) - F.char_length(F.translate(bare, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(whole, "\n"), lambda x: F.rtrim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "").alias(lines),
    )
    near = F.transform(
        F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(F.col(w), i + F.lit(j)) for j in range(5)])
    )
    two = one.select(
        *cols,
        F.size(w).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) >= 5, near).otherwise(F.array().cast("array<bigint>")).alias(hashes),
    )
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    three = two.withColumn(
        ordered,
        F.when(repeats, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none),
    ).drop(hashes)
    twice = F.filter(
        ordered,
        lambda x, i: F.coalesce(F.get(F.col(ordered), i - 1).h == x.h, F.lit(False))
        | F.coalesce(F.get(F.col(ordered), i + 1).h == x.h, F.lit(False)),
    )
    four = three.withColumn(at, F.sort_array(F.transform(twice, lambda x: x.i))).drop(ordered)
    covered = F.aggregate(
        F.transform(at, lambda p, i: F.least(F.lit(5), F.coalesce(F.get(F.col(at), i + 1) - p, F.lit(5)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return four.withColumn("n_repeat_words", covered.cast("long")).drop(at)


def _metrics() -> dict[str, Column]:
    least = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    return {
        "mean_word": F.col("word_chars") / least("n_words"),
        "symbol_rate": F.col("n_symbols") / least("word_chars"),
        "dup_line_rate": F.col("n_dup_lines") / least("n_lines"),
        "repeat_rate": F.col("n_repeat_words") / least("n_words"),
        "log_words": F.log(least("n_words")),
    }


def base_failed(rules: Rules) -> Column:
    """The base rules on the counts."""
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def thresholds(counted: DataFrame, rules: Rules, lang: str = "lang", source: str = "source") -> DataFrame:
    """Per (lang, source) of counted documents that pass the base rules: g_lang, g_source, and low_ and high_ of each metric.

    The narrowest level with at least ``rules.least`` documents decides: group, language, corpus.
    """
    metrics = _metrics()
    names = [f.metric for f in rules.fences]
    passed = counted.where(~base_failed(rules)).select(
        F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), *[metrics[m].alias(m) for m in names]
    )
    # Two steps, the first also by a salt, so that a hot group is sketched by many tasks and only sketches meet.
    salted = passed.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(64)).cast("int"))
    parts = salted.groupBy("g_lang", "g_source", "salt").agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(m, F.lit(rules.sketch_k)).alias(m) for m in names]
    )

    def merged(df: DataFrame, by: list[str], mark: str) -> DataFrame:
        return df.groupBy(*by).agg(
            F.sum("n").alias(f"n{mark}"), *[F.kll_merge_agg_double(m, F.lit(rules.sketch_k)).alias(f"{m}{mark}") for m in names]
        )

    group = stash(merged(parts, ["g_lang", "g_source"], ""), "sketches")
    lang_level = merged(group, ["g_lang"], "_l")
    corpus = merged(group, [], "_c").first()  # one row of sketches, bounded by rules.sketch_k
    levels = group.join(lang_level, group["g_lang"].eqNullSafe(lang_level["g_lang"])).drop(lang_level["g_lang"])

    def level(m: str) -> Column:
        whole = corpus[f"{m}_c"]
        last = F.lit(None).cast("binary") if whole is None else F.lit(bytes(whole))
        return F.when(F.col("n") >= rules.least, F.col(m)).when(F.col("n_l") >= rules.least, F.col(f"{m}_l")).otherwise(last)

    out = levels.select("g_lang", "g_source", *[level(m).alias(m) for m in names])
    cols = []
    for f in rules.fences:
        q1, q3 = (F.kll_sketch_get_quantile_double(F.col(f.metric), F.lit(q)) for q in (0.25, 0.75))
        reach = F.greatest(q3 - q1, F.lit(f.floor)) * rules.k
        cols += [(q1 - reach).alias(f"low_{f.metric}")] * f.low + [(q3 + reach).alias(f"high_{f.metric}")] * f.high
    return out.select("g_lang", "g_source", *cols)


def judge(counted: DataFrame, rules: Rules, lang: str = "lang", source: str = "source") -> DataFrame:
    """counted with base_failed and kept, by thresholds from counted itself. counted is read twice: stash it first."""
    metrics = _metrics()
    limits = thresholds(counted, rules, lang, source)
    joined = counted.join(
        limits, counted[lang].eqNullSafe(limits["g_lang"]) & counted[source].eqNullSafe(limits["g_source"]), "left"
    )
    bad = F.lit(False)
    for f in rules.fences:
        if f.low:
            bad = bad | F.coalesce(metrics[f.metric] < limits[f"low_{f.metric}"], F.lit(False))
        if f.high:
            bad = bad | F.coalesce(metrics[f.metric] > limits[f"high_{f.metric}"], F.lit(False))
    failed = base_failed(rules)
    return joined.select(*[counted[c] for c in counted.columns], failed.alias("base_failed"), (~failed & ~bad).alias("kept"))


def quality(df: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """df with the counts, base_failed and kept; columns of those names are replaced.

    Null texts have no words and fail the base rules. Null languages and sources are groups of their own. A group none
    of whose documents passes the base rules needs no threshold. An empty table gives no row; repeated rows count each.
    The counted rows are written to the shared folder once, as thresholds and filter both read them.
    """
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("base_failed", "kept")])
    return judge(stash(with_counts(df, text), "counted"), rules, lang, source)
