"""Text functions: native expressions first; Arrow UDFs where Unicode tables or per-text state are needed."""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Abbreviations after which a full stop ends no sentence (fixed values).
ABBREVIATIONS = ["mr", "mrs", "ms", "dr", "prof", "st", "vs", "etc", "e.g", "i.e", "fig", "no", "approx", "inc", "ltd", "jr", "sr"]


def ascii_normalized(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed; of a null text: empty."""
    # A single space is left as it is, so that few places are written anew.
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s\s+|[\t\n\x0B\f\r]", " "))


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct n-grams of code points; a shorter text is one shingle, an empty one has none."""
    size = F.char_length(text)
    grams = F.transform(F.sequence(F.lit(1), size - F.lit(n - 1)), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(text)).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def words(text: Column) -> Column:
    """Runs of letters, digits and apostrophes, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}']+)"), 1)


def ascii_words(text: Column) -> Column:
    """Runs of a-z and 0-9, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def estimated_tokens(text: Column) -> Column:
    """Four characters a token."""
    return F.ceil(F.char_length(text) / 4)


@F.pandas_udf(T.StringType())
def normalized(text: pd.Series) -> pd.Series:
    """NFKC, case folded, white space collapsed; null is empty."""
    return text.fillna("").map(lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split()))


def normalizer(form: str = "NFC", case: str | None = None, whitespace: bool = True, punctuation: bool = False, digits: bool = False, quotes: bool = True, diacritics: bool = False):
    """A UDF of the chosen steps; applying it twice changes nothing more."""
    straight = {ord(a): b for a, b in zip("‘’‚‛“”„‟«»", "''''\"\"\"\"\"\"")}

    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            t = unicodedata.normalize(form, t)
            if quotes:
                t = t.translate(straight)
            if diacritics:
                t = unicodedata.normalize(form, "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))
            if digits:
                t = "".join(str(unicodedata.decimal(c)) if unicodedata.decimal(c, None) is not None else c for c in t)
            if punctuation:
                t = "".join(" " if unicodedata.category(c)[0] == "P" else c for c in t)
            if case:
                t = {"lower": str.lower, "upper": str.upper, "fold": str.casefold}[case](t)
            return " ".join(t.split()) if whitespace else t

        return text.map(one, na_action="ignore")

    return run


_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"')\]]*\s+")


def sentences_of(text: str) -> list[str]:
    """Sentences of a text; a full stop after an abbreviation or an initial ends none."""
    parts: list[str] = []
    for piece in (p for line in text.split("\n") for p in _SENTENCE.split(line)):
        piece = piece.strip()
        if not piece:
            continue
        last = parts[-1].rsplit(" ", 1)[-1].rstrip(".").lower() if parts else ""
        if parts and parts[-1].endswith(".") and (last in ABBREVIATIONS or len(last) == 1 and last.isalpha()):
            parts[-1] += " " + piece
        else:
            parts.append(piece)
    return parts


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentences(text: pd.Series) -> pd.Series:
    """Sentences of each text."""
    return text.fillna("").map(sentences_of)


def syllables_of(word: str) -> int:
    """Vowel runs, without a silent final e; one at least."""
    w = re.sub(r"[^a-zà-ÿ]", "", word.lower())
    if not w:
        return 0
    n = len(re.findall(r"[aeiouyà-ÿ]+", w))
    if re.search(r"[^aeiouy]es?$|[^aeiouytd]ed$", w) and not re.search(r"[^aeiouy]les?$", w) and n > 1:
        n -= 1
    return max(1, n)


#: Score parts by audience: readability, repetition, structure, clarity, vocabulary.
TARGETS = {  # fixed values: weights of readability, repetition, structure, clarity, vocabulary
    "general": (0.30, 0.20, 0.15, 0.25, 0.10),
    "academic": (0.15, 0.20, 0.25, 0.25, 0.15),
    "marketing": (0.30, 0.20, 0.15, 0.30, 0.05),
    "technical": (0.20, 0.20, 0.20, 0.30, 0.10),
    "simple": (0.40, 0.15, 0.10, 0.30, 0.05),
}
#: Wordy phrases that lower clarity (fixed values).
WORDY = ["in order to", "due to the fact that", "at this point in time", "in the event that", "a large number of", "it is important to note", "for the purpose of"]


def quality_of(text: str, target: str = "general") -> dict:
    """Measures of one text, 0 to 100 each, and their weighted total."""
    toks = re.findall(r"[^\W_]+(?:'[^\W_]+)*", text.lower())
    sents = sentences_of(text) or ([text] if toks else [])
    n = len(toks)
    if not n:
        return {"words": 0, "sentences": 0, "asl": 0.0, "asw": 0.0, "flesch": 0.0, "grade_level": 0.0, "smog": 0.0, "repetition": 0.0, "structure": 0.0, "clarity": 0.0, "vocabulary": 0.0, "score": 0.0}
    syl = [syllables_of(t) for t in toks]
    asl, asw = n / len(sents), sum(syl) / n
    flesch = 206.835 - 1.015 * asl - 84.6 * asw
    grade_level = 0.39 * asl + 11.8 * asw - 15.59
    smog = 1.043 * math.sqrt(sum(s >= 3 for s in syl) * 30 / len(sents)) + 3.1291
    repeated = sum(a == b for a, b in zip(toks, toks[1:])) / n
    heads = [s.split()[0].lower() for s in sents if s.split()]
    openers = sum(a == b for a, b in zip(heads, heads[1:])) / max(1, len(heads))
    grams = [tuple(toks[i : i + 3]) for i in range(n - 2)]
    phrases = 1 - len(set(grams)) / len(grams) if grams else 0.0
    repetition = 100 - min(45, 220 * repeated) - min(25, 60 * openers) - min(30, 260 * phrases)
    lengths = [len(s.split()) for s in sents]
    spread = (sum((x - asl) ** 2 for x in lengths) / len(lengths)) ** 0.5 / max(asl, 1)
    paragraphs = [p for p in text.split("\n") if p.strip()]
    structure = 100 * (0.4 * min(1, spread / 0.4) + 0.3 * (1 if len(paragraphs) > 1 or n < 150 else 0.4) + 0.3 * (sum(s[-1:] in ".!?…\"'" for s in sents) / len(sents)))
    low = text.lower()
    clarity = max(0.0, 100 - 12 * sum(low.count(p) for p in WORDY) - 100 * sum(x > 35 for x in lengths) / len(lengths) * 0.6)
    span = min(100, n)
    ttr = sum(len(set(toks[i : i + span])) / span for i in range(0, n - span + 1, max(1, span // 4))) / len(range(0, n - span + 1, max(1, span // 4)))
    vocabulary = 100 * (0.55 * min(1, ttr / 0.8) + 0.45 * min(1, sum(len(t) > 6 for t in toks) / n / 0.3))
    parts = (max(0.0, min(100.0, flesch)), repetition, structure, clarity, vocabulary)
    score = sum(w * p for w, p in zip(TARGETS[target], parts))
    return {"words": n, "sentences": len(sents), "asl": asl, "asw": asw, "flesch": flesch, "grade_level": grade_level, "smog": smog, "repetition": repetition, "structure": structure, "clarity": clarity, "vocabulary": vocabulary, "score": score}


QUALITY_TYPE = "words long, sentences long, asl double, asw double, flesch double, grade_level double, smog double, repetition double, structure double, clarity double, vocabulary double, score double"


def quality(target: str = "general"):
    """A UDF: struct of the measures of each text."""

    @F.pandas_udf(QUALITY_TYPE)
    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([quality_of(t, target) for t in text.fillna("")])

    return run


#: Unicode scripts by code point range (fixed values of the Unicode standard).
SCRIPTS = [
    ("Latin", 0x41, 0x24F), ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F), ("Hebrew", 0x590, 0x5FF),
    ("Arabic", 0x600, 0x6FF), ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF), ("Tamil", 0xB80, 0xBFF), ("Thai", 0xE00, 0xE7F),
    ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x1F00, 0x1FFF), ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
]
RIGHT_TO_LEFT = ["Arabic", "Hebrew"]


def script_of_char(c: str) -> str | None:
    """Script of a letter, None for anything else."""
    if not c.isalpha():
        return None
    p = ord(c)
    return next((name for name, a, b in SCRIPTS if a <= p <= b), "Other")


@F.pandas_udf(T.MapType(T.StringType(), T.DoubleType()))
def script_shares(text: pd.Series) -> pd.Series:
    """Shares of the letters of each text by script."""

    def one(t: str) -> dict[str, float]:
        counts: dict[str, int] = {}
        for c in t:
            s = script_of_char(c)
            if s:
                counts[s] = counts.get(s, 0) + 1
        total = sum(counts.values())
        return {k: v / total for k, v in counts.items()}

    return text.fillna("").map(one)


def dominant_script(shares: Column) -> Column:
    """The script with the largest share; null without letters."""
    pairs = F.transform(F.map_entries(shares), lambda e: F.struct(e.value.alias("v"), e.key.alias("k")))
    return F.array_max(pairs)["k"]


def is_right_to_left(shares: Column) -> Column:
    """Whether most letters belong to scripts that run from the right."""
    parts = [F.coalesce(F.element_at(shares, s), F.lit(0.0)) for s in RIGHT_TO_LEFT]
    return sum(parts[1:], parts[0]) > 0.5


#: Greek and Cyrillic letters in Latin, ISO 843 and BGN (fixed values).
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", ["a", "v", "g", "d", "e", "z", "i", "th", "i", "k", "l", "m", "n", "x", "o", "p", "r", "s", "s", "t", "y", "f", "ch", "ps", "o"]))
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", ["a", "b", "v", "g", "d", "e", "yo", "zh", "z", "i", "y", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "kh", "ts", "ch", "sh", "shch", "", "y", "", "e", "yu", "ya"]))


def transliterate_of(text: str) -> str:
    """Greek and Cyrillic letters in Latin; other characters stay."""
    out = []
    for c in unicodedata.normalize("NFC", text):
        base = unicodedata.normalize("NFD", c.lower())[0] if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else c.lower()
        latin = GREEK.get(base) if base in GREEK else CYRILLIC.get(base)
        if latin is None:
            out.append(c)
        else:
            out.append(latin[:1].upper() + latin[1:] if c.isupper() else latin)
    return "".join(out)


@F.pandas_udf(T.StringType())
def transliterate(text: pd.Series) -> pd.Series:
    """Greek and Cyrillic texts in Latin letters."""
    return text.map(transliterate_of, na_action="ignore")


#: Common short words of some languages, from public frequency lists.
COMMON = {
    "en": "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were her all",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son les ou mais nous",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre",
    "it": "di e il la che in un a per è una sono del con non si da dei le al come più nel alla ma della ha anche gli",
    "nl": "de van het een en in is dat op te zijn met voor niet aan er die als om bij ook maar dan door naar heeft",
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou",
}
_COMMON_SETS = {k: frozenset(v.split()) for k, v in COMMON.items()}


def detect_of(text: str) -> tuple[str, float]:
    """Language by the share of common words, and how clear the choice is."""
    toks = re.findall(r"[^\W\d_]+", text.lower())
    letters = sum(map(len, toks))
    if letters < 3:
        return "und", 0.0
    scores = {k: sum(t in s for t in toks) / len(toks) for k, s in _COMMON_SETS.items()}
    top = sorted(scores, key=lambda k: (-scores[k], k))
    if scores[top[0]] == 0:
        return "und", 0.0
    power = {k: math.exp(5 * 3.5 * v) for k, v in scores.items()}
    return top[0], power[top[0]] / sum(power.values()) * min(1.0, letters / 24)


@F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())]))
def detect(text: pd.Series) -> pd.DataFrame:
    """Language of each text by common words, with a confidence of 0 to 1."""
    return pd.DataFrame([detect_of(t) for t in text.fillna("")], columns=["lang", "confidence"])
