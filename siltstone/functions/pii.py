"""Personal data: patterns, validators and masks, as native expressions where they can be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns without lookaround, so that Java and RE2 read them alike (fixed values).
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ipv4": r"\b(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}\b",
    "phone": r"(\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}\b",
    "card": r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b",
    "url": r"https?://[^ \t\n<>]+",
    "iban": r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
#: How sensitive each kind is.
RISK = {"email": "medium", "ipv4": "low", "phone": "medium", "card": "high", "url": "low", "iban": "high", "ssn": "high"}


def has(text: Column, kind: str) -> Column:
    """Whether a text holds something of a kind; null counts as no."""
    return F.coalesce(text.rlike(PATTERNS[kind]), F.lit(False))


def luhn_valid(digits: Column) -> Column:
    """The check digit of a number of 12 to 19 digits; spaces and hyphens don't count."""
    bare = F.regexp_replace(digits, "[ -]", "")
    return F.coalesce(bare.rlike("^[0-9]{12,19}$") & F.call_function("luhn_check", bare), F.lit(False))


def verhoeff_valid(digits: Column) -> Column:
    """Verhoeff's check digit, by the multiplication table of the dihedral group of ten elements."""
    d = [[(i + j) % 5 if i < 5 and j < 5 else 5 + (i + j - 5) % 5 if i < 5 else 5 + (i - 5 - j) % 5 if j < 5 else (i - j) % 5 for j in range(10)] for i in range(10)]
    first = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    p = [list(range(10))]
    for _ in range(7):
        p.append([first[p[-1][j]] for j in range(10)])
    mult, perm = (F.array(*[F.lit(x) for row in t for x in row]) for t in (d, p))
    reverse = F.split(F.reverse(digits), "")
    ok = F.aggregate(
        F.transform(reverse, lambda c, i: F.get(perm, (i % 8) * 10 + c.cast("int"))), F.lit(0), lambda a, x: F.get(mult, a * 10 + x)
    )
    return F.when(digits.rlike("^[0-9]+$"), ok == 0).otherwise(F.lit(False))


def masked(text: Column, kind: str, strategy: str = "redact", salt: str = "") -> Column:
    """A text with what is found of a kind redacted ([EMAIL]) or, for whole values, hashed or cut to the last four characters."""
    if strategy == "hash":
        return F.substr(F.sha2(F.concat(F.lit(salt), text), 256), F.lit(1), F.lit(12))
    if strategy == "last4":
        return F.concat(F.repeat(F.lit("*"), F.greatest(F.char_length(text) - 4, F.lit(0))), F.substr(text, F.greatest(F.char_length(text) - 3, F.lit(1))))
    return F.regexp_replace(text, PATTERNS[kind], f"[{kind.upper()}]")


def masked_all(text: Column) -> Column:
    """All kinds redacted, the longer patterns first."""
    for kind in ("url", "email", "iban", "card", "ssn", "phone", "ipv4"):
        text = masked(text, kind)
    return text


def scan(df: DataFrame, columns: list[str], least: float = 0.0) -> DataFrame:
    """column, kind, n, share, risk: how many known values of each text column hold each kind; one pass over all rows."""
    flags = [F.struct(F.lit(k).alias("kind"), has(F.col("v"), k).alias("hit")) for k in PATTERNS]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns])).alias("s")).select("s.*").where("v is not null")
    flat = long.select("column", F.explode(F.array(*flags)).alias("f")).select("column", "f.*")
    risk = F.create_map(*[F.lit(x) for k, v in RISK.items() for x in (k, v)])
    out = flat.groupBy("column", "kind").agg(F.sum(F.col("hit").cast("long")).alias("n"), F.avg(F.col("hit").cast("double")).alias("share"))
    return out.where((F.col("n") > 0) & (F.col("share") >= least)).withColumn("risk", risk[F.col("kind")])
