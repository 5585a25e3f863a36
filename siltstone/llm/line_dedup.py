"""Fuzzy deduplication of lines, in Spark expressions only.

Lines are normalised (lower case, runs of anything but letters and digits become one
space). Each gets a 64-bit SimHash of its word pairs, in BLOCKS blocks of bits: a pair
belongs to one block, by its hash, and votes for the bits of that block alone. So an
edit changes bits only in the blocks of the pairs that it touches: a changed word is in
two pairs, which leave three of five blocks as they are (pigeonhole). A pair's hash bits
are spread into lanes of packed integers, so that one plain sum counts many bits; PAIRS
neighbouring pairs are first counted bit by bit by carry-save adders, and sums are
combined before the shuffle. Distinct lines are joined on every choice of two
blocks, together with a cell of the logarithm of their length: neighbouring cells overlap
by as much as the lengths of linked lines may differ. Candidates are those within RADIUS
bits whose lengths fit; their edit similarity is verified.

A key has few bits, so that of many lines most pairs in a bucket meet by chance. Buckets of
two lines, nearly all of them, are judged from the bits in which their fingerprints differ
while keys are counted; what can't be linked is out before any join.

All lines of a bucket (lines with one key) are first compared with one of them, the same
in all buckets that it is in; what is linked gets one color (its component so far), in
all buckets at once. Then lines of another color than most of their bucket meet those of
other colors. Where such lines are many, pivots go on as in the first step, twice as many
each time. Only pairs within the radius leave a join, so the rows follow the number of
lines, not its square, and no link is lost.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import free_name, stash, unstash
from siltstone.llm._components import colored, merged
from siltstone.llm._filters import release

#: Fingerprints within RADIUS bits whose lines' edit similarity is SIMILARITY at least are linked.
RADIUS, SIMILARITY, BLOCKS = 12, 0.9, 5
#: Where both lines have as many words, the edit similarity is counted in words, else in characters.
LONG = 20
#: A cell of lengths is so many times as wide as linked lines may differ.
CELL = 4
#: Lines of other colors that meet the rest of their bucket; pivots of a bucket with more.
WHOLE, PIVOTS = 2048, 8
#: Texts whose lines are too short for so many words have sums in lanes of 16 bits, four to a long; others in lanes of 32 bits. No text's words fill a lane's lower bits, all but two.
WORDS = 1 << 14
#: Pairs of words that are counted in one row: as many as three planes of bits can count.
PAIRS = 7
#: Fewest and most slots of a filter, each of 64 bits; in between there is one a key. SLOTS where nobody counts keys.
LEAST_SLOTS, SLOTS, MOST_SLOTS = 1 << 10, 1 << 16, 1 << 20
#: The bits of block c are those from EDGES[c] below EDGES[c + 1].
EDGES = [64 * i // BLOCKS for i in range(BLOCKS + 1)]


def normalised(line: Column) -> Column:
    """Lower case; everything but letters and digits is a gap."""
    # A gap that is one space already, as most are, is no match.
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}](?:(?<! )[^\p{L}\p{N}]*+|[^\p{L}\p{N}]++)", " "))


def _planes(rows: DataFrame, keep: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """Rows with x_1, x_2 and x_4 for each name x: the bits of how many of x0, x1 ... have a bit set, for all 64 bits at once."""

    def adder(x: str, a: str, b: str, c: str, one: str, two: str) -> list[Column]:
        i, j, k = (F.col(f"{x}{n}") for n in (a, b, c))
        differ = i.bitwiseXOR(j)
        return [differ.bitwiseXOR(k).alias(f"{x}{one}"), i.bitwiseAND(j).bitwiseOR(k.bitwiseAND(differ)).alias(f"{x}{two}")]

    # Each step reads the columns of the one before twice, so Spark keeps the steps apart and computes each column once.
    rows = rows.select(*keep, *[c for x in names for c in [*adder(x, "0", "1", "2", "a", "d"), *adder(x, "3", "4", "5", "b", "e"), F.col(f"{x}6")]])
    rows = rows.select(*keep, *[c for x in names for c in [*adder(x, "a", "b", "6", "_1", "f"), F.col(f"{x}d"), F.col(f"{x}e")]])
    return rows.select(*keep, *[c for x in names for c in [F.col(f"{x}_1"), *adder(x, "d", "e", "f", "_2", "_4")]])


def _packed(x: str, group: int, lane: int) -> Column:
    """The counts of a long's lanes from the planes of a column, each in the lowest places of its lane."""
    many = 64 // lane
    lowest, spread = F.lit(sum(1 << (lane * i) for i in range(many))), F.lit(sum(1 << ((lane - 1) * i) for i in range(many)))
    out = None
    for place, plane in enumerate(("_1", "_2", "_4")):
        bits = F.shiftrightunsigned(f"{x}{plane}", many * group).bitwiseAND(F.lit((1 << many) - 1))
        own = F.shiftleft((bits * spread).bitwiseAND(lowest), place)
        out = own if out is None else out.bitwiseOR(own)
    return out


def line_table(docs: DataFrame, doc_id: str, text: str, lane: int | None = None) -> DataFrame:
    """One row per line that has a letter or digit: d, v (document and version of its text), p (line from 0), h (hash), f (fingerprint),
    e (bit set of the blocks that no pair votes for) and len (its characters)."""
    # A line with fewer characters has no WORDS words, even if an equal row doubles its votes. A line's words are known only
    # after the costly expressions, and a filter on them would be evaluated a second time, below them.
    few = F.lit(2 * WORDS - 1)
    short = (F.char_length(text) < few) | (F.array_max(F.transform(F.split(text, "\n"), lambda x: F.char_length(x))) < few)
    if lane is None:
        return line_table(docs.where(short), doc_id, text, 16).unionByName(line_table(docs.where(~short), doc_id, text, 32))
    # An inner explode of a column comes with a filter on its size, for which Spark evaluates the costly expressions a second time.
    texts = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("v"), F.col(text).alias("t"))
    lines = texts.select("d", "v", F.posexplode_outer(F.split("t", "\n")).alias("p", "line")).where(F.col("line").rlike(r"[\p{L}\p{N}]"))
    lines = lines.select("d", "v", "p", normalised(F.col("line")).alias("line"))
    return _prints(lines.select("d", "v", "p", F.xxhash64("line").alias("h"), F.char_length("line").alias("len"), F.split("line", " ").alias("w")), lane)


def _prints(split: DataFrame, lane: int) -> DataFrame:
    """Fingerprints of lines (d, v, p, h, len, w: words)."""
    many, own = 64 // lane, ("d", "v", "p", "h", "len")
    runs = split.select(*own, "w", F.explode_outer(F.sequence(F.lit(0), F.size("w") - 1, F.lit(PAIRS))).alias("i"))
    at = [F.col("i") + j for j in range(PAIRS + 1)]
    hashed = runs.select(*own, (F.size("w") - F.col("i")).alias("left"), *[F.xxhash64(F.get("w", x), F.get("w", y)).alias(f"x{j}") for j, (x, y) in enumerate(zip(at, at[1:]))])
    # A place behind the line's last word counts for a block that there is not.
    blocks = [F.when(F.col("left") > j, F.pmod(F.col(f"x{j}"), F.lit(BLOCKS)).cast("int")).otherwise(F.lit(BLOCKS)).alias(f"c{j}") for j in range(PAIRS)]
    placed = hashed.select(*own, *[f"x{j}" for j in range(PAIRS)], *blocks)
    none = F.lit(0).cast("long")
    masks = F.array(*[F.lit(_signed((1 << high) - (1 << low))).cast("long") for low, high in zip(EDGES, EDGES[1:])], none)
    marks = F.array(*[F.lit(1 << c).cast("long") for c in range(BLOCKS)], none)
    voted = placed.select(
        *own,
        *[F.col(f"x{j}").bitwiseAND(F.get(masks, F.col(f"c{j}"))).alias(f"x{j}") for j in range(PAIRS)],
        *[F.get(marks, F.col(f"c{j}")).alias(f"y{j}") for j in range(PAIRS)],
    )
    planes = _planes(voted, own, ("x", "y"))
    sums = planes.groupBy("d", "v", "p").agg(
        F.first("h").alias("h"),
        F.first("len").alias("len"),
        *[F.sum(_packed("y", g, lane)).alias(f"n{g}") for g in range(-(-BLOCKS // many))],  # blocks are counted in lanes too
        *[F.sum(_packed("x", g, lane)).alias(f"s{g}") for g in range(64 // many)],
    )

    # A bit is set where more than half of its block's pairs have it. Each lane's second highest bit is free, so one
    # subtraction compares all lanes of a long; written out bit by bit, the code would be too long to be compiled.
    def count(c: int) -> Column:
        lanes = F.coalesce(F.col(f"n{c // many}"), F.lit(0).cast("long"))
        return F.shiftrightunsigned(lanes, lane * (c % many)).bitwiseAND(F.lit((1 << lane) - 1))

    halves = [(F.shiftrightunsigned(count(c), 1) + 1).alias(f"m{c}") for c in range(BLOCKS)]
    empty = F.lit(0)
    for c in range(BLOCKS):
        empty = empty.bitwiseOR(F.when(count(c) == 0, F.lit(1 << c)).otherwise(F.lit(0)))
    counted = [F.coalesce(F.col(f"s{g}"), F.lit(0).cast("long")).alias(f"s{g}") for g in range(64 // many)]
    sums = sums.select("d", "v", "p", "h", "len", empty.alias("e"), *halves, *counted)
    print_, top = F.lit(0).cast("long"), sum(1 << (lane * i + lane - 2) for i in range(many))
    for g in range(64 // many):
        need = F.lit(0).cast("long")
        for c, (low, high) in enumerate(zip(EDGES, EDGES[1:])):
            own_lanes = sum(1 << (lane * i) for i in range(many) if low <= many * g + i < high)
            if own_lanes:
                need = need.bitwiseOR(F.col(f"m{c}") * F.lit(own_lanes))
        over = F.col(f"s{g}").bitwiseOR(F.lit(top)) - need
        for i in range(many):
            bit, at = many * g + i, lane * i + lane - 2
            moved = F.shiftrightunsigned(over, at - bit) if at >= bit else F.shiftleft(over, bit - at)
            print_ = print_.bitwiseOR(moved.bitwiseAND(F.lit(_signed(1 << bit))))
    return sums.select("d", "v", "p", "h", print_.alias("f"), "e", "len")


def _signed(x: int) -> int:
    """An unsigned 64-bit number as Spark's long."""
    return x - (1 << 64) if x >> 63 else x


def _cells(least: float) -> Column:
    """Cells of a line's length: one, or two near a cell's lower end. Lines whose lengths fit have one in common."""
    step = max(0.0, -math.log(least)) + 1e-6 if least > 0 else math.inf  # rounding may not part what _near lets pass
    at = F.log(F.col("len").cast("double")) / F.lit(CELL * step)
    return F.when(at - F.floor(at) <= 1 / CELL, F.array(F.floor(at), F.floor(at) - 1)).otherwise(F.array(F.floor(at)))


def _keys() -> Column:
    """Keys of a line in one cell: each two blocks that pairs vote for; the whole fingerprint where there are no two. Others are null."""
    parts = [F.shiftrightunsigned(F.col("f"), a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(EDGES, EDGES[1:])]
    out = []
    for i, j in combinations(range(BLOCKS), 2):
        some = F.col("e").bitwiseAND(F.lit(1 << i | 1 << j)) == 0
        out.append(F.when(some, F.xxhash64(F.lit(i * BLOCKS + j), parts[i], parts[j], "cell")))
    few = F.bit_count("e") > BLOCKS - 2
    out.append(F.when(few, F.xxhash64(F.lit(-1), "f", "e", "cell")))
    return F.array(*out)


def slots(keys: DataFrame) -> int:
    """Slots of a filter of keys: as many as keys, so that it passes the same share of others whatever the input, up to a bound for a broadcast."""
    return min(MOST_SLOTS, max(LEAST_SLOTS, keys.count()))


def bit_table(keys: DataFrame, column: str, many: int = SLOTS) -> DataFrame:
    """A bitmap of hashed keys as at most so many rows (slot, bits)."""
    bit = F.shiftrightunsigned(F.xxhash64(column), 58).cast("int")
    slot = F.pmod(F.xxhash64(column), F.lit(many))
    return keys.select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def maybe_in(rows: DataFrame, column: str, table: DataFrame, many: int = SLOTS) -> DataFrame:
    """Rows whose key may be in a bit_table of as many slots: a filter that loses none, so that the exact join after it shuffles few rows."""
    tested = rows.withColumn("slot", F.pmod(F.xxhash64(column), F.lit(many))).join(F.broadcast(table), "slot")
    return tested.where(F.expr(f"shiftrightunsigned(bits, cast(shiftrightunsigned(xxhash64({column}), 58) as int)) & 1 = 1")).drop("slot", "bits")


def _near(radius: int, least: float) -> Column:
    """Whether two lines (f, len and fb, lenb) may be linked."""
    short, long = F.least("len", "lenb"), F.greatest("len", "lenb")
    return (F.bit_count(F.col("f").bitwiseXOR(F.col("fb"))) <= radius) & (long - short <= F.floor(long * (1 - least) + 1e-9))


def _shared(rows: DataFrame, radius: int) -> DataFrame:
    """Keys of buckets that may hold a link: those of three lines or more, and of two lines that are within the radius."""
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("f").alias("x"))
    return sizes.where((F.col("n") > 2) | ((F.col("n") == 2) & (F.bit_count("x") <= radius))).select("k")


def find_links(docs: DataFrame, doc_id: str, text: str, points: DataFrame, radius: int, least: float) -> DataFrame:
    """(node, root) of lines that are linked: points are (h, f, e, len; d, p: where a document has it)."""
    spark = docs.sparkSession
    rows = points.select("h", "f", "e", "len", F.explode(_cells(least)).alias("cell")).select("h", "f", "len", F.explode(_keys()).alias("k")).where(F.col("k").isNotNull())
    sizes = stash(_shared(rows.select("k", "f"), radius), "buckets")
    # No semi-join: Spark would push it below the filter, and all keys would be shuffled. Keys are there once.
    many = slots(sizes)
    rows = stash(maybe_in(rows, "k", bit_table(sizes, "k", many), many).join(sizes, "k").select(*rows.columns), "members")
    unstash(sizes)
    release(spark)
    rank = F.shiftrightunsigned(F.xxhash64("h"), 11) / float(1 << 53)
    colors, stage = None, 0
    while True:
        seen = colored(rows, colors, "h")
        hues = seen.groupBy("k", "color").agg(F.count(F.lit(1)).alias("n"))
        mixed = hues.groupBy("k").agg(F.sum("n").alias("m"), F.max(F.struct("n", "color")).alias("top")).where(F.col("top.n") < F.col("m"))
        mixed = mixed.select("k", "m", (F.col("m") - F.col("top.n")).alias("q"), F.col("top.color").alias("main"))
        bucket = seen.join(mixed, "k")
        bucket = stash(bucket, "bucket")
        few = (F.col("q") <= WHOLE) if stage else F.lit(False)
        many = bucket.where(~few)
        lowest = many.groupBy("k").agg(F.min(F.struct(rank.alias("r"), "h")).alias("p")).select("k", "p.h")
        picked = many.select("k", "h", "f", "len", "color").join(lowest, ["k", "h"])
        if stage:
            picked = picked.unionByName(many.where(rank < F.lit(PIVOTS << stage) / F.col("m")).select(*picked.columns)).distinct()
        mates = bucket.where(few & (F.col("color") != F.col("main"))).select(*picked.columns).unionByName(picked)
        mates = mates.select("k", F.col("h").alias("b"), F.col("f").alias("fb"), F.col("len").alias("lenb"), F.col("color").alias("cb"))
        pairs = bucket.join(mates, "k").where((F.col("color") != F.col("cb")) & _near(radius, least))
        pairs = stash(pairs.select(F.least("h", "b").alias("a"), F.greatest("h", "b").alias("b")).distinct(), "pairs")
        new = stash(_verified(pairs, _texts(docs, doc_id, text, pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct().join(points.select("h", "d", "p"), "h")), least), "links")
        colors = merged(colors, new)
        unstash(pairs)
        unstash(new)
        if stage and not many.limit(1).count():
            unstash(bucket)
            return colors
        # Pivots have met all others of their bucket.
        left = many.join(picked.select("k", "h"), ["k", "h"], "left_anti") if stage else many
        old, rows = rows, stash(left.select("h", "f", "len", "k"), "members")
        unstash(bucket)
        unstash(old)
        release(spark)
        stage += 1


def _texts(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """(h, line) of the wanted hashes of lines, from the places d, p that have them."""
    wanted = stash(wanted.withColumn("at", F.xxhash64("d", "p")), "wanted")
    many = slots(wanted)
    of = maybe_in(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")), "d", bit_table(wanted, "d", many), many)
    raw = of.select("d", F.posexplode_outer(F.split("t", "\n")).alias("p", "line")).withColumn("at", F.xxhash64("d", "p"))
    raw = maybe_in(raw, "at", bit_table(wanted, "at", many), many).select(normalised(F.col("line")).alias("line"))
    found = maybe_in(raw.select(F.xxhash64("line").alias("h"), "line"), "h", bit_table(wanted, "h", many), many).join(wanted.select("h"), "h")
    return stash(found.groupBy("h").agg(F.first("line").alias("line")), "texts")


def _coded(line: Column) -> Column:
    """A line with one character a word, by a hash of the word: its edit distances are counted in words."""
    code = F.transform(F.split(line, " "), lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(50_000)) + F.lit(256)), 4, "0"))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-16BE")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs whose lines' edit similarity is ``least`` or more; texts: h, line.

    It is counted in words where both lines have LONG words or more, else in characters.
    """
    told = texts.select("h", F.when(F.size(F.split("line", " ")) >= LONG, _coded(F.col("line"))).alias("code"), "line")
    left = pairs.join(told.select(F.col("h").alias("a"), F.col("line").alias("la"), F.col("code").alias("ca")), "a")
    both = left.join(told.select(F.col("h").alias("b"), F.col("line").alias("lb"), F.col("code").alias("cb")), "b")
    words = F.col("ca").isNotNull() & F.col("cb").isNotNull()
    both = both.select("a", "b", F.when(words, F.col("ca")).otherwise(F.col("la")).alias("x"), F.when(words, F.col("cb")).otherwise(F.col("lb")).alias("y"))
    allowed = F.floor(F.greatest(F.char_length("x"), F.char_length("y")) * (1 - least) + 1e-9).cast("int")
    # With a limit, Spark computes only a band of the matrix, and gives -1 beyond it.
    return both.withColumn("allowed", allowed).where(F.expr("levenshtein(x, y, allowed) >= 0")).select("a", "b")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, least: float = SIMILARITY) -> DataFrame:
    """One row per line with a letter or digit: d, v, p, h, g (its group: the least hash in it) and kept.

    v is a hash of the document's text: equal rows (same id, same text) are one document, whose lines count once.
    """
    lines = stash(line_table(docs, doc_id, text), "lines")
    distinct = stash(lines.groupBy("h").agg(*[F.first(c).alias(c) for c in ("f", "e", "len", "d", "p")]), "distinct-lines")
    roots = find_links(docs, doc_id, text, distinct, radius, least).select(F.col("node").alias("h"), "root")
    unstash(distinct)
    grouped = stash(lines.select("d", "v", "p", "h").join(roots, "h", "left").select("d", "v", "p", "h", F.coalesce("root", "h").alias("g")), "grouped-lines")
    unstash(lines)
    first = grouped.groupBy("g").agg(F.min(F.struct("d", "v", "p")).alias("first"))
    return grouped.join(first, "g").select("d", "v", "p", "h", "g", F.struct("d", "v", "p").eqNullSafe(F.col("first")).alias("kept"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, least: float = SIMILARITY) -> DataFrame:
    """docs with every line dropped that is not the first of its group; all columns stay, rows in any order.

    Lines without letters or digits are never dropped. Null texts stay null. Equal rows keep the same lines. A document
    all of whose lines are dropped has an empty text. Null ids come first in the order of occurrences.
    """
    v, d, w, gone = (free_name(docs.columns, x) for x in ("version", "of_doc", "of_version", "gone"))
    out = groups(docs, doc_id, text, radius, least).where(~F.col("kept")).groupBy(F.col("d").alias(d), F.col("v").alias(w)).agg(F.collect_set("p").alias(gone))
    marked = docs.withColumn(v, F.xxhash64(text))
    joined = marked.join(out, F.col(f"`{doc_id}`").eqNullSafe(F.col(d)) & (F.col(v) == F.col(w)), "left")
    lines = F.split(F.col(text), "\n")
    left = F.array_join(F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains(gone, i), x)), lambda x: x.isNotNull()), "\n")
    return joined.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(left)).select(*[f"`{c}`" for c in docs.columns])
