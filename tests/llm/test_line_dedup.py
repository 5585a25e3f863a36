"""Fuzzy lines against brute force over all pairs of lines."""

import random
import re

import pytest
import xxhash

from siltstone.llm import line_dedup as L


def norm(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def votes(weighted):
    """Fingerprint and bit set of the blocks without a vote, of hashes and how often each counts."""
    print_ = empty = 0
    for c, (low, high) in enumerate(zip(L.EDGES, L.EDGES[1:])):
        own = [(x, n) for x, n in weighted if (x - (1 << 64) if x >> 63 else x) % L.BLOCKS == c]
        total = sum(n for _, n in own)
        empty |= 0 if own else 1 << c
        print_ |= sum(1 << b for b in range(low, high) if 2 * sum(n for x, n in own if x >> b & 1) > total)
    return print_, empty


def pair_hash(a, b):
    x = xxhash.xxh64_intdigest(a, seed=42)
    return x if b is None else xxhash.xxh64_intdigest(b, seed=x)


def fingerprint(line):
    w = line.split(" ")
    return votes([(pair_hash(a, b), 1) for a, b in zip(w, w[1:] + [None])])


def candidates(x, y):
    (f, e), (g, h) = x, y
    if (f ^ g).bit_count() > L.RADIUS:
        return False
    same = [c for c, (a, b) in enumerate(zip(L.EDGES, L.EDGES[1:])) if not (e | h) >> c & 1 and not (f ^ g) >> a & (1 << b - a) - 1]
    return len(same) > 1 or (x == y and e.bit_count() > L.BLOCKS - 2)


def similar(x, y, least=0.9):
    if min(len(x), len(y)) < max(len(x), len(y)) - int(max(len(x), len(y)) * (1 - least) + 1e-9):
        return False
    if min(len(x.split()), len(y.split())) >= L.LONG:
        x, y = x.split(), y.split()
    return edits(x, y) <= int(max(len(x), len(y)) * (1 - least) + 1e-9)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def brute(docs):
    occ = [(d, p, norm(x)) for d, t in docs for p, x in enumerate((t or "").split("\n")) if norm(x)]
    lines = sorted({o[2] for o in occ})
    prints = [fingerprint(x) for x in lines]
    parent = {x: x for x in lines}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(lines):
        for j in range(i):
            if candidates(prints[i], prints[j]) and similar(x, lines[j]):
                parent[find(x)] = find(lines[j])
    first = {}
    for d, p, x in sorted(occ):
        first.setdefault(find(x), (d, p))
    return {(d, p): first[find(x)] == (d, p) for d, p, x in occ}


def near_lines(n=24):
    base = [f"w{i * 7 % 101}" for i in range(150)]
    docs = []
    for k in range(n):
        own = list(base)
        own[k % 150] = own[k % 150] + "x"
        docs.append((k, " ".join(own) + f"\nalone number {k} with words {k * k}\nThe SAME line, every time!"))
    return docs


@pytest.mark.parametrize("whole", [2048, 1])
def test_agrees_with_brute_force(spark, as_rows, monkeypatch, whole):
    monkeypatch.setattr(L, "WHOLE", whole)
    docs = near_lines()
    got = {(r["d"], r["p"]): r["kept"] for r in as_rows(L.groups(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert got == brute(docs)
    assert sum(got.values()) < len(got)


def test_every_word_of_a_very_long_line_counts(spark, as_rows):
    from collections import Counter

    n = (1 << 20) + 10
    w = [f"w{i * i % 97}" for i in range(n)]
    got = as_rows(L.line_table(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string"), "doc_id", "text"))
    weighted = [(pair_hash(a, b), many) for (a, b), many in Counter(zip(w, w[1:] + [None])).items()]
    assert len(got) == 1 and got[0]["f"] & ((1 << 64) - 1) == votes(weighted)[0]


def test_recall_of_lines_with_an_edited_word(spark, as_rows):
    """Of lines of 20 to 100 words and one word changed, dropped or added, nine in ten at least are found."""
    rng = random.Random(3)
    docs = []
    for k in range(300):
        w = [f"v{rng.randrange(5000)}" for _ in range(rng.randint(20, 100))]
        other, at = list(w), rng.randrange(len(w))
        other[at : at + rng.choice([0, 1])] = rng.choice([[], [f"x{k}"]])
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    kept = {r["d"]: r["kept"] for r in as_rows(L.groups(spark.createDataFrame(docs, "doc_id long, text string")))}
    told = [k for k in range(300) if similar(docs[2 * k][1], docs[2 * k + 1][1])]
    found = sum(not kept[2 * k + 1] for k in told) / len(told)
    print(f"recall {found:.3f} of {len(told)}")
    assert len(told) > 250 and found >= 0.9 and all(kept[2 * k] for k in told)


def test_texts(spark, as_rows):
    docs = [(1, "First line of all\n\n--\nshared words in a line"), (2, "shared words in a LINE!\nown words"), (3, None), (4, "first line of all")]
    got = {r["doc_id"]: r["text"] for r in as_rows(L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert got == {1: docs[0][1], 2: "own words", 3: None, 4: ""}


def test_odd_rows(odd_docs, no_docs, as_rows):
    out = L.dedup_lines(odd_docs)
    assert out.columns == odd_docs.columns
    rows = as_rows(out)
    assert len(rows) == odd_docs.count()
    assert {r["doc_id"]: r["text"] for r in rows}[9] == "" and {r["doc_id"]: r["text"] for r in rows}[8] == "one"
    assert as_rows(L.dedup_lines(no_docs)) == []


def test_lines_that_meet_by_chance_are_out_before_a_join(spark, as_rows, monkeypatch):
    """Of 60,000 random fingerprints some 370 pairs share two blocks, a number that grows with the square of the lines."""
    from pyspark.sql import functions as F

    seen, stash = [], L.stash

    def counted(df, name):
        out = stash(df, name)
        if name == "members":
            seen.append(out.count())
        return out

    monkeypatch.setattr(L, "stash", counted)
    ids = spark.range(60_000).select(F.xxhash64("id").alias("h"), F.xxhash64("id", F.lit(1)).alias("f"), F.lit(0).alias("e"), (F.col("id") % 500 + 20).cast("int").alias("len"), F.col("id").alias("d"), F.lit(0).alias("p"))
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert as_rows(L.find_links(docs, "doc_id", "text", ids, L.RADIUS, L.SIMILARITY)) == []
    assert seen and seen[0] <= 60


@pytest.mark.parametrize("least", [0.9, 0.5, 1.0])
def test_lengths_that_fit_share_a_cell(spark, least):
    from pyspark.sql import functions as F

    cells = {r["len"]: set(r["c"]) for r in spark.range(1, 701).select(F.col("id").cast("int").alias("len")).select("len", L._cells(least).alias("c")).collect()}
    fit = [(a, b) for b in cells for a in range(1, b + 1) if b - a <= int(b * (1 - least) + 1e-9)]
    assert len(fit) >= 700 and all(cells[a] & cells[b] for a, b in fit)
    assert sum(map(len, cells.values())) <= 1.5 * len(cells)


def test_keys_of_single_lines_are_out_before_the_exact_join(spark, monkeypatch):
    """A semi-join would be pushed below the filter of keys, and all keys of all lines would be shuffled."""
    from pyspark.sql import functions as F

    plans, stash = [], L.stash

    def seen(df, name):
        if name == "members" and not plans:
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stash(df, name)

    monkeypatch.setattr(L, "stash", seen)
    ids = spark.range(200).select(F.xxhash64("id").alias("h"), F.xxhash64("id", F.lit(1)).alias("f"), F.lit(0).alias("e"), F.lit(20).alias("len"), F.col("id").alias("d"), F.lit(0).alias("p"))
    L.find_links(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", ids, L.RADIUS, L.SIMILARITY)
    joins = [x for x in plans[0].splitlines() if "Join " in x]
    assert len(joins) == 2 and "slot#" not in joins[0] and "slot#" in joins[1]


@pytest.mark.parametrize("n", [20_000, 400_000])
def test_filters_pass_the_same_share_of_others_at_any_size(spark, n):
    keys, others = spark.range(n).toDF("k"), spark.range(1 << 40, (1 << 40) + 200_000).toDF("k")
    many = L.slots(keys)
    assert L.maybe_in(keys, "k", L.bit_table(keys, "k", many), many).count() == n
    assert 2000 < L.maybe_in(others, "k", L.bit_table(keys, "k", many), many).count() < 4500


def test_costly_expressions_of_lines_are_not_evaluated_for_a_filter(spark, sf):
    """An inner explode adds a filter on the size of what it takes apart, and with it a second evaluation."""
    plan = L.line_table(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text", 16)._jdf.queryExecution().optimizedPlan().toString()
    filters = "".join(re.findall(r"^[ :+-]*Filter .*", plan, re.M))
    assert "RLIKE" in filters and "regexp_replace" not in filters and "size(" not in filters


def test_counts_of_lines_of_any_number_of_words(spark, as_rows):
    """Words are counted PAIRS at a time; the last row of a line may have fewer."""
    docs = [(n, " ".join(f"u{i * 5 % 9}" for i in range(n))) for n in [*range(1, 4 * L.PAIRS), 127, 128, 129]]
    got = as_rows(L.line_table(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text"))
    assert {r["d"]: (r["f"] & ((1 << 64) - 1), r["e"]) for r in got} == {n: fingerprint(t) for n, t in docs}


def test_gaps(spark, as_rows):
    lines = ["", " ", "a", " a  b ", "a-b", "a - b", "a -b", "a- b", "--a", "a--", "Ä\u00a0ß", "x\t y", "\u0130I 1\u2167", "a . . b", "  ,a,  b  ,"]
    want = [re.sub(r"[^a-zäß0-9\u2170-\u217fı]+", " ", x.lower()).strip() for x in lines]
    got = {r["i"]: r["x"] for r in as_rows(spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", L.normalised(L.F.col("line")).alias("x")))}
    assert got == dict(enumerate(want))
