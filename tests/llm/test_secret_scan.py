"""Spans against patterns as stated, links against a comparison of every two parts of a text."""

import hashlib
import random
import re

from siltstone.llm import queries, secret_scan

BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = [*BASE, "identifier", "secret", "endpoint"]
PART = {"assign": "s", "access": "i", "hex": "s", "identifier": "i", "secret": "s", "endpoint": "e"}


def base(text):
    return [(k, *m.span()) for k, r in BASE.items() for m in r.finditer(text) if len(m[m.lastindex or 0]) >= LEAST[k]]


def spans(text):
    """Every two parts of a text are compared."""
    strong = base(text)
    weak = [w for w in secret_scan.weak_spans(text) if not any(w[1] < e and s < w[2] for _, s, e in strong)]
    out = list(strong)
    for k, s, e in weak:
        near = [(x in strong, PART[x[0]]) for x in strong + weak if PART[x[0]] != PART[k] and (x[1] >= e or x[2] <= s) and x[1] <= e + 200 and x[2] >= s - 200]
        if any(sure for sure, _ in near) or len({p for _, p in near}) == 2:
            out.append((k, s, e))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def line(found):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def expected(doc_id, text):
    found, strong = spans(text or ""), sorted(base(text or ""), key=lambda x: (x[1], KINDS.index(x[0])))
    counts = [sum(x[0] == k for x in strong) for k in BASE]
    return (doc_id, *counts, hashlib.sha256(line(strong).encode()).hexdigest(), line(found))


def test_query(spark, as_rows):
    sf = "/root/testdata/sf0.01"  # the smallest tables have no secret
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    names = "doc_id n_assign n_access n_hex base_sha256 spans".split()
    got = sorted(tuple(r[c] for c in names) for r in as_rows(queries.op11_secret_scan(spark, sf)))
    assert got == sorted(expected(*d) for d in docs)
    assert sum(r[1] for r in got) > 0


def planted(rng):
    hexes, caps = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    piece = [
        lambda: "AKIA" + "".join(rng.choices(caps, k=rng.choice([8, 16]))),
        lambda: "".join(rng.choices(hexes, k=rng.choice([12, 31, 32, 40]))),
        lambda: rng.choice(["PassWord", "token", "api_key", "APIKEY", "ſecret", "toKen"]) + rng.choice([" = ", ": \"", "='"]) + "".join(rng.choices(caps + hexes, k=rng.choice([3, 7, 8, 20]))),
        lambda: f"user = {rng.choice(['anna', 'bob'])}{rng.randrange(99)}",
        lambda: f"{rng.choice(['anna', 'bob'])}@mail.example.com",
        lambda: rng.choice(["https://db.example.com/x?y=1", "db.example.com:5432", "10.0.3.77", "host: db7"]),
        lambda: "".join(rng.choices(caps + hexes + "xyzqrs", k=24)),
        lambda: "".join(rng.choices(["plain ", "wörds \U0001f642 ", "and\n"], k=rng.choice([2, 30, 80]))),
    ]
    return rng.choice([" ", "\n", ", "]).join(rng.choice(piece)() for _ in range(rng.randrange(1, 30)))


def test_planted_texts(spark, as_rows):
    rng = random.Random(3)
    docs = [(k, planted(rng)) for k in range(300)]
    got = as_rows(secret_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"]))
    made = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in got}
    assert made == {k: spans(t) for k, t in docs}
    kinds = [s[0] for x in made.values() for s in x]
    assert all(kinds.count(k) > 20 for k in KINDS)


def test_weak_parts_alone_are_not_reported(spark, as_rows):
    texts = [
        "Write to anna@example.com or see https://example.com/help on port 10.1.1.1",
        "The word aB3dE5gH7jK9mN1pQ3sT5 alone",
        "anna@example.com used aB3dE5gH7jK9mN1pQ3sT5 once",
        "user = anna, password: hunter2, host = db.example.com",
        "user = anna" + " filler" * 60 + " password: hunter2, host = db.example.com",
        "anna@example.com token = abcdefgh12345678",
    ]
    got = as_rows(secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), ["k", "text"]))
    found = {r["k"]: [(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["spans"]] for r in got}
    assert found[0] == found[1] == found[2] == found[4] == []
    assert found[3] == [("identifier", "anna"), ("secret", "hunter2"), ("endpoint", "host = db.example.com")]
    assert found[5] == [("identifier", "anna@example.com"), ("assign", "token = abcdefgh12345678")]


def test_many_parts_in_one_text(spark, as_rows):
    text = " ".join(f"user = u{k} password: p{k}x! host = h{k}.example.com" for k in range(20_000))
    got = as_rows(secret_scan.scan(spark.createDataFrame([(text,), ("0" * 3_000_000,), ("a-" * 500_000,)], "text string"), []))
    assert sorted(len(r["spans"]) for r in got) == [0, 1, 60_000]


def test_redact(spark, as_rows):
    docs = spark.createDataFrame([(1, "é user = anna, password: hunter2, host = h.example.com!"), (2, "nothing"), (3, None), (4, "token = 0123456789abcdef0123456789abcdef end")], "id int, text string")
    got = {r["id"]: r["text"] for r in as_rows(secret_scan.redact(docs))}
    assert got == {1: "é user = [SECRET], password: [SECRET], [SECRET]!", 2: "nothing", 3: None, 4: "[SECRET] end"}


def test_odd_rows(spark, odd_docs, no_docs, as_rows):
    docs = odd_docs.withColumnRenamed("shard", "row").withColumnRenamed("offset", "Spans")
    out = secret_scan.scan(docs, docs.columns)
    assert out.columns == [*docs.columns, "spans_"]
    assert len(as_rows(out)) == docs.count()
    assert as_rows(secret_scan.scan(no_docs, ["doc_id"])) == []
