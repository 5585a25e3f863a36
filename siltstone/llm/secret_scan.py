"""Secrets in texts: strong spans by pattern, weak ones only where parts of a credential stand together.

A credential has an identifier, a secret and an endpoint. Some parts show by themselves:
access keys (identifier), assigned secrets and long hex runs (secret). Others are weak: a
user name, an e-mail address, a short password, a random-looking word, a URL or an address
with a port may mean nothing. A weak part is reported only if a strong part of another kind
lies in its scope, or weak parts of both other kinds do.

Python workers mark the parts of each text, the texts stay where they are. Parts are then
joined by their intervals: a part reaches SCOPE characters to both sides, intervals are laid
over cells of the text, and parts that share a cell of one document are compared. Cells
bound what is compared: a document of a million parts is spread over its cells.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from siltstone.llm import _shingles as S
from siltstone.llm._common import free_name, python_ready, stash

#: Characters to either side of a part that are its scope, and of a cell.
SCOPE, CELL = 200, 512
#: Kinds in the order in which spans that start together are listed; the first three need no other part.
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]
#: The part of a credential that each kind is: 1 identifier, 2 secret, 4 endpoint.
PARTS = {"assign": 2, "access": 1, "hex": 2, "identifier": 1, "secret": 2, "endpoint": 4}

ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Weak parts. Of an assignment the part is its value.
NAMED = re.compile(r"""(?i)\b(?:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?(?:key_?)?id)["']?\x20*[:=]\x20*["']?([\w.@+-]{2,64})""", re.ASCII)
MAIL = re.compile(r"[A-Za-z0-9_.+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}")
SHORT = re.compile(r"""(?i)\b(?:pass(?:word|wd|phrase)?|pwd|secret|token|credentials?|auth|(?:api|private|access|secret)_?key)["']?\x20*[:=]\x20*["']?([^\s"',;]{4,})""", re.ASCII)
RANDOM = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PLACE = re.compile(r"""(?i)\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|\b(?:host(?:name)?|server|endpoint|base_?url)["']?\x20*[:=]\x20*["']?[\w.:/-]{3,}|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?(?![\w.]*\d)|\b[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){1,8}:\d{2,5}\b""", re.ASCII)
#: A text without any of these has no strong part and no two parts: marked for whole batches, before any text is looked at.
ANY = r"""AKIA[A-Z0-9]|[0-9a-f]{32}|(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
WEAK_SECRET = r"""[A-Za-z0-9+/_=-]{20}|(?i:pass|passphrase|pwd|credentials?|auth|key)["']?\x20*[:=]"""

SPAN = "struct<kind:string,start:bigint,end:bigint>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Strong spans: (kind, start, end) in characters, leftmost and without overlap within a kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def random_looking(word: str) -> bool:
    """Whether a word has capital and small letters and digits and at least 3.5 bits a character."""
    if not (any(c.isdigit() for c in word) and any(c.isupper() for c in word) and any(c.islower() for c in word)):
        return False
    n = len(word)
    return -sum(k / n * math.log2(k / n) for k in Counter(word).values()) >= 3.5


def weak_spans(text: str) -> list[tuple[str, int, int]]:
    """Weak spans, of one kind without overlap."""
    found = [("identifier", *m.span(1)) for m in NAMED.finditer(text)] + [("identifier", *m.span()) for m in MAIL.finditer(text)]
    found += [("secret", *m.span(1)) for m in SHORT.finditer(text)]
    found += [("secret", *m.span()) for m in RANDOM.finditer(text) if random_looking(m[0])]
    found += [("endpoint", *m.span()) for m in PLACE.finditer(text)]
    out, ends = [], {}
    for kind, start, end in sorted(found, key=lambda s: (s[1], -s[2], s[0])):
        if start >= ends.get(kind, 0):
            out.append((kind, start, end))
            ends[kind] = end
    return out


def parts_of(texts: pa.Array) -> tuple[list[list], list[list]]:
    """Strong and weak spans of each text. Weak spans that touch a strong one of the same text are left out."""
    strong = pc.match_substring_regex(texts, ANY).fill_null(False).to_pylist()
    weak = pc.match_substring_regex(texts, WEAK_SECRET).fill_null(False).to_pylist()
    bases, others = [], []
    for k, (s, w) in enumerate(zip(strong, weak)):
        base, rest = [], []
        if s or w:  # without a secret of either sort, or an access key, nothing is ever linked
            text = texts[k].as_py()
            base = base_spans(text)
            covered = sorted((a, b) for _, a, b in base)
            rest = _clear(weak_spans(text), covered)
        bases.append(base)
        others.append(rest)
    return bases, others


def _clear(spans: list[tuple[str, int, int]], covered: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The spans, by start, that overlap none of the covered ones."""
    out, at, reach = [], 0, 0
    for kind, start, end in spans:
        while at < len(covered) and covered[at][0] < end:
            reach = max(reach, covered[at][1])
            at += 1
        if start >= reach:
            out.append((kind, start, end))
    return out


def marked(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, ``row`` (a number of its own for each row), ``strong`` and ``weak`` spans; written to the shared folder."""
    python_ready(docs.sparkSession)
    names: list[str] = []
    for name in ("row", "strong", "weak"):
        names.append(free_name([*keep, *names], name))
    added = {names[0]: "bigint", names[1]: f"array<{SPAN}>", names[2]: f"array<{SPAN}>"}
    schema = docs.select(*keep, *[F.lit(None).cast(t).alias(c) for c, t in added.items()]).schema
    kind = to_arrow_schema(schema).field(names[1]).type

    def spans(lists: list[list]) -> pa.Array:
        return pa.array([[dict(zip(("kind", "start", "end"), s)) for s in x] for x in lists], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            last = batch.num_columns - 1
            for part in S.slices(batch, last):
                strong, weak = parts_of(part.column(last))
                arrays = [*part.columns[:last], pa.array(range(row, row + part.num_rows), pa.int64()), spans(strong), spans(weak)]
                yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names[:last], *names])
                row += part.num_rows

    hidden = free_name(docs.columns, "text to scan")
    return stash(docs.select(*keep, F.col(text).alias(hidden)).mapInArrow(run, schema), "parts")


def linked(parts: DataFrame) -> DataFrame:
    """(row, kind, start, end): the weak ones of ``parts`` (row, kind, start, end, strong) that other parts of a credential confirm.

    Intervals overlap in a join on the cells that they lie in. A pair may meet in several cells; what a part has met is
    gathered as bits, so that this changes nothing.
    """
    part = F.element_at(F.create_map(*[F.lit(x) for k, v in PARTS.items() for x in (k, v)]), F.col("kind"))
    rows = parts.withColumn("part", part)
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / CELL), F.floor(b / CELL)))
    weak = rows.where(~F.col("strong")).withColumn("cell", cells(F.greatest(F.lit(0), F.col("start") - SCOPE), F.col("end") + SCOPE))
    others = rows.select("row", F.col("start").alias("s"), F.col("end").alias("e"), F.col("part").alias("p"), "strong", cells(F.col("start"), F.col("end") - 1).alias("cell"))
    near = (F.col("p") != F.col("part")) & (F.col("s") <= F.col("end") + SCOPE) & (F.col("e") >= F.col("start") - SCOPE)
    apart = (F.col("s") >= F.col("end")) | (F.col("e") <= F.col("start"))
    met = weak.drop("strong").join(others, ["row", "cell"]).where(near & apart)
    seen = met.groupBy("row", "kind", "start", "end").agg(F.bit_or(F.col("p")).alias("kinds"), F.bool_or("strong").alias("sure"), F.max("part").alias("part"))
    return seen.where(F.col("sure") | (F.col("kinds").bitwiseOR(F.col("part")) == 7)).select("row", "kind", "start", "end")


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns of every row, with ``spans``: array of (kind, start, end), by start, then kind as in KINDS, then end.

    Places count characters (code points), ends are exclusive. Spans of assign, access and hex are always there; those of
    identifier, secret and endpoint only where linked. A null or empty text has none. Repeated rows each get theirs; an
    empty table gives no row. A kept column named spans keeps its name, the new one gets an underscore.
    """
    found = marked(docs, keep, text)
    row, strong, weak = found.columns[len(keep) :]
    alone = found.select(F.col(row).alias("row"), F.col(strong).alias("strong"), F.col(weak).alias("weak")).where(F.size("weak") > 0)
    each = lambda column, sure: alone.select("row", F.explode(column).alias("s"), F.lit(sure).alias("strong")).select("row", "s.*", "strong")
    links = linked(each("strong", True).unionByName(each("weak", False)))
    extra, more = free_name(found.columns, "extra"), free_name(found.columns, "row of parts")
    lists = links.groupBy(F.col("row").alias(more)).agg(F.collect_list(F.struct("kind", "start", "end")).alias(extra))  # spans of one document
    both = found.join(lists, F.col(row) == F.col(more), "left")
    order = F.create_map(*[F.lit(x) for kv in zip(KINDS, range(len(KINDS))) for x in kv])
    sortable = F.transform(F.concat(strong, F.coalesce(extra, F.array().cast(f"array<{SPAN}>"))), lambda s: F.struct(s["start"], F.element_at(order, s["kind"]).alias("rank"), s["end"], s["kind"]))
    spans = F.transform(F.array_sort(sortable), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return both.select(*keep, spans.alias(free_name(keep, "spans")))


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts and digests of the rows of scan()."""
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(KINDS[:3]))
    return found.select(
        doc_id, *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans")
    )


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of scan() in the text replaced by a mask; spans that overlap are replaced together."""
    spans = free_name(docs.columns, "spans")
    found = scan(docs, docs.columns, text)
    # Each span's characters are joined with what lies before it; a span inside what is gone already adds nothing.
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
        F.struct(
            F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask))).otherwise(F.lit(""))).alias("out"),
            s["end"].alias("at"),
        )
    )
    done = F.reduce(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return found.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(F.col(text))).select(*docs.columns)
