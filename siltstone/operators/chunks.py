"""Texts in chunks, and markup as text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "array<struct<start:int,end:int,core_start:int,text:string>>"


def fixed_words(df: DataFrame, id_col: str, text: str, size: int, overlap: int = 0) -> DataFrame:
    """(id, chunk, text): runs of ``size`` words, each starting size - overlap words after the one before."""
    w = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\r\n]+"), "")
    rows = df.select(F.col(id_col).alias("id"), w.alias("w")).where(F.size("w") > 0)
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - overlap) / step) - 1).cast("int")
    return rows.select("id", "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk")).select(
        "id", "chunk", F.array_join(F.slice("w", F.col("chunk") * step + 1, size), " ").alias("text")
    )


_CUTS = [r"\n#{1,6} ", r"\n\s*\n", r"\n", r"(?<=[.!?])\s+", r"\s+"]


def _tile(text: str, a: int, b: int, size: int, level: int) -> list[tuple[int, int]]:
    """Spans that tile [a, b), each of at most ``size`` characters where a cut allows it; coarse cuts first."""
    if b - a <= size:
        return [(a, b)]
    if level == len(_CUTS):
        return [(i, min(b, i + size)) for i in range(a, b, size)]
    edges = [a] + [m.end() if level > 0 else m.start() + 1 for m in re.compile(_CUTS[level]).finditer(text, a, b)] + [b]
    edges = sorted(set(e for e in edges if a <= e <= b))
    if len(edges) == 2:
        return _tile(text, a, b, size, level + 1)
    out: list[tuple[int, int]] = []
    for x, y in zip(edges, edges[1:]):
        for u, v in _tile(text, x, y, size, level + 1):
            if out and out[-1][1] == u and v - out[-1][0] <= size:
                out[-1] = (out[-1][0], v)
            else:
                out.append((u, v))
    return out


def chunks_of(text: str, size: int, overlap: int) -> list[dict]:
    """Chunks whose cores tile the text; each begins up to ``overlap`` characters earlier, at a word."""
    out = []
    for a, b in _tile(text, 0, len(text), size, 0):
        start = a
        if overlap and a:
            start = max(0, a - overlap)
            space = re.compile(r"\s").search(text, start, a)
            start = space.end() if space else a
        out.append({"start": start, "end": b, "core_start": a, "text": text[start:b]})
    return out


def recursive(size: int = 512, overlap: int = 64):
    """A UDF of chunks by headings, paragraphs, lines, sentences and words."""

    @F.pandas_udf(CHUNK)
    def run(text: pd.Series) -> pd.Series:
        return text.fillna("").map(lambda t: chunks_of(t, size, overlap) if t else [])

    return run


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "table", "article", "section"):
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0
        if tag in ("p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "title"):
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def html_text_of(source: str) -> str:
    """All visible text of a page, one block a line."""
    r = _Reader()
    r.feed(source)
    lines = (" ".join(x.split()) for x in "".join(r.parts).split("\n"))
    return "\n".join(x for x in lines if x)


@F.pandas_udf(T.StringType())
def html_text(source: pd.Series) -> pd.Series:
    """Visible text of each page."""
    return source.fillna("").map(html_text_of)
