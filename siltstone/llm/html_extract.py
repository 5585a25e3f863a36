"""Main text of web pages by deducing each host's template from equivalence classes.

A page is a sequence of tokens: tags with their path, and text runs with theirs. Tokens
of one host that occur equally often on every page of it share an occurrence vector;
tokens with one vector form an equivalence class. Vectors are compared by a random
linear hash, the sum over pages of count times a hash of the page, so that they add up
over partitions and a host of any size is never gathered in one place. Classes that
occur on enough pages of the host and whose tokens come in one order, with spans that
nest and don't cross, make up the template. What lies between template tokens are slots;
the article is read from them. An article or main element is a hint which slots to take.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import free_name, python_ready

#: A class is valid on a host with this many pages at least, if its tokens occur on this share of them.
LEAST_PAGES, LEAST_SHARE = 3, 0.6
#: Inside a main element, where pages may share an article, a text is template if its class is on this share of the pages with such an element.
MAIN_SHARE = 0.9
#: Token that stands for a text in a main element (other ids are not negative).
_MAIN = -1

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)",
    re.S,
)
#: One attribute after another, so that names are whole and values are not searched for names.
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|$)|'([^']*)(?:'|$)|([^\s"'>]+)))?""")
_RAW = ("script", "style", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "xmp", "title")
_RAW_END = {t: re.compile(rf"</{t}\s*[^>]*>", re.I) for t in _RAW}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot"
    " th thead tr ul".split()
)
#: Elements that never hold the article, and words in class, id or role that mark such elements.
_AWAY = set("head nav aside footer form button select menu dialog audio video".split())
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|notification\w*|alert|popup|modal"
    r"|sidebar\w*|side-?bar|widget\w*|nav|navbar|navigation|menu\w*|breadcrumb\w*|pagination|pager|footer\w*|masthead|site-?header|page-?header"
    r"|comment|comments|commentlist|respond|disqus|discussion|replies|reply|share|sharing|social\w*|related\w*|recommend\w*|newsletter|subscribe\w*|signup"
    r"|login|search\w*|toolbar|skip-?link|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
_CLOSED_BY = {  # an open element that a start tag of the key ends
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def parse(source: str) -> list[tuple[str, str, bool, bool]]:
    """Blocks and tags of a page in order: (path, text or '', inside an element that never holds the article, inside a main element).

    A tag has an empty text. Inline elements don't part a text; block elements do. Raw elements (scripts and such) and
    comments are left out. Unclosed and misnested tags are mended as browsers do in the common cases.
    """
    out: list[tuple[str, str, bool, bool]] = []
    stack: list[tuple[str, str, bool, bool]] = []  # name, path, away, main
    run: list[str] = []

    def flush() -> None:
        if run:
            text = " ".join(html_lib.unescape("".join(run)).split())
            run.clear()
            if text:
                _, path, away, main = stack[-1] if stack else ("", "", False, False)
                out.append((path, text, away, main))

    at = 0
    while at < len(source):
        found = _TOKEN.search(source, at)
        if not found:
            run.append(source[at:])
            break
        run.append(source[at : found.start()])
        at = found.end()
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        if found["close"]:
            if any(s[0] == name for s in stack):
                if name in _BLOCK:
                    flush()
                    while stack.pop()[0] != name:
                        pass
                    out.append((f"{stack[-1][1] if stack else ''}/{name}^", "", False, False))
            elif name == "p":
                flush()
            continue
        if name in _RAW:
            end = _RAW_END[name].search(source, at)
            at = end.end() if end else len(source)
            run.append(" ")
            continue
        if name == "br":
            run.append("\n")
            continue
        if name not in _BLOCK:
            continue
        flush()
        if name in _VOID:
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        closes = _CLOSED_BY.get(name)
        if closes:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    del stack[k:]
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        _, path, away, main = stack[-1] if stack else ("", "", False, False)
        marks = ""
        if found["attrs"]:
            attrs: dict[str, str] = {}
            for k, a, b, c in _ATTR.findall(found["attrs"]):
                attrs.setdefault(k.lower(), a or b or c)  # of two of one name the first counts
            marks = " ".join(attrs.get(k, "") for k in ("class", "id", "role"))
            hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
            away = away or hidden or bool(marks and name not in ("html", "body", "article", "main") and _MARKS.search(marks))
        away = away or name in _AWAY or (name == "header" and not main)
        main = main or name in ("article", "main") or bool(re.search(r"\bmain\b|articlebody", marks, re.I))
        path = f"{path}/{name}" + f".{marks}" * bool(marks)
        stack.append((name, path, away, main))
        out.append((path, "", away, main))
    flush()
    return out


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) >> 1


def tokens(page: list[tuple[str, str, bool, bool]]) -> list[int]:
    """Token ids of a parsed page: tags by path, texts by path and text."""
    return [_hash(f"{path}\0{text}") for path, text, _, _ in page]


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token, summed over a batch: hash of the occurrence vector, pages, occurrences, first and last place."""
    for batch in batches:
        sums: dict[tuple[str, int], list[int]] = {}
        for host, page, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
            weight = _hash(f"page {page}") & ((1 << 62) - 1)
            seen: dict[int, list[int]] = {}
            parsed = parse(source)
            inside = next((at for at, (_, text, away, main) in enumerate(parsed) if text and main and not away), None)
            if inside is not None:
                seen[_MAIN] = [1, inside, inside]
            for at, token in enumerate(tokens(parsed)):
                x = seen.setdefault(token, [0, at, at])
                x[0] += 1
                x[2] = at
            for token, (n, first, last) in seen.items():
                x = sums.setdefault((host, token), [0, 0, 0, 0, 0])
                x[0] = (x[0] + n * weight) % (1 << 62)
                x[1] += 1
                x[2] += n
                x[3] += first
                x[4] += last
        keys, values = list(sums), list(sums.values())
        arrays = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64())]
        arrays += [pa.array([v[i] for v in values], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays(arrays, ["host", "token", "vector", "pages", "n", "first", "last"])


def templates(pages: DataFrame) -> DataFrame:
    """host and the tokens of its template (sorted array), from a frame of host, page, source.

    A token whose class has less than MAIN_SHARE of the pages with a main element is given as -2 - token.
    """
    schema = "host string, token long, vector long, pages long, n long, first long, last long"
    counts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    vectors = (
        pages.mapInArrow(_occurrences, schema)
        .groupBy("host", "token")
        .agg(
            F.expr("sum(cast(vector as decimal(38,0))) % 4611686018427387904").cast("long").alias("vector"),
            *[F.sum(c).alias(c) for c in ("pages", "n", "first", "last")],
        )
        .where((F.col("pages") >= LEAST_PAGES) | (F.col("token") == _MAIN))
        .join(counts, "host")
        .where((F.col("pages") >= LEAST_SHARE * F.col("of")) | (F.col("token") == _MAIN))
    )
    # A class: mean span of its tokens; it is kept if no other class of the host crosses it (their spans nest or are apart).
    classes = vectors.groupBy("host", "vector").agg(
        F.min(F.col("first") / F.col("pages")).alias("a"), F.max(F.col("last") / F.col("pages")).alias("b"), F.max("pages").alias("support"), F.collect_set("token").alias("tokens")
    )
    listed = classes.groupBy("host").agg(F.collect_list(F.struct("a", "b", "support", "vector", "tokens")).alias("classes"))
    crossed = lambda c: F.exists(
        "classes", lambda o: (o.support > c.support) & (((o.a < c.a) & (c.a < o.b) & (o.b < c.b)) | ((c.a < o.a) & (o.a < c.b) & (c.b < o.b)))
    )
    valid = F.filter("classes", lambda c: ~crossed(c))
    mains = F.coalesce(F.get(F.filter("classes", lambda c: F.array_contains(c.tokens, _MAIN)), 0).support, F.lit(0))
    listed = listed.select("host", valid.alias("valid"), mains.alias("mains"))
    given = F.transform("valid", lambda c: F.transform(c.tokens, lambda t: F.when(c.support >= MAIN_SHARE * F.col("mains"), t).otherwise(-2 - t)))
    return listed.select("host", F.array_sort(F.array_distinct(F.flatten(given))).alias("template"))


def article(source: str, template: set[int]) -> list[str]:
    """Blocks of the article of one page, by its host's template (empty: unknown).

    Slots are what is left between template tokens: texts that the template has are dropped, inside a main element only
    those of classes with enough support there, as a host's pages may share an article. If a page has a main element,
    its slots are the article; if the template leaves none of them, all pages share that article, and it stays. Where no
    element is marked as main, all slots are, in the order of the page.
    """
    page = parse(source)
    ids = tokens(page) if template else []
    texts = [i for i, (_, text, away, _) in enumerate(page) if text and not away]
    mains = [i for i in texts if page[i][3]]
    if mains:
        return [page[i][1] for i in [i for i in mains if not (template and ids[i] in template)] or mains]
    slots = [i for i in texts if not (template and (ids[i] in template or -2 - ids[i] in template))]
    return [page[i][1] for i in slots]


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Columns of pages (those in ``keep``, or all but the source) with text (blocks joined by newline) and n_chars.

    Null sources and pages without a text have an empty text; null urls share one host without template; repeated rows
    are pages of their own; columns named text or n_chars are replaced; an empty table gives no row. Hosts with fewer
    than LEAST_PAGES pages have no template; their pages are read by structure alone.
    """
    keep = [c for c in (keep or [c for c in pages.columns if c != source]) if c.lower() not in ("text", "n_chars")]
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _HOST, 1))
    h, page, template = (free_name(pages.columns, x) for x in ("host", "page", "template"))
    body = F.coalesce(F.col(source), F.lit(""))
    rows = pages.select(host.alias("host"), F.coalesce(F.col(page_id).cast("string"), F.lit("")).alias("page"), body.alias("source"))
    python_ready(pages.sparkSession)
    found = templates(rows.where(F.col("host") != ""))
    wide = pages.select(*[F.col(f"`{c}`") for c in keep], host.alias(h), body.alias(page))
    joined = wide.join(found.toDF(h, template), h, "left").select(*[F.col(f"`{c}`") for c in keep], page, template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            texts = ["\n".join(article(s, set(t or ()))) for s, t in zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist())]
            arrays = [batch.column(i) for i in range(n - 2)] + [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "text", "n_chars"])

    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep] + ["text string", "n_chars long"])
    return joined.mapInArrow(run, schema)
