"""Queries over texts: duplicates, search, personal data, quality, chunks, conversations, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import pii
from siltstone.functions import text as X
from siltstone.operators import chunks, dedup, dialogue, prepare, retrieve
from siltstone.plans import query
from siltstone.plans.profiling import _rounded
from siltstone.sources.tables import table

_NORM = r"trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(
    "exact_dups",
    f"""WITH k AS (SELECT doc_id AS id, {_NORM} AS t FROM documents), g AS (SELECT t, min(id) AS g, count(*) AS n FROM k WHERE t <> '' GROUP BY t HAVING count(*) > 1)
        SELECT id, g AS "group" FROM k JOIN g USING (t)""",
)
def _exact(spark, sf_dir):
    return dedup.exact_duplicates(_docs(spark, sf_dir), "doc_id", "text")


@query("near_dup_pairs")
def _near(spark, sf_dir):
    """Links between distinct texts of a group; tests hold their groups against those of all pairs."""
    return _rounded(dedup.near_links(_docs(spark, sf_dir), "doc_id", "text", 0.85))


@query("dup_groups")
def _groups(spark, sf_dir):
    return dedup.duplicate_groups(_docs(spark, sf_dir), "doc_id", "text")


@query(
    "record_dups",
    """WITH g AS (SELECT count(*) AS n FROM part GROUP BY lower(p_brand), lower(p_type), p_size HAVING count(*) > 1)
       SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra FROM g""",
)
def _records(spark, sf_dir):
    return dedup.record_duplicates(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


_TERMS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"


@query(
    "contamination",
    f"""WITH i AS (SELECT item_id AS item, unnest({_TERMS}) AS g FROM benchmark), s AS (SELECT item, count(*) AS size FROM i GROUP BY 1),
        d AS (SELECT doc_id AS doc, unnest({_TERMS}) AS g FROM documents), h AS (SELECT doc, item, count(*) AS n FROM d JOIN i USING (g) GROUP BY 1, 2)
        SELECT doc, item, round(n / size, 6) AS share FROM h JOIN s USING (item) WHERE n / size >= 0.9""",
)
def _contamination(spark, sf_dir):
    return _rounded(dedup.contamination(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", X.ascii_words, 0.9))


@query(
    "tfidf_pairs",
    """WITH b AS (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark), tf AS (SELECT id, term, count(*) AS tf FROM b GROUP BY 1, 2),
       df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM benchmark),
       w AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n), l AS (SELECT id, sqrt(sum(w * w)) AS l FROM w GROUP BY 1),
       u AS (SELECT id, term, w / l AS w FROM w JOIN l USING (id))
       SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w), 6) AS similarity FROM u a JOIN u b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.3""",
)
def _tfidf(spark, sf_dir):
    weights = dedup.tfidf(table(spark, sf_dir, "benchmark"), "item_id", X.ascii_words(F.col("text"))).checkpoint()
    return _rounded(dedup.cosine_pairs(weights, 0.3))


@query(
    "image_hash_pairs",
    """WITH h AS (SELECT vec_id AS id, list_sum([CASE WHEN embedding[i] > 0 THEN CAST(1 AS HUGEINT) << (i - 1) ELSE 0 END for i in range(1, 33)]) AS h FROM embeddings)
       SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM h a JOIN h b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 4""",
)
def _hashes(spark, sf_dir):
    bits = [F.when(F.get(F.col("embedding"), i) > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(32)]
    h = bits[0]
    for b in bits[1:]:
        h = h.bitwiseOR(b)
    return dedup.hamming_pairs(table(spark, sf_dir, "embeddings").select("vec_id", h.alias("h")), "vec_id", "h", 4, bits=32)


_BM25 = """d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), p AS (SELECT id, len(t) AS len, unnest(t) AS term FROM d),
  i AS (SELECT id, term, len, count(*) AS tf FROM p GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM i GROUP BY 1), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
  q AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
  h AS (SELECT query, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))), 6) AS score FROM q JOIN i USING (term) JOIN df USING (term), s GROUP BY 1, 2),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM h)"""


def _search(spark, sf_dir):
    return retrieve.bm25(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", X.ascii_words, 5)


@query("bm25_topk", f"WITH {_BM25} SELECT query, id, rank FROM r WHERE rank <= 5")
def _bm25(spark, sf_dir):
    return _search(spark, sf_dir).select("query", "id", "rank")


@query(
    "cosine_topk",
    """WITH h AS (SELECT q.vec_id AS query, d.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score
         FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
       r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM h) SELECT query, id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""",
)
def _cosine(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return retrieve.nearest(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 3).select("query", "id", "rank")


@query("hybrid_search")
def _hybrid(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    dense = retrieve.nearest(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    return retrieve.blend(_search(spark, sf_dir), dense)


@query(
    "rag_metrics",
    f"""WITH {_BM25}, rel AS (SELECT DISTINCT query, id FROM r JOIN labels ON id = doc_id AND quality = 1 WHERE rank <= 8), t AS (SELECT query, count(*) AS n FROM rel GROUP BY 1),
        x AS (SELECT r.query, r.rank, rel.id IS NOT NULL AS g, n FROM r LEFT JOIN rel ON r.query = rel.query AND r.id = rel.id LEFT JOIN t ON r.query = t.query WHERE rank <= 5)
        SELECT query, round(count(*) FILTER (g) / 5, 6) AS precision, round(count(*) FILTER (g) / max(n), 6) AS recall, round(coalesce(1.0 / min(rank) FILTER (g), 0), 6) AS mrr,
        round(coalesce(sum(1 / log2(rank + 1)) FILTER (g), 0) / list_sum(list_transform(range(1, CAST(least(max(n), 5) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg, count(*) FILTER (g) > 0 AS hit FROM x GROUP BY 1""",
)
def _rag(spark, sf_dir):
    ranked = retrieve.bm25(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", X.ascii_words, 8)
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    measured = retrieve.rank_metrics(ranked, ranked.join(good, "id").select("query", "id"), 5)
    return _rounded(measured.fillna(0.0, ["ndcg"]))  # as in SQL; the operator has null without relevant ids


@query("search_context")
def _context(spark, sf_dir):
    return retrieve.context(_search(spark, sf_dir), _docs(spark, sf_dir), "doc_id", "text", 2000)


_KINDS = {k: v.replace("'", "''") for k, v in pii.PATTERNS.items()}


@query(
    "pii_share",
    "WITH f AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS kind, '{pii.RISK[k]}' AS risk, regexp_matches(text, '{v}') AS hit FROM documents WHERE text IS NOT NULL" for k, v in _KINDS.items())
    + """) SELECT 'text' AS "column", kind, count(*) FILTER (hit) AS n, round(avg(CAST(hit AS DOUBLE)), 6) AS share, risk FROM f GROUP BY kind, risk HAVING count(*) FILTER (hit) > 0""",
)
def _pii(spark, sf_dir):
    return _rounded(pii.scan(_docs(spark, sf_dir), ["text"]))


@query("mask_email", f"SELECT doc_id, md5(regexp_replace(text, '{_KINDS['email']}', '[EMAIL]', 'g')) AS masked FROM documents WHERE regexp_matches(text, '{_KINDS['email']}')")
def _mask(spark, sf_dir):
    d = _docs(spark, sf_dir).where(pii.has(F.col("text"), "email"))
    return d.select("doc_id", F.md5(F.encode(pii.masked(F.col("text"), "email"), "UTF-8")).alias("masked"))


@query("mask_hash", "SELECT c_custkey, substr(sha256('s' || c_name), 1, 12) AS masked FROM customer")
def _hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", pii.masked(F.col("c_name"), "email", "hash", "s").alias("masked"))


@query("checksum_valid")
def _luhn(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 12, "4").alias("v"))
    return d.select(F.avg(pii.luhn_valid(F.col("v")).cast("double")).alias("luhn"), F.avg(pii.verhoeff_valid(F.col("v")).cast("double")).alias("verhoeff"))


@query(
    "text_stats",
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w, text FROM documents)
       SELECT doc_id, CAST(len(w) AS BIGINT) AS words, CAST(len(list_distinct(w)) AS BIGINT) AS types, round(len(list_distinct(w)) / len(w), 6) AS ttr,
       round(list_sum(list_transform(w, lambda x: length(x))) / len(w), 6) AS mean_length, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM w WHERE len(w) > 0""",
)
def _stats(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", X.ascii_words(F.col("text")).alias("w"), X.estimated_tokens(F.col("text")).cast("long").alias("tokens")).where(F.size("w") > 0)
    total = F.aggregate(F.transform("w", F.char_length), F.lit(0), lambda a, x: a + x)
    return _rounded(
        rows.select(
            "doc_id", F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("types"),
            (F.size(F.array_distinct("w")) / F.size("w")).alias("ttr"), (total / F.size("w")).alias("mean_length"), "tokens",
        )
    )


@query("text_quality")
def _quality(spark, sf_dir):
    return _rounded(_docs(spark, sf_dir).select("doc_id", X.quality()(F.col("text")).alias("q")).select("doc_id", "q.*"), 4)


@query("script_share")
def _script(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", X.script_shares(F.col("text")).alias("s"))
    return d.select("doc_id", X.dominant_script(F.col("s")).alias("script"), X.is_right_to_left(F.col("s")).alias("right_to_left"))


@query("lang_detect")
def _lang(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "lang", X.detect(F.col("text")).alias("d")).select("doc_id", "lang", F.col("d.lang").alias("detected"))


@query("text_normal")
def _normal(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.encode(X.normalized(F.col("text")), "UTF-8")).alias("normal"), F.md5(F.encode(X.transliterate(F.col("text")), "UTF-8")).alias("latin"))


@query(
    "chunk_fixed",
    r"""WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\r\n]+'), lambda x: x <> '') AS w FROM documents),
        c AS (SELECT id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 10) / 90) - 1) AS BIGINT) + 1)) AS chunk FROM w WHERE len(w) > 0)
        SELECT id, CAST(chunk AS INTEGER) AS chunk, md5(array_to_string(w[chunk * 90 + 1 : chunk * 90 + 100], ' ')) AS text FROM c""",
)
def _chunks(spark, sf_dir):
    out = chunks.fixed_words(_docs(spark, sf_dir), "doc_id", "text", 100, 10)
    return out.select("id", "chunk", F.md5(F.encode("text", "UTF-8")).alias("text"))


@query("chunk_recursive")
def _recursive(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(chunks.recursive()(F.col("text"))).alias("chunk", "c")).select("doc_id", "chunk", "c.start", "c.end", "c.core_start")


@query("html_text")
def _html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.encode(chunks.html_text(F.col("html")), "UTF-8")).alias("text"))


@query(
    "participation",
    """WITH w AS (SELECT conv_id, role, count(*) AS turns, CAST(sum(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS BIGINT) AS words FROM conversations GROUP BY 1, 2)
       SELECT conv_id, role, turns, words, round(CASE WHEN sum(words) OVER (PARTITION BY conv_id) > 0 THEN words / sum(words) OVER (PARTITION BY conv_id) ELSE 0 END, 6) AS share FROM w""",
)
def _participation(spark, sf_dir):
    return _rounded(dialogue.participation(table(spark, sf_dir, "conversations"), "conv_id", "role", "text"))


@query(
    "merged_turns",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS g FROM conversations)
       SELECT conv_id, min(turn) AS first, role, md5(string_agg(text, ' ' ORDER BY turn)) AS text FROM r GROUP BY conv_id, role, g""",
)
def _merged(spark, sf_dir):
    out = dialogue.merged_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return out.select("conv_id", "first", "role", F.md5(F.encode("text", "UTF-8")).alias("text"))


_SAID = "(SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN 'Why? ' || text WHEN turn % 3 = 1 THEN 'We decided it, maybe. I will check. ' || text ELSE text END AS text FROM conversations)"


def _said(spark, sf_dir):
    c, t = table(spark, sf_dir, "conversations"), F.col("turn") % 3
    return c.withColumn("text", F.when(t == 0, F.concat(F.lit("Why? "), "text")).when(t == 1, F.concat(F.lit("We decided it, maybe. I will check. "), "text")).otherwise(F.col("text")))


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(
    "actions",
    f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM {_SAID}), k AS (
        SELECT conv_id, turn, 'decision' AS kind, t FROM t WHERE regexp_matches(t, '{_re(dialogue.DECISION)}') AND NOT regexp_matches(t, '\\?')
        UNION ALL SELECT conv_id, turn, 'action', t FROM t WHERE regexp_matches(t, '{_re(dialogue.ACTION)}') UNION ALL SELECT conv_id, turn, 'question', t FROM t WHERE regexp_matches(t, '\\?'))
        SELECT conv_id, turn, kind, CASE WHEN regexp_matches(t, '{_re(dialogue.HEDGE)}') THEN 0.55 ELSE 0.8 END AS confidence FROM k""",
)
def _actions(spark, sf_dir):
    return dialogue.cues(_said(spark, sf_dir), "conv_id", "turn", "text")


@query(
    "answered_questions",
    f"""WITH c AS {_SAID} SELECT q.conv_id, q.turn, min(a.turn) AS answer FROM c q LEFT JOIN c a ON a.conv_id = q.conv_id AND a.turn > q.turn AND a.turn <= q.turn + 6 AND a.role <> q.role
        AND NOT contains(a.text, '?') WHERE contains(q.text, '?') GROUP BY 1, 2""",
)
def _answered(spark, sf_dir):
    return dialogue.answered(_said(spark, sf_dir), "conv_id", "turn", "role", "text")


_SEGMENTS = """(SELECT user_id AS call, event_type AS speaker, epoch(ts) - epoch((SELECT min(ts) FROM events)) AS a, epoch(ts) - epoch((SELECT min(ts) FROM events)) + value * 400 AS b FROM events)"""


@query(
    "call_interruptions",
    f"""WITH s AS {_SEGMENTS} SELECT call, speaker, count(DISTINCT a) AS interruptions FROM s x WHERE EXISTS
        (SELECT 1 FROM s y WHERE y.call = x.call AND y.speaker <> x.speaker AND x.a > y.a AND y.b - x.a > 0.5) GROUP BY 1, 2""",
)
def _calls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    low = e.agg(F.min(t)).first()[0]
    s = e.select(F.col("user_id").alias("call"), F.col("event_type").alias("speaker"), (t - low).alias("a"), (t - low + F.col("value") * 400).alias("b"))
    return dialogue.overlaps(s, "call", "speaker", "a", "b")


@query("prompt_complexity")
def _complexity(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return _rounded(c.select("conv_id", "turn", dialogue.complexity(F.col("text")).alias("c")).select("conv_id", "turn", "c.*"))


MODELS = [
    {"name": "small", "cost": 0.2, "latency": 200, "quality": 0.4, "max_tokens": 2000, "tags": ["chat"]},
    {"name": "medium", "cost": 1.0, "latency": 500, "quality": 0.65, "max_tokens": 8000, "tags": ["chat", "code"]},
    {"name": "large", "cost": 5.0, "latency": 1500, "quality": 0.9, "max_tokens": 32000, "tags": ["chat", "code"]},
]


@query("prompt_route")
def _route(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    p = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), dialogue.complexity(F.col("text"))["band"].alias("band"), X.estimated_tokens(F.col("text")).alias("tokens"))
    return dialogue.route(p, MODELS).where("rank = 1").select("id", "band", "model", "score")


@query("cache_key", r"""SELECT conv_id, turn, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) || chr(31) || '{"t": 0}') AS key FROM conversations""")
def _key(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", dialogue.cache_key(F.col("text"), {"t": 0}).alias("key"))


@query(
    "cache_evict",
    """WITH c AS (SELECT event_type AS namespace, event_id AS key, event_id AS accessed, length(props) AS size FROM events),
       u AS (SELECT *, sum(size) OVER (PARTITION BY namespace ORDER BY accessed DESC, key) AS used FROM c) SELECT namespace, key FROM u WHERE used <= 500""",
)
def _evict(spark, sf_dir):
    c = table(spark, sf_dir, "events").select(F.col("event_type").alias("namespace"), F.col("event_id").alias("key"), F.col("event_id").alias("accessed"), F.length("props").alias("size"))
    return dialogue.cache_evict(c, 500).select("namespace", "key")


@query("grounding")
def _grounding(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    said = c.groupBy("conv_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.col("text")))), " ").alias("answer"),
        F.collect_list(F.when(F.col("role") == "user", F.col("text"))).alias("sources"),
    )
    return said.select("conv_id", dialogue.grounding()(F.col("answer"), F.col("sources")).alias("g")).select("conv_id", F.round("g.score", 4).alias("score"), "g.claims")


@query(
    "rule_labels",
    """WITH f AS (SELECT doc_id, coalesce(regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])license($|[^\\p{L}\\p{N}_])'), false) AS l, coalesce(regexp_matches(text, '[#$%&*]{3}'), false) AS s FROM documents)
       SELECT doc_id, CASE WHEN l AND s THEN 'noise' WHEN l THEN 'legal' WHEN s THEN 'noise' END AS label, round(CASE WHEN l AND s THEN 2 / 3 WHEN l OR s THEN 1.0 ELSE 0.0 END, 6) AS confidence FROM f""",
)
def _rules(spark, sf_dir):
    rules = [dialogue.Rule("legal", ["license"]), dialogue.Rule("noise", pattern="[#$%&*]{3}", weight=2.0)]
    return _rounded(dialogue.rule_labels(_docs(spark, sf_dir), "text", rules).select("doc_id", "label", "confidence"))


@query("label_model")
def _model(spark, sf_dir):
    d = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("label")), "doc_id")
    fitted = dialogue.label_model(d.select("doc_id", "text", "label"), "text")
    return fitted.transform(d.select("doc_id", "text", "label")).select("doc_id", "label", "prediction")


@query(
    "clean_numbers",
    """SELECT l_orderkey, l_linenumber, l_extendedprice AS price, round(l_discount, 6) AS discount, -l_quantity AS quantity FROM lineitem""",
)
def _numbers(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)).alias("p"), F.concat(F.round(F.col("l_discount") * 100, 2).cast("string"), F.lit("%")).alias("d"),
        F.concat(F.lit("("), F.col("l_quantity").cast("string"), F.lit(")")).alias("q"),
    )
    n = prepare.parse_number
    return raw.select("l_orderkey", "l_linenumber", n(F.col("p")).alias("price"), F.round(n(F.col("d")), 6).alias("discount"), n(F.col("q")).alias("quantity"))


@query(
    "impute_clip",
    """WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders), q AS (SELECT quantile_cont(p, 0.25) AS a, quantile_cont(p, 0.5) AS m, quantile_cont(p, 0.75) AS b FROM v)
       SELECT o_orderkey, round(least(greatest(coalesce(p, m), a - 0.5 * (b - a)), b + 0.5 * (b - a)), 4) AS p FROM v, q""",
)
def _impute(spark, sf_dir):
    v = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("p"))
    return prepare.Cleaner.fit(v, 0.5).apply(v).select("o_orderkey", F.round("p", 4).alias("p"))


@query(
    "schema_validate",
    """SELECT 'o_orderstatus' AS "column", 'not_allowed' AS problem, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS n FROM orders
       UNION ALL SELECT 'o_totalprice', 'above', count(*) FILTER (o_totalprice > 200000) FROM orders UNION ALL SELECT 'gone', 'absent', 1""",
)
def _schema(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice")
    rules = prepare.Schema({"o_orderstatus": {"type": "string", "allowed": ["F", "O"]}, "o_totalprice": {"type": "double", "max": 200000.0, "min": 0.0}, "gone": {"type": "int"}})
    return rules.validate(o)


@query("schema_enforce", "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS o_totalprice, CAST(NULL AS INTEGER) AS gone FROM (SELECT o_orderkey, trunc(o_totalprice) AS o_totalprice FROM orders)")
def _enforce(spark, sf_dir):
    rules = prepare.Schema({"o_orderkey": {"type": "bigint"}, "o_totalprice": {"type": "bigint"}, "gone": {"type": "int"}})
    return rules.enforce(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey", "o_orderstatus"))


@query("split_report", "SELECT CAST(0 AS BIGINT) AS leaking_keys, count(DISTINCT o_custkey) AS keys, CAST(0 AS BIGINT) AS leaking_rows FROM orders")
def _split(spark, sf_dir):
    s = prepare.split(table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), ["o_custkey"])
    return prepare.split_report(s, ["o_custkey"], ["o_custkey", "o_totalprice"])


@query("split_rows")
def _split_rows(spark, sf_dir):
    return prepare.split(table(spark, sf_dir, "orders"), ["o_custkey"]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "time_split",
    """WITH q AS (SELECT quantile_cont(epoch_us(o_orderdate), 0.7) AS a, quantile_cont(epoch_us(o_orderdate), 0.8) AS b FROM orders)
       SELECT CASE WHEN epoch_us(o_orderdate) > b THEN 'test' WHEN epoch_us(o_orderdate) > a THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM orders, q GROUP BY 1""",
)
def _time(spark, sf_dir):
    return prepare.time_split(table(spark, sf_dir, "orders"), "o_orderdate").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "linked_groups",
    """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS row, l_orderkey AS k, CASE WHEN l_suppkey < 3 THEN l_suppkey END AS s FROM lineitem),
       f AS (SELECT k, coalesce(bool_or(s = 0), false) AS h0, coalesce(bool_or(s = 1), false) AS h1, coalesce(bool_or(s = 2), false) AS h2, min(row) AS low, count(*) AS n FROM r GROUP BY k),
       j AS (SELECT coalesce(bool_or(h0 AND h1), false) AS a, coalesce(bool_or(h0 AND h2), false) AS b, coalesce(bool_or(h1 AND h2), false) AS c FROM f),
       h AS (SELECT -1 AS c0, CASE WHEN a OR (b AND c) THEN -1 ELSE -2 END AS c1, CASE WHEN b OR (a AND c) THEN -1 WHEN c THEN -2 ELSE -3 END AS c2 FROM j),
       g AS (SELECT CASE WHEN h0 THEN c0 WHEN h1 THEN c1 WHEN h2 THEN c2 ELSE k END AS c, low, n FROM f, h)
       SELECT min(low) AS "group", CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY c""",
)
def _linked(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), "l_orderkey", F.when(F.col("l_suppkey") < 3, F.col("l_suppkey")).alias("s"))
    return prepare.linked_groups(o, ["l_orderkey", "s"], "row").groupBy("group").agg(F.count(F.lit(1)).alias("n"))


@query(
    "loo_mapping",
    """WITH c AS (SELECT o_orderpriority AS f, o_orderstatus AS t, count(*) AS n FROM orders GROUP BY 1, 2),
       r AS (SELECT *, row_number() OVER w AS r, coalesce(lead(n) OVER w, 0) AS s FROM c WINDOW w AS (PARTITION BY f ORDER BY n DESC, t))
       SELECT round(sum(CASE WHEN r = 1 AND n - 1 > s THEN n ELSE 0 END) / sum(n), 6) AS accuracy FROM r""",
)
def _loo(spark, sf_dir):
    return _rounded(prepare.loo_mapping_accuracy(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus"))


@query(
    "spearman",
    """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem)
       SELECT round(corr(a, b), 6) AS rho FROM r""",
)
def _spearman(spark, sf_dir):
    a = prepare.average_ranks(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity").withColumnRenamed("rank", "a")
    return prepare.average_ranks(a, "l_extendedprice").agg(F.round(F.corr("a", "rank"), 6).alias("rho"))


@query("synthetic_fidelity")
def _synth(spark, sf_dir):
    real = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    made = prepare.Synthesizer.fit(real, ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag"]).sample(spark, 5000)
    return _rounded(prepare.fidelity(real, made, ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag"]))
