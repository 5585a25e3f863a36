"""Language of texts by a linear-chain conditional random field over their words.

A word's features are hashed: its n-grams of 1 to 4 bytes (with marks at both ends, so
that affixes are features of their own) and the word as a whole (the lexicon). Labels of
neighbouring words are tied by learned transitions. The field is trained here by
gradient ascent on the likelihood, on sequences of labelled lines, some of them put
together from two languages so that switches occur. Texts are decoded line by line with
the forward-backward algorithm; the sum of the words' posteriors over the whole text
gives its language. ``label_words`` gives the label of every word, for mixed texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import python_ready

#: log2 of the weights' rows; words that a worker remembers; bytes of text decoded at a time.
BUCKET_BITS, REMEMBERED, SLICE_BYTES = 17, 600_000, 6 << 20
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Field:
    """Labels, emission weights (buckets x labels), transitions (from x to)."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, flat, and how many each has; words without letters have none."""
    import pyarrow.compute as pc

    low = pc.utf8_lower(words.cast(pa.large_string()))
    raw = pc.cast(low, pa.large_binary())
    sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    ends = np.cumsum(sizes)
    text = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    inner = np.ones(len(text), bool)
    text[ends - sizes], text[ends - 1] = 2, 3
    inner[ends - sizes] = inner[ends - 1] = False
    text[inner] = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
    ok = np.zeros(len(raw), bool)
    word = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
    ok[word[(text >= 97) & (text <= 122)]] = True
    wide = np.zeros(len(raw), bool)
    wide[word[text >= 128]] = True
    for i in np.flatnonzero(wide & ~ok).tolist():
        ok[i] = _LETTER.search(low[i].as_py()) is not None
    place = np.arange(len(text)) - np.repeat(ends - sizes, sizes)
    room = sizes[word] - place  # bytes left from here
    use = ok[word]
    mix, found, of = np.uint64(0x9E3779B97F4A7C15), [], []
    code = np.zeros(len(text), np.uint64)
    for n in range(1, 5):
        if len(text) < n:
            break
        code[: len(text) - n + 1] = code[: len(text) - n + 1] * np.uint64(257) + text[n - 1 :]
        fits = (room >= n) & use
        found.append(((code[fits] + np.uint64(n << 40)) * mix) >> np.uint64(64 - BUCKET_BITS))
        of.append(word[fits])
    if len(raw):
        powers = np.cumprod(np.full(int(sizes.max()), 0xD6E8FEB86659FD93, np.uint64))
        whole = np.add.reduceat((text + np.uint64(1)) * powers[place], ends - sizes)
        whole ^= whole >> np.uint64(29)
        found.append((whole[ok] * mix) >> np.uint64(64 - BUCKET_BITS))
        of.append(np.flatnonzero(ok))
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(raw), np.int64)
    feature, owner = np.concatenate(found).astype(np.int64), np.concatenate(of)
    order = np.argsort(owner, kind="stable")
    return feature[order], np.bincount(owner, minlength=len(raw))


def emissions(weights: np.ndarray, feature: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Score of each label for each word: mean weight of its features, times 8."""
    out = np.zeros((len(sizes), weights.shape[1]), np.float32)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] = np.add.reduceat(weights[feature], starts, axis=0) * (8.0 / sizes[full])[:, None]
    return out


def posteriors(scores: np.ndarray, moves: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pairs: bool = False):
    """Label probabilities of each word of sequences laid end to end; with pairs, also the summed transition counts.

    Forward-backward with scaling, over all sequences at once: step t handles every sequence longer than t.
    """
    peak = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    go = np.exp(moves - moves.max()).astype(np.float32)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    ascending = np.sort(sizes)
    alive = [len(sizes) - int(x) for x in np.searchsorted(ascending, np.arange(sizes[0] if len(sizes) else 0), side="right")]
    ahead, back = np.empty_like(peak), np.ones_like(peak)
    state = None
    for t, k in enumerate(alive):
        at = starts[:k] + t
        state = peak[at] if state is None else (state[:k] @ go) * peak[at]
        state /= state.sum(axis=1, keepdims=True)
        ahead[at] = state
    total = np.zeros_like(go)
    for t in range(len(alive) - 1, 0, -1):
        k = alive[t]
        at = starts[:k] + t
        after = peak[at] * back[at]
        before = after @ go.T
        scale = before.sum(axis=1, keepdims=True)
        back[at - 1] = before / scale
        if pairs:
            joint = ahead[at - 1].T @ (after / np.einsum("ij,ij->i", ahead[at - 1], before)[:, None])
            total += joint * go
    out = ahead * back
    if len(out):
        out /= out.sum(axis=1, keepdims=True)
    return (out, total) if pairs else out


def train(texts: list[str], langs: list[str], rounds: int = 15, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> Field:
    """A field from labelled texts; every third sequence is followed by one of another text without a break."""
    labels = sorted(set(langs))
    number = {x: i for i, x in enumerate(labels)}
    lines = [(w, number[lang]) for text, lang in zip(texts, langs) for line in text.split("\n") for w in _chunks(line.split(), 40) if w]
    rng = np.random.default_rng(seed)
    lines = [lines[i] for i in rng.permutation(len(lines))]
    vocabulary: dict[str, int] = {}
    codes, truth, sizes = [], [], []
    for k, (line, label) in enumerate(lines):
        codes += [vocabulary.setdefault(w, len(vocabulary)) for w in line]
        truth += [label] * len(line)
        if k % 3 == 2:
            sizes[-1] += len(line)
        else:
            sizes.append(len(line))
    feature, counts = features(pa.array(list(vocabulary), pa.string()))
    code, gold = np.array(codes), np.array(truth)
    sizes_ = np.array(sizes)
    starts = np.cumsum(sizes_) - sizes_
    weights = np.zeros((1 << BUCKET_BITS, len(labels)), np.float32)
    moves = np.zeros((len(labels), len(labels)), np.float64)
    square = np.full_like(weights, 1e-6)
    square_moves = np.full_like(moves, 1e-6)
    inner = np.ones(len(code), bool)
    inner[starts] = False
    second = np.flatnonzero(inner)
    seen = np.zeros_like(moves)
    np.add.at(seen, (gold[second - 1], gold[second]), 1)
    one = np.zeros((len(code), len(labels)), np.float32)
    one[np.arange(len(code)), gold] = 1
    owner = np.repeat(np.arange(len(counts)), counts)
    share = (8.0 / np.maximum(counts, 1)).astype(np.float32)
    for _ in range(rounds):
        scores = emissions(weights, feature, counts)[code]
        guess, pairs = posteriors(scores, moves, starts, sizes_, pairs=True)
        error = (one - guess) / len(code)
        by_word = np.stack([np.bincount(code, error[:, j], minlength=len(counts)) for j in range(len(labels))], axis=1) * share[:, None]
        step = np.stack([np.bincount(feature, by_word[owner, j], minlength=len(weights)) for j in range(len(labels))], axis=1)
        step = step.astype(np.float32) - decay * weights / max(1, len(labels))
        square += step**2
        weights += rate * step / np.sqrt(square)
        turn = (seen - pairs) / max(1, len(second)) - decay * moves
        square_moves += turn**2
        moves += rate * turn / np.sqrt(square_moves)
    return Field(labels, weights, moves)


def _chunks(line: list[str], n: int) -> Iterator[list[str]]:
    for i in range(0, len(line), n):
        yield line[i : i + n]


class Decoder:
    """Decodes slices of texts; remembers the scores of words that it has seen."""

    def __init__(self, field: Field) -> None:
        self.field = field
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.field.labels)), np.float32)
        self.letters = np.zeros(0, bool)

    def words(self, texts: pa.Array):
        """Word codes of all texts, posteriors, and where each text's words begin (one more at the end)."""
        import pyarrow.compute as pc

        if len(self.number) > REMEMBERED:
            self.forget()
        lines = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), pattern="\n")
        parts = pc.split_pattern_regex(pc.utf8_trim(lines.flatten(), characters=" \t\x0b\x0c\r"), pattern="[ \t\x0b\x0c\r]+")
        coded = parts.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        known = self.number.get
        index = np.array([known(w, -1) for w in names], np.int64)
        new = np.flatnonzero(index < 0)
        if len(new):
            index[new] = np.arange(len(self.number), len(self.number) + len(new))
            self.number.update((names[i], k) for i, k in zip(new.tolist(), index[new].tolist()))
            feature, sizes = features(coded.dictionary.take(pa.array(new)))
            self.scores = np.concatenate([self.scores, emissions(self.field.weights, feature, sizes)])
            self.letters = np.concatenate([self.letters, sizes > 0])
        code = index[coded.indices.to_numpy(zero_copy_only=False)]
        starts = np.asarray(parts.offsets)
        chance = posteriors(self.scores[code], self.field.moves, starts[:-1][np.diff(starts) > 0], np.diff(starts)[np.diff(starts) > 0])
        return code, chance, starts[np.asarray(lines.offsets)]

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """Label and score of each text: the label with the largest share of its words' posteriors, and that share."""
        code, chance, starts = self.words(texts)
        weigh = self.letters[code] if len(code) else np.zeros(0, bool)
        sums = np.concatenate([np.zeros((1, len(self.field.labels))), np.cumsum(chance * weigh[:, None], axis=0, dtype=np.float64)])
        share = np.diff(sums[starts], axis=0)
        total = share.sum(axis=1)
        best = share.argmax(axis=1)
        langs = [self.field.labels[b] if t > 0 else UNKNOWN for b, t in zip(best, total)]
        return langs, [min(1.0, float(s[b] / t)) if t > 0 else 0.0 for s, b, t in zip(share, best, total)]


def sample(rows: DataFrame, per_lang: int, chars: int, lang: str = "lang", text: str = "text") -> tuple[list[str], list[str]]:
    """About ``per_lang`` labelled texts of each language, picked by a hash of the text, and of each one of its windows of ``chars`` characters.

    The window is picked by another hash, so all parts of texts are learnt from alike. This bounds what reaches the
    driver: languages x per_lang x chars. Only training uses it.
    """
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return [], []
    spans = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, max(1, round((1 << 30) * min(1.0, per_lang / n))))])
    chosen = rows.where(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < F.element_at(spans, F.col(lang)))
    # Copies of a text have one hash and are picked together: one of them is enough.
    windows = F.greatest(F.lit(1), F.ceil(F.char_length(text) / chars))
    begin = F.pmod(F.xxhash64(F.lit("window"), text), windows) * chars + 1
    window = F.substr(text, begin.cast("int"), F.lit(chars)).alias("t")
    got = chosen.select(lang, window, F.xxhash64(text).alias("h")).dropDuplicates([lang, "h"]).collect()
    got = sorted(got, key=lambda r: (r[0], r["h"], r["t"]))
    kept: dict[str, list[str]] = {}
    for r in got:
        if len(kept.setdefault(r[0], [])) < 2 * per_lang:
            kept[r[0]].append(r["t"])
    return [t for k in sorted(kept) for t in kept[k]], [k for k in sorted(kept) for _ in kept[k]]


def fit(rows: DataFrame, per_lang: int = 300, chars: int = 1000, lang: str = "lang", text: str = "text") -> Field:
    """Trains on a bounded sample of labelled rows; without any, the field has no label and every text is ``und``."""
    texts, langs = sample(rows, per_lang, chars, lang, text)
    if not any(_LETTER.search(t) for t in texts):
        return Field([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros((0, 0)))
    return train(texts, langs)


def predict(df: DataFrame, field: Field, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns of df (those in ``keep``, or all) with lang_pred and score; columns of those names are replaced.

    Null texts and texts without letters are ``und`` with score 0. Texts are read whole. Repeated rows are kept, an
    empty table gives no row.
    """
    keep = [c for c in (keep or df.columns) if c.lower() not in ("lang_pred", "score")]
    python_ready(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(field)  # bounded: buckets x labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from siltstone.llm.packing import _slices

        decoder = Decoder(model.value)
        for batch in batches:
            for part in _slices(batch, batch.num_columns - 1, SLICE_BYTES):
                texts = part.column(part.num_columns - 1)
                n = part.num_rows
                langs, scores = decoder.predict(texts) if decoder.field.labels else ([UNKNOWN] * n, [0.0] * n)
                arrays = [part.column(i) for i in range(part.num_columns - 1)] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, "lang_pred", "score"])

    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("the text to decode"))
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string", "score double"])
    return rows.mapInArrow(run, schema)


def label_words(texts: list[str], field: Field) -> list[list[tuple[str, str]]]:
    """Words of texts, each with its most probable language."""
    decoder = Decoder(field)
    code, chance, starts = decoder.words(pa.array(texts, pa.string()))
    names = {i: w for w, i in decoder.number.items()}
    tagged = [(names[c], field.labels[p.argmax()]) for c, p in zip(code.tolist(), chance)]
    return [[x for x in tagged[a:b] if x[0]] for a, b in zip(starts[:-1], starts[1:])]


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2
