"""Best-fit packing of tokenised documents into fixed-length sequences.

Bulk-synchronous best fit. A round range-sorts the pieces left and the gaps by size,
downwards, gaps before pieces of their size. A sweep along that order gives every piece
its successor, the smallest gap before it that isn't taken: gaps open and pieces close,
like brackets, so conflicts are settled by rank, the number of gaps open so far. Each
partition matches its own brackets; what is left of it, closing ranks and then opening
ones, is matched over partitions by rank alone, where a partition has at most one of
each at a rank. Then all gaps are updated at once and the next round begins. Where gaps
are large against the largest piece left, a gap takes part as several equal ones, so
rounds don't follow the number of pieces in a sequence. For pieces that no gap holds,
new sequences open, as many as their tokens fill.

Rounds move (row number, length) and (sequence, size) only; the pieces themselves are
joined with their places once, at the end.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm._common import free_name, python_ready, stash, unstash
from siltstone.llm._filters import release
from siltstone.llm._shingles import text_bytes

TOKENIZER = "word_bpe_49k.json"
#: Bytes of text tokenised at a time, and pieces of words whose ids a worker remembers.
SLICE_BYTES, REMEMBERED = 2 << 20, 1_000_000
#: Pieces and gaps of a range that a task sweeps; the number of ranges follows the rows.
ROWS_A_RANGE = 100_000


def _table(*runs: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for first, last in runs:
        out[first : last + 1] = True
    return out


#: Printable ASCII without the apostrophe; small letters; digits; second bytes of Latin letters in composed form (after C3), and of capital ones.
_PRINT, _SMALL, _DIGIT = _table((33, 38), (40, 126)), _table((97, 122)), _table((48, 57))
_LATIN, _CAPITAL = _table((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF)), _table((0x80, 0x96), (0x98, 0x9E))


class WordTokenizer:
    """Token ids of texts by way of the distinct pieces of their words.

    The tokenizer parts text at white space and drops it, so the ids of a text are those of its words in a row. Texts
    are parted at space and newline only; other white space stays inside a "word" and is dropped by the tokenizer. Words
    whose lower case and parts are certain (ASCII without apostrophe, and Latin letters in composed form) are parted
    further into runs of letters, single digits and runs of other characters, as the tokenizer does after lower case, so
    that "word", "Word" and "word," cost one encoding of "word"; all other words go to the tokenizer whole. Parting is
    done on the bytes of a whole slice; only pieces that are new to the worker are looked at one by one.
    """

    shared: dict[str, WordTokenizer] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """The process's tokenizer of a file: tasks that share a worker share what it remembers."""
        if path not in cls.shared:
            cls.shared[path] = cls(path)
        return cls.shared[path]

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.starts = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        """Ids of pieces that aren't known yet."""
        coded = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)]
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) for x in coded])])
        flat = np.fromiter(itertools.chain.from_iterable(coded), np.uint32)
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype) if flat.max(initial=0) < 1 << 16 else flat])

    @staticmethod
    def _pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Where pieces start, and the pieces, of texts that lie end to end."""
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        solid = (data != 32) & (data != 10)
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:n]
        # Two bytes of a Latin letter count as one letter; a text's bytes are whole characters.
        lead = data == 0xC3
        second = np.zeros(n, bool)
        second[1:] = lead[:-1]
        second &= _LATIN[data]
        lead[:-1] &= second[1:]
        lead[-1:] = False
        wide = lead | second
        odd = solid & ~(_PRINT[data] | wide)
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124) & ~edge[1:n]  # "<|" may begin a special token
        word = np.cumsum(first) - 1  # of solid bytes
        strange = np.zeros(int(first.sum()) + 1, bool)
        strange[word[odd]] = True
        plain = solid & ~strange[word]
        low = np.where(plain & ((data >= 65) & (data <= 90) | second & _CAPITAL[data]), data + 32, data).astype(np.uint8)
        kind = np.where(plain & (_SMALL[low] | wide), 1, np.where(plain & _DIGIT[low], 2, 3))
        cut = first.copy()
        cut[1:] |= plain[1:] & plain[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        starts = np.flatnonzero(cut & solid)
        kept = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
        offsets = np.append(kept[starts], kept[-1])
        return starts, pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[solid])])

    def encode(self, texts: pa.Array):
        """Flat ids (uint32) of all texts and the number of ids of each; a null text has none."""
        if len(self.number) > REMEMBERED:
            self.forget()
        data, bounds = text_bytes(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        places, pieces = self._pieces(data, bounds)
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_pylist()
        known = self.number.get
        index = np.array([known(w, -1) for w in names], np.int64)
        fresh = np.flatnonzero(index < 0)
        if len(fresh):
            index[fresh] = np.arange(len(self.number), len(self.number) + len(fresh))
            self._learn([names[i] for i in fresh.tolist()])
        at = index[coded.indices.to_numpy(zero_copy_only=False)]
        begin = self.starts[at]
        size = self.starts[at + 1] - begin
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(begin - (ends - size), size) + np.arange(total)] if total else np.zeros(0, np.uint32)
        before = np.concatenate([[0], ends])[np.searchsorted(places, bounds)]
        return ids.astype(np.uint32), np.diff(before)


def _slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most`` bytes of text."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        below = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, below + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def tokenize(docs: DataFrame, capacity: int, tokenizer: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its text's ids and then id 0; a null or empty text is the id 0 alone. Only longer documents are cut.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer.of(tokenizer)
        for batch in batches:
            for part in _slices(batch, 1):
                ids, sizes = words.encode(part.column(1))
                rows, pieces, starts, lengths, sums, tokens = [], [], [], [], [], []
                at = 0
                for row, n in enumerate(sizes.tolist()):
                    whole = np.append(ids[at : at + n], np.uint32(0)).astype("<u4")
                    at += n
                    for k, start in enumerate(range(0, n + 1, capacity)):
                        piece = whole[start : start + capacity]
                        rows.append(row)
                        pieces.append(k)
                        starts.append(start)
                        lengths.append(len(piece))
                        sums.append(zlib.crc32(piece.tobytes()))
                        if keep_ids:
                            tokens.append(piece.astype(np.int32))
                arrays = [part.column(0).take(pa.array(rows, pa.int32())), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
                names = [doc_id, "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays.append(pa.array(tokens, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    python_ready(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(doc_id, text).mapInArrow(run, schema)


def brackets(opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of matched gaps and of their pieces, in a sweep over gaps (True) and pieces: each piece takes the last gap not taken."""
    rank = np.cumsum(np.where(opens, 1, -1)) + ~opens
    order = np.argsort(rank, kind="stable")
    rank, kind = rank[order], opens[order]
    hit = np.flatnonzero(kind[:-1] & ~kind[1:] & (rank[1:] == rank[:-1]))
    return order[hit], order[hit + 1]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches (r, s, slot, n) of a range of (r, s, slot, n), r being null for gaps; rows without a match get their range and place in it."""
    got = list(batches)
    if not got:
        return
    rows = pa.Table.from_batches(got).combine_chunks()
    opens = rows.column("r").is_null().to_numpy()
    gap, piece = brackets(opens)
    alone = np.ones(len(opens), bool)
    alone[gap] = alone[piece] = False
    rest = np.flatnonzero(alone)
    closing = int((~opens[rest]).sum())
    place = np.concatenate([np.arange(closing), np.arange(len(rest) - closing)])
    order = np.concatenate([piece, rest])
    source = np.concatenate([gap, rest])
    part = np.concatenate([np.full(len(piece), -1), np.full(len(rest), TaskContext.get().partitionId())])
    columns = [rows.column("r").take(pa.array(order)), *(rows.column(c).take(pa.array(source)) for c in ("s", "slot")), rows.column("n").take(pa.array(order))]
    columns += [pa.chunked_array([pa.array(x, pa.int64())]) for x in (part, np.concatenate([np.zeros(len(piece), np.int64), place]))]
    yield from pa.table(columns, ["r", "s", "slot", "n", "part", "i"]).to_batches(max_chunksize=1 << 16)


def _matched(swept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(r, s, slot, n) of the pieces that have a gap and (r, n) of those left; swept: stashed rows of _sweep."""
    spark = swept.sparkSession
    piece = F.col("r").isNotNull()
    rest = swept.where(F.col("part") >= 0)
    sizes = rest.groupBy("part").agg(F.count(F.when(piece, 1)).alias("closing"), F.count(F.when(~piece, 1)).alias("opening"))
    before, below, table = 0, 0, []
    for r in sorted(sizes.collect()):  # one row a range
        below = max(before - r["closing"], 0)
        table.append((r["part"], before, below))
        before = below + r["opening"]
    ranges = spark.createDataFrame(table, "part long, before long, below long")
    ranked = rest.join(F.broadcast(ranges), "part")
    ranked = ranked.withColumn("rank", F.when(piece, F.col("before") - F.col("i")).otherwise(F.col("below") + F.col("i") + 1))
    own = swept.where(F.col("part") < 0).select("r", "s", "slot", "n")
    left = ranked.where(piece & (F.col("rank") <= 0)).select("r", "n")
    if not any(before for _, before, _ in table):
        return own, left
    at = Window.partitionBy("rank").orderBy("part", F.col("r").isNull())  # of a rank, a range has one piece and one gap at most
    far = ranked.where(F.col("rank") > 0).select("r", "n", F.lag("s").over(at).alias("s"), F.lag("slot").over(at).alias("slot"))
    return own.unionByName(far.where(piece)), left


def assign(pieces: DataFrame, capacity: int, row: str) -> DataFrame:
    """pieces (with a column ``length``, 1 to capacity) with sequence_id and offset; ``row`` numbers the rows and is left out.

    ``pieces`` is read twice: stash it first. An empty table gives no row.
    """
    spark = pieces.sparkSession
    python_ready(spark)
    left, gaps = pieces.select(F.col(f"`{row}`").alias("r"), F.col("length").alias("n")), None
    placed, opened, turn, widest = [], 0, 0, 0
    while True:
        stuck = F.col("n") > widest
        found = left.agg(
            F.count("n").alias("c"), F.max("n").alias("longest"), F.min("n").alias("shortest"),
            F.coalesce(F.sum(F.when(stuck, F.col("n"))), F.lit(0)).alias("tokens"), F.count(F.when(stuck & (2 * F.col("n") > capacity), 1)).alias("halves"),
        ).first()
        if not found["c"]:
            break
        new = max(-(-found["tokens"] // capacity), found["halves"])
        fresh = spark.range(opened, opened + new).select(F.col("id").alias("s"), F.lit(capacity).cast("long").alias("g"))
        opened += new
        open_ = fresh if gaps is None else gaps.where(F.col("g") >= found["shortest"]).unionByName(fresh)
        times = F.greatest(F.lit(1), F.floor(F.col("g") / found["longest"]))
        slots = open_.select(F.lit(None).cast("long").alias("r"), "s", F.explode(F.sequence(F.lit(1), times.cast("int"))).alias("slot"), F.floor(F.col("g") / times).alias("n"))
        sides = slots.unionByName(left.select("r", F.lit(None).cast("long").alias("s"), F.lit(None).cast("int").alias("slot"), "n"))
        # Equal sizes are spread over ranges by their numbers.
        order = [F.col("n").desc(), F.col("r").isNotNull(), F.coalesce("r", "s"), F.col("slot")]
        ranges = 1 + (found["c"] + opened) // ROWS_A_RANGE
        sorted_ = sides.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        swept = stash(sorted_.mapInArrow(_sweep, "r long, s long, slot int, n long, part long, i long"), f"swept-{turn}")
        hits, left = _matched(swept)
        hits = stash(hits.withColumn("turn", F.lit(turn)), f"placed-{turn}")
        placed.append(hits)
        taken = hits.groupBy("s").agg(F.sum("n").alias("taken"))
        last = gaps
        gaps = stash(open_.join(taken, "s", "left").select("s", (F.col("g") - F.coalesce("taken", F.lit(0))).alias("g")).where("g > 0"), f"gaps-{turn}")
        left = stash(left, f"left-{turn}")
        for old in (swept, last):
            if old is not None:
                unstash(old)
        widest = gaps.agg(F.max("g")).first()[0] or 0
        release(spark)
        turn += 1
    if not placed:
        return pieces.select(*[F.col(f"`{c}`") for c in pieces.columns if c != row], F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).limit(0)
    every = placed[0]
    for more in placed[1:]:
        every = every.unionByName(more)
    within = Window.partitionBy("s").orderBy("turn", "slot")  # at most ``capacity`` rows
    r, s, offset = (free_name(pieces.columns, x) for x in ("r", "s", "at"))
    places = every.select(F.col("r").alias(r), F.col("s").alias(s), (F.sum("n").over(within) - F.col("n")).alias(offset))
    kept = [F.col(f"`{c}`") for c in pieces.columns if c not in (row, "sequence_id", "offset")]
    return pieces.join(places, F.col(f"`{row}`") == F.col(r)).select(*kept, F.col(s).alias("sequence_id"), F.col(offset).alias("offset"))


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece of a document with its place in a sequence: sequence_id (from 0) and offset (gapless from 0).

    Null texts count as empty, null ids are documents like others, repeated rows are documents of their own; other
    columns of docs are left out; an empty table gives no row.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    tokenized = tokenize(docs, capacity, tokenizer, doc_id, text, keep_ids)
    row = free_name(tokenized.columns, "row")
    return assign(stash(tokenized.withColumn(row, F.monotonically_increasing_id()), "pieces"), capacity, row)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids, from pack(..., keep_ids=True)."""
    gathered = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return gathered.select("sequence_id", F.flatten(F.transform("p", lambda x: x.ids)).alias("ids"))
