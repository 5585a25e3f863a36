"""Best-fit packing: token ids against the tokenizer, places gapless, few sequences."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from siltstone.llm import packing
from siltstone.llm._common import stash

PATH = public_tokenizers.path(packing.TOKENIZER)


def held(rows, docs, capacity):
    t = Tokenizer.from_file(PATH)
    ids = collections.Counter()
    want = collections.defaultdict(list)
    for d in docs:
        whole = t.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        ids[d["doc_id"]] += 1
        for k in range(0, len(whole), capacity):
            piece = whole[k : k + capacity]
            want[d["doc_id"]].append((k // capacity, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    got = collections.defaultdict(list)
    places = collections.defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_documents(spark, sf, as_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = as_rows(packing.pack(docs))
    n = held(rows, as_rows(docs), 2048)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) * 1.02 + 1


def test_odd_rows(odd_docs, no_docs, as_rows):
    held(as_rows(packing.pack(odd_docs, 64)), as_rows(odd_docs), 64)
    assert as_rows(packing.pack(no_docs)) == []


def test_sequences_hold_the_ids(spark, odd_docs, as_rows):
    packed = packing.pack(odd_docs, 128, keep_ids=True)
    built = as_rows(packing.sequences(packed))
    assert sum(len(r["ids"]) for r in built) == sum(r["length"] for r in as_rows(packed))
    assert all(len(r["ids"]) <= 128 for r in built)


def test_ranges_do_not_change_the_result(odd_docs, as_rows, monkeypatch):
    whole = as_rows(packing.pack(odd_docs, 64))
    monkeypatch.setattr(packing, "ROWS_A_RANGE", 40)
    parted = as_rows(packing.pack(odd_docs, 64))
    held(parted, as_rows(odd_docs), 64)
    assert max(r["sequence_id"] for r in parted) == max(r["sequence_id"] for r in whole)


def test_many_lengths_are_near_the_bound(spark, as_rows, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_A_RANGE", 1000)
    rng = random.Random(5)
    lengths = [(i, min(512, int(rng.lognormvariate(4, 1.2)) + 1)) for i in range(5000)]
    rows = as_rows(packing.assign(stash(spark.createDataFrame(lengths, "no long, length long"), "lengths"), 512, "no"))
    assert sorted(r["length"] for r in rows) == sorted(n for _, n in lengths)
    assert len({r["sequence_id"] for r in rows}) <= sum(n for _, n in lengths) / 512 * 1.01 + 1


def test_sweep_gives_each_piece_the_last_gap_not_taken():
    rng = random.Random(2)
    for _ in range(300):
        opens = [rng.random() < 0.5 for _ in range(rng.randint(0, 30))]
        stack, want = [], []
        for i, is_gap in enumerate(opens):
            if is_gap:
                stack.append(i)
            elif stack:
                want.append((stack.pop(), i))
        gap, piece = packing.brackets(np.array(opens, bool))
        assert sorted(zip(gap.tolist(), piece.tolist())) == sorted(want)


def test_words_have_the_tokenizers_ids():
    rng = random.Random(3)
    letters = list("abcXYZ019.,!?'\"-_<>|&%$#@ \n\t\r\x0b\x1c  éÉüßÿÀİıΣσςǅあ漢字ا٣½²́ëﬁ🙂​×÷µª") + ["'s", "'RE", "<|endoftext|>", "don't"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    ids, sizes = packing.WordTokenizer(PATH).encode(pa.array(texts))
    t = Tokenizer.from_file(PATH)
    at = 0
    for text, n in zip(texts, sizes.tolist()):
        assert ids[at : at + n].tolist() == t.encode(text, add_special_tokens=False).ids, text
        at += n


def test_pieces_of_words_give_the_tokenizers_ids():
    """Texts of odd characters, parted on their bytes, against the tokenizer itself."""
    import random

    import numpy as np
    import public_tokenizers
    import pyarrow as pa

    words = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    letters = [*"abcXYZ019 '.,<|>-_\t\r\n  éÉß×÷ÐþÿſİK中\U0001f642́\xa0\x00\x1f\x7f\x85~!&()", "<|endoftext|>", " it's ", " Don't", "</w>", "Ａ", "ﬁ"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(0, 30))) for _ in range(5000)] + [None, "", " ", "\n", "É", "<", "|"]
    ids, sizes = words.encode(pa.array(texts))
    want = [e.ids for e in words.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert sizes.tolist() == [len(x) for x in want]
    assert np.array_equal(ids, np.concatenate([np.array(x, np.uint32) for x in want]))
