"""Tokenizing operators against the tokenizer library and exact round trips."""

import glob
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from keelson.llm import bpe, common, packing, token_files
from keelson.llm.tokens import TextEncoder, packed, vocabulary_path

PIECES = ["a", "B", " ", "  ", "\n", "\t", " \n", "'s", "'T", "1", "²", "é", "É", "ß", "Σ", "ς", "\xa0", " ", "\x1c", "\x85", "<|endoftext|>",
          "<|startoftext|>", "<|", "!", "--", "中", "🙂", "é", "İ", "ﬁ", "\r\n", "٣", "the", " and", "don't,", "\x00", "."]


def texts(n=3000):
    rng = random.Random(1)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(40))) for _ in range(n)] + ["a" * 3000, "ab" * 2000 + " x", "", " ", "  "]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    library, mine = Tokenizer.from_file(vocabulary_path(name)), TextEncoder(vocabulary_path(name), name.startswith("word"), most=50)
    for t in texts():
        assert mine.encode(t) == packed(library.encode(t, add_special_tokens=False).ids), t


def test_rank_array_equals_the_library(monkeypatch):
    library, mine = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json")), bpe.RankArrayBpe(vocabulary_path("byte_bpe_50k.json"), most=50)
    for limit in (256, 3):                                 # 3: nearly all words take the way of long ones
        monkeypatch.setattr(bpe, "LONG_WORD", limit)
        mine.cache.clear()
        for t in texts(1500):
            ids = library.encode(t, add_special_tokens=False).ids
            assert mine.encode(t) == packed(ids), t
            assert mine.decode(packed(ids)) == library.decode(ids, skip_special_tokens=False) == t
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(6)]
        assert mine.decode(packed(ids)) == library.decode(ids, skip_special_tokens=False)


def test_bpe_operators(docs, empty):
    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    want = Counter()
    for r in docs.collect():
        ids = packed(library.encode(r.text or "", add_special_tokens=False).ids)
        want[(r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.round_trip(docs).collect())) == want
    coded = bpe.bpe_encode(docs)
    back = bpe.bpe_decode(coded)
    assert Counter(map(tuple, back.collect())) == Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert bpe.round_trip(empty).count() == 0


def check_packing(df, got, capacity):
    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    want = Counter()
    for r in df.collect():
        ids = packed(library.encode(r.text or "", add_special_tokens=False).ids + [0])
        n = len(ids) // 4
        first = n % capacity or capacity
        for k, at in enumerate([0, *range(first, n, capacity)]):
            length = first if k == 0 else capacity
            want[(r.doc_id, k, at, length, zlib.crc32(ids[4 * at:4 * (at + length)]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(docs, empty):
    check_packing(docs, packing.best_fit_packing(docs).collect(), 2048)
    check_packing(docs, packing.best_fit_packing(docs, capacity=64, group_items=9).collect(), 64)
    assert packing.best_fit_packing(empty).count() == 0


def test_packing_exchanges_documents(spark):
    rng = random.Random(4)
    rows = [(i, " the" * rng.randrange(3, 60)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    n = check_packing(df, packing.best_fit_packing(df, capacity=100, group_items=100).collect(), 100)
    one = packing.best_fit_decreasing(np.array([len(t) // 4 + 1 for _, t in rows]), 100)[2]
    alone = check_packing(df, packing.best_fit_packing(df, capacity=100, group_items=100, rounds=1).collect(), 100)
    assert one <= n < alone


def test_lower_bound_and_best_fit():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        bound = packing.lower_bound(np.bincount(lengths, minlength=101), 100)
        bins, offsets, n = packing.best_fit_decreasing(lengths, 100)
        assert bound <= n and np.bincount(bins, weights=lengths).max() <= 100
        assert bound >= -(-int(lengths.sum()) // 100)
    assert packing.lower_bound(np.bincount([51] * 10, minlength=101), 100) == 10
    assert packing.lower_bound(np.bincount([34] * 9, minlength=101), 100) >= 4


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, encoding):
    path = common.scratch(spark, "t")
    token_files.write_token_files(docs, path, encoding=encoding, row_group_bytes=1 << 16, page_rows=8)
    got = token_files.token_checksums(token_files.read_token_files(spark, path)).collect()
    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    coded = {t: packed(library.encode(t or "", add_special_tokens=False).ids + [1]) for t in {r.text for r in docs.collect()}}
    rows = docs.collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r.doc_id, len(coded[r.text]) // 4, zlib.crc32(coded[r.text])) for r in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):           # gapless, null identifiers first, then ascending
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    column = pq.ParquetFile(sorted(glob.glob(path + "/*.parquet"))[0]).metadata.row_group(0).column(4)
    assert column.has_offset_index and ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta")
    part = token_files.read_token_files(spark, path, low=100, high=120)
    assert {r.doc_id for r in part.select("doc_id").collect()} == set(range(100, 121))


def test_token_files_of_nothing(empty):
    assert token_files.token_output(empty).count() == 0
    with pytest.raises(ValueError):
        token_files.write_token_files(empty, "unused", encoding="other")
