"""Byte-pair encoding and decoding by a contiguous rank array.

A short word is held as its parts and the ranks of its adjacent pairs, two flat lists. The smallest rank is found by a scan,
the boundary behind it is deleted, and only the ranks on its two sides are looked up again. A long word, for which repeated
scans would take quadratic time, gets the same merges from a heap over linked parts. Words that recur come from a bounded
cache; no tokenizer library is used.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import batch
from .tokens import BEFORE_WORD, BYTE_PATTERN, CACHE_PIECES, ODD_SPACE, PieceCache, byte_alphabet, packed, vocabulary_path

NO_RANK = 1 << 60
LONG_WORD = 256


class RankArrayBpe:
    """Encoder and decoder for a byte-level vocabulary file with pair merges."""

    def __init__(self, path: str, most: int = CACHE_PIECES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        to_byte = {c: b for b, c in byte_alphabet().items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.of_byte = [vocab[byte_alphabet()[b]] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.content = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items()}
        self.content |= {i: token.encode() for token, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(BYTE_PATTERN).findall
        self.cache = PieceCache(lambda piece: self._piece(" " + piece), most)

    def word(self, data: bytes) -> list:
        parts = [self.of_byte[b] for b in data]
        if len(parts) > LONG_WORD:
            return self._long(parts)
        get = self.ranks.get
        ranks = [get(pair, NO_RANK) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            at = ranks.index(least)
            parts[at] = self.merged[least]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = get((parts[at], parts[at + 1]), NO_RANK)
            if at:
                ranks[at - 1] = get((parts[at - 1], parts[at]), NO_RANK)
        return parts

    def _long(self, parts: list) -> list:
        n, get = len(parts), self.ranks.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i, pair in enumerate(zip(parts, parts[1:])) if (r := get(pair, NO_RANK)) != NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j < 0 or get((parts[i], parts[j]), NO_RANK) != rank:
                continue
            parts[i], parts[j], after[i] = self.merged[rank], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := get((parts[i], parts[after[i]]), NO_RANK)) != NO_RANK:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := get((parts[h], parts[i]), NO_RANK)) != NO_RANK:
                heapq.heappush(heap, (r, h))
        return [p for p in parts if p >= 0]

    def _piece(self, piece: str) -> bytes:
        return packed([i for word in self.words(piece) for i in self.word(word.encode())])

    def _segment(self, text: str) -> bytes:
        first, *rest = BEFORE_WORD.split(text) if ODD_SPACE.search(text) else text.split(" ")
        return self._piece(first) + b"".join(map(self.cache.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """The text's ids, packed; the special tokens' own strings become their ids."""
        if self.split_special and self.split_special.search(text):
            return b"".join(packed([self.special[part]]) if part in self.special else self._segment(part)
                            for part in self.split_special.split(text) if part)
        return self._segment(text)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.content.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


_CODERS: dict = {}


def coder(vocabulary: str) -> RankArrayBpe:
    """One coder per worker process and vocabulary."""
    if vocabulary not in _CODERS:
        _CODERS[vocabulary] = RankArrayBpe(vocabulary_path(vocabulary))
    return _CODERS[vocabulary]


def bpe_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per input row: the identifier and `ids`, the whole text's tokens as little-endian unsigned 32-bit integers.

    Null text counts as empty and has no ids; null and repeated identifiers are kept as they are; other columns are not read.
    """
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_b_text"))
    schema = rows.select(id_col, F.lit(b"").alias("ids"))

    def encoded(batches):
        bpe = coder(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.encode(t) for t in b.column(1).to_pylist()], pa.binary())],
                                             names=[id_col, "ids"])

    return rows.mapInArrow(encoded, schema.schema)


def bpe_decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per input row: the identifier and the decoded `text`; null ids give null."""
    rows = df.select(F.col(id_col), F.col(ids_col).alias("_b_ids"))

    def decoded(batches):
        bpe = coder(vocabulary)
        for b in batches:
            texts = [None if ids is None else bpe.decode(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return rows.mapInArrow(decoded, rows.select(id_col, F.lit("").alias("text")).schema)


DIGEST = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Encode every text, decode the ids again, and return the digests of both; neither leaves the worker."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_b_text"))

    def digests(batches):
        bpe = coder(vocabulary)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in b.column(1).to_pylist():
                ids = bpe.encode(text)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), *batch(DIGEST, (n, ids_sha, text_sha)).columns],
                                             names=[id_col, *DIGEST.names])

    out = rows.select(id_col, F.lit(0).cast("bigint").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256"))
    return rows.mapInArrow(digests, out.schema)
