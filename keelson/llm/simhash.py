"""SimHash near-deduplication with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last one padded). If two fingerprints differ in at most
three bits, then either one segment is equal and another one differs in at most one bit, or each segment differs in exactly
one. So they meet under a key made of an equal segment and a codeword index of another one (all six ordered choices), or of
the codeword indices of all three. One side of the join has the nearest codewords only, the other side all of them; pairs
that meet are verified by counting the bits that differ. Equal fingerprints are one node, and linked nodes form components.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .components import connected_components
from .golay import LENGTH, codewords

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
SEGMENTS = ((0, 23), (23, 23), (46, 18))
VOTE_CHUNK = 1 << 15
KEY_ROWS = 1024
KEYS = "key bigint, fp bigint"


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a whole text: each bit is set if it is in over half the hashes of its word shingles."""
    split = text.lower().split()
    if not split:
        return 0
    joined = b" ".join(split)
    ends = [*accumulate(len(w) + 1 for w in split)]
    starts = [0, *ends[:-1]]
    last = min(words, len(split)) - 1
    shingles = [joined[a:e - 1] for a, e in zip(starts, ends[last:])]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), VOTE_CHUNK):
        part = hashes[at:at + VOTE_CHUNK]
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(df: DataFrame, text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """The columns of `df` but the text, and `fp`, the fingerprint of every text as a signed 64-bit number (null text: 0)."""
    names = [c for c in df.columns if c not in (text_col, "fp")]
    rows = df.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_s_text"))

    def make(batches):
        for b in batches:
            made = pa.array([fingerprint(t, words) for t in b.column(len(names)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], made], names=[*names, "fp"])

    return rows.mapInArrow(make, rows.select(*[F.col(f"`{c}`") for c in names], F.lit(0).cast("bigint").alias("fp")).schema)


def fuzzy_keys(values: np.ndarray, nearest_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row of each key) of fingerprints given as unsigned 64-bit numbers."""
    parts = [((values >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    codes = []
    for p in parts:
        near, more = codewords(p)
        codes.append(near[:, None] if nearest_only else np.concatenate([near[:, None], more], axis=1))
    keys, rows = [], []

    def add(tag: int, high: np.ndarray, low: np.ndarray):
        both = (high[:, :, None] << 12) | low[:, None, :]
        ok = (high[:, :, None] >= 0) & (low[:, None, :] >= 0)
        row = np.broadcast_to(np.arange(len(values))[:, None, None], both.shape)
        keys.append((both | (tag << 36))[ok])
        rows.append(row[ok])

    two = (codes[0][:, :, None] << 12) | codes[1][:, None, :]
    two[(codes[0][:, :, None] < 0) | (codes[1][:, None, :] < 0)] = -1
    add(0, two.reshape(len(values), -1), codes[2])
    for i in range(3):
        for j in range(3):
            if i != j:
                add(1 + 3 * i + j, parts[i][:, None], codes[j])
    return np.concatenate(keys), np.concatenate(rows)


def keyed(nodes: DataFrame, nearest_only: bool) -> DataFrame:
    """One row per key of every fingerprint."""
    def make(batches):
        for b in batches:
            values = b.column(0).to_numpy()
            for at in range(0, len(values), KEY_ROWS):
                part = values[at:at + KEY_ROWS]
                keys, rows = fuzzy_keys(part.view(np.uint64), nearest_only)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])

    return nodes.select("fp").mapInArrow(make, KEYS)


def linked_fingerprints(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a < b) of different fingerprints that differ in at most `max_bits` (3 at most) bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the keys meet for up to three differing bits")
    left = keyed(nodes, True).withColumnRenamed("fp", "a")
    right = keyed(nodes, False).withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    # Spark sizes the keys of a fingerprint, some 200 rows, as the fingerprint alone and would broadcast them
    return left.join(right.hint("merge"), "key").where(near).select("a", "b").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: the identifier, `fingerprint` (16 hex digits) and `component_id`, the smallest identifier
    reachable over links of at most `max_bits` differing bits.

    Null and empty texts have fingerprint zero and are linked like any other. Null identifiers do not count as the smallest;
    a component without any other has a null id. Repeated rows come back as often. Other columns are not read. An empty
    table gives an empty result.
    """
    docs = stored(fingerprints(df.select(F.col(id_col), F.col(text_col)), text_col, words), "fingerprints")
    named = component_least(docs, F.col(id_col), max_bits).select("fp", F.col("least").alias("component_id"))
    return docs.join(named.hint("merge"), "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def component_least(docs: DataFrame, value, max_bits: int) -> DataFrame:
    """fp and `least`: for every fingerprint of `docs` the smallest `value` (a column of docs) in its component."""
    nodes = stored(docs.groupBy("fp").agg(F.min(value).alias("least")), "nodes")
    roots = connected_components(linked_fingerprints(nodes, max_bits))
    rooted = nodes.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("least"))
    return rooted.drop("least").join(ids.hint("merge"), "root").select("fp", "least")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
                         max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of `df`, all columns, without near copies of others: of each component the smallest identifier stays, of rows
    with equal identifiers the one with the smallest text hash.

    A null identifier stays only if the component has no other. Null and empty texts form one component. Rows that repeat
    identifier and text count as one: they stay or go together. An empty table gives an empty result.
    """
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    docs = stored(fingerprints(df.select(F.col(id_col).alias("_s_id"), text_hash.alias("_s_hash"), F.col(text_col)), text_col, words), "fingerprints")
    order = F.struct(F.col("_s_id").isNull().alias("absent"), F.col("_s_id").alias("id"), F.col("_s_hash").alias("hash"))
    least = component_least(docs, order, max_bits)
    stays = F.col("least.id").eqNullSafe(F.col("_s_id")) & (F.col("least.hash") == F.col("_s_hash"))
    gone = docs.join(least.hint("merge"), "fp").where(~stays).select("_s_id", "_s_hash").distinct()
    return df.join(gone, F.col(id_col).eqNullSafe(F.col("_s_id")) & (text_hash == F.col("_s_hash")), "left_anti")
