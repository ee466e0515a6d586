"""Best-fit packing with certified partitions.

Documents are dealt into partitions of bounded size and packed there by best-fit decreasing. Dual feasible functions give a
lower bound of each partition's bins; a partition that meets its bound is certified. While all partitions together need more
bins than the bound over all documents, the loosely filled bins of uncertified partitions and the few loosest bins of every
partition are opened again: their documents are exchanged, i.e. dealt anew into fewer partitions, and packed by best-fit
decreasing once more. A round that saves no bin is not taken and ends the search.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .tokens import encoder

CAPACITY = 2048
GROUP_ITEMS = 4_000
ROUNDS = 6
LOOSE_SHARE = 64          # a bin is loose if more than 1/64 of it is empty
LOOSEST = 8               # bins of every partition that are opened in any case


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every length, and the number of bins.

    Open bins are kept by the room that is left; one bit per room says whether there is such a bin, so the fullest bin that
    still takes a document is found by one shift.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    with_room: list = [[] for _ in range(capacity + 1)]
    mask, opened = 0, 0
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                mask ^= 1 << room
        else:
            b, room, opened = opened, capacity, opened + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - n
        if left:
            with_room[left].append(b)
            mask |= 1 << left
    return bins, offsets, opened


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The best bound that two families of dual feasible functions give; counts[n] documents have n tokens.

    Thresholds: documents longer than capacity - t fill a bin, those shorter than t count nothing, the rest as they are.
    Rounding: (k + 1) n / capacity counts as it is where it is whole, else its whole part counts as a k-th.
    """
    lengths = np.arange(capacity + 1)
    total = np.concatenate([[0], np.cumsum(counts * lengths)])
    number = np.concatenate([[0], np.cumsum(counts)])
    t = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - t + 1]
    middle = total[capacity - t + 1] - total[t]
    best = int(np.max(large + -(-middle // capacity)))
    for k in range(1, 33):
        scaled = (k + 1) * lengths
        value = np.where(scaled % capacity == 0, lengths * k, (scaled // capacity) * capacity)     # in units of 1 / (k capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint, slot bigint"


def token_pieces(df: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """Every document's tokens with the end id, cut into pieces: one row per piece, without the ids.

    Only a document longer than `capacity` is cut; its first piece may be shorter. `slot` numbers the pieces.
    """
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_p_text"))
    end = end_id.to_bytes(4, "little")

    def pieces(batches):
        enc, slot = encoder(vocabulary), TaskContext.get().partitionId() << 40
        for b in batches:
            owner, out = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = enc.encode(text) + end
                n = len(ids) // 4
                first = n % capacity or capacity
                for k, at in enumerate([0, *range(first, n, capacity)]):
                    length = first if k == 0 else capacity
                    owner.append(i)
                    out.append((k, at, length, zlib.crc32(memoryview(ids)[4 * at:4 * (at + length)]), slot))
                    slot += 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(owner, pa.int64())), *[pa.array(c, t) for c, t in zip(
                    zip(*out) if out else [()] * 5, (pa.int32(), *[pa.int64()] * 4))]],
                names=[id_col, "piece", "start", "length", "ids_crc32", "slot"])

    return rows.mapInArrow(pieces, rows.select(id_col, *[F.lit(0).cast(t).alias(n) for n, t in (c.split() for c in PIECES.split(", "))]).schema)


def pack_partitions(items: DataFrame, partitions: int, capacity: int, turn: int) -> DataFrame:
    """Deal the items into partitions and pack each; adds where every item lies and how its partition and bin turned out."""
    dealt = items.withColumn("part", F.pmod(F.xxhash64("slot", F.lit(turn)), F.lit(partitions)))
    slack = capacity // LOOSE_SHARE
    added = dealt.select("*", F.lit(0).cast("bigint").alias("bin"), F.lit(0).cast("bigint").alias("offset"),
                         F.lit(0).cast("bigint").alias("bins"), F.lit(0).cast("bigint").alias("bound"), F.lit(True).alias("loose"))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("slot", "ascending")]).combine_chunks()
        lengths = t.column("length").to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        fill = np.bincount(bins, weights=lengths, minlength=n)
        opened = (fill < capacity - slack) & (n > bound)
        opened[np.argsort(fill, kind="stable")[:LOOSEST]] = True
        loose = opened[bins]
        for name, column in (("bin", bins), ("offset", offsets), ("bins", np.full(len(bins), n, np.int64)),
                             ("bound", np.full(len(bins), bound, np.int64)), ("loose", loose)):
            t = t.append_column(name, pa.array(column))
        return t

    return dealt.groupBy("part").applyInArrow(pack, added.schema)


def best_fit_packing(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json",
                     capacity: int = CAPACITY, end_id: int = 0, group_items: int = GROUP_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece of a document: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty: one piece, the end id alone. Null and repeated identifiers and repeated rows are packed each
    by itself. Pieces of equal length are placed in the order they were numbered. Other columns are not read. An empty table
    gives an empty result.
    """
    items = stored(token_pieces(df, id_col, text_col, vocabulary, capacity, end_id), "pieces")
    keep = [id_col, "piece", "start", "length", "ids_crc32"]
    placed = [items.where(F.col("length") == capacity).select(*keep, (-1 - F.col("slot")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    todo = items.where(F.col("length") < capacity)
    counts = np.zeros(capacity + 1, np.int64)
    for r in todo.groupBy("length").count().collect():      # at most `capacity` rows
        counts[r["length"]] = r["count"]
    left, spared, before = int(counts.sum()), lower_bound(counts, capacity), None
    for turn in range(rounds):
        if not left:
            break
        packed = stored(pack_partitions(todo.select(*keep, "slot"), -(-left // group_items), capacity, turn), "packed")
        packed = packed.withColumn("sequence_id", F.shiftleft(F.lit(turn + 1).cast("bigint"), 56) + F.shiftleft("part", 20) + F.col("bin"))
        found = packed.groupBy("part").agg(
            F.max("bins").alias("bins"), F.countDistinct(F.when(F.col("loose"), F.col("bin"))).alias("open"),
            F.count(F.when(F.col("loose"), 1)).alias("items")).agg(F.sum("bins").alias("bins"), F.sum("open").alias("open"), F.sum("items").alias("items")).first()
        if before is not None and found["bins"] >= before[1]:
            placed.append(before[0])                        # no bin saved: the opened bins stay as they were
            before = None
            break
        if before is None and turn:
            raise AssertionError("a round without opened bins")
        total_fixed = (0 if before is None else before[2]) + found["bins"] - found["open"]
        if total_fixed + found["open"] <= spared or turn + 1 == rounds:
            placed.append(packed)
            before = None
            break
        placed.append(packed.where(~F.col("loose")))
        before = (packed.where("loose"), found["open"], total_fixed)
        todo, left = before[0], found["items"]
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p.select(*keep, "sequence_id", "offset"))
    return out
