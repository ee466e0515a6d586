"""Token ids as Parquet list columns.

Documents are range-partitioned and sorted by identifier, so that file statistics and page indexes find an identifier range
without reading the rest; ids are dictionary- or delta-encoded, in row groups and pages of stated sizes. Every row holds
its shard (file number) and its first token's position in the shard; positions in the whole corpus follow from one sum per
shard. Reading metadata does not touch the token column.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import scratch
from .tokens import encoder

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 512


def encoded_documents(df: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int) -> DataFrame:
    """Rows in order of the identifier (null first; equal ones by a hash of the text): shard, id, shard_start, n_tokens, tokens."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = [F.col("_t_id").asc_nulls_first(), F.col("_t_tie")]
    rows = df.select(F.col(id_col).alias("_t_id"), text.alias("_t_text"), F.xxhash64(text).alias("_t_tie"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_t_tie")
    end = end_id.to_bytes(4, "little")

    def encode(batches):
        enc, shard, start = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for b in batches:
            ids = [enc.encode(t) + end for t in b.column(1).to_pylist()]
            lengths = np.array([len(i) // 4 for i in ids], np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(
                pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), shard, np.int32)), b.column(0), pa.array(start + offsets[:-1]),
                                              pa.array(lengths), tokens], names=["shard", id_col, "shard_start", "n_tokens", "tokens"])
            start += int(offsets[-1])

    out = rows.select(F.lit(0).alias("shard"), F.col("_t_id").alias(id_col), F.lit(0).cast("bigint").alias("shard_start"),
                      F.lit(0).cast("bigint").alias("n_tokens"), F.array(F.lit(0)).alias("tokens"))
    return rows.mapInArrow(encode, out.schema)


def write_token_files(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json",
                      end_id: int = 1, encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES,
                      page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Encode whole texts (null: empty), append `end_id` to each, and write them below `path`.

    `encoding` is "dictionary" or "delta" for the token column. Null identifiers come first, rows that repeat an identifier
    stay apart; other columns are not read. An empty table gives files without rows.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    (encoded_documents(df, id_col, text_col, vocabulary, end_id).write.option("compression", "zstd")
     .option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", row_group_bytes)
     .option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows)
     .option("parquet.enable.dictionary#tokens.list.element", str(encoding == "dictionary").lower()).parquet(path))


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", low=None, high=None) -> DataFrame:
    """The written rows, or those with an identifier in [low, high]; only the columns used later are read."""
    rows = spark.read.parquet(path)
    if low is not None:
        rows = rows.where(F.col(id_col) >= low)
    return rows if high is None else rows.where(F.col(id_col) <= high)


def shard_offsets(files: DataFrame) -> DataFrame:
    """shard -> tokens of all shards before it; one row per file, from the metadata columns alone."""
    sums = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_offset"))


def token_checksums(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document read back: identifier, start in the corpus, n_tokens, crc32 of the ids."""
    rows = files.select("shard", F.col(id_col), "shard_start", "tokens")

    def checksums(batches):
        for b in batches:
            lists = b.column(3)
            flat, offsets = lists.flatten().to_numpy().astype("<u4"), lists.value_lengths().to_numpy()
            ends = np.cumsum(offsets)
            crc = [zlib.crc32(flat[e - n:e]) for e, n in zip(ends.tolist(), offsets.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(offsets.astype(np.int64)), pa.array(crc, pa.int64())],
                                             names=["shard", id_col, "shard_start", "n_tokens", "ids_crc32"])

    out = rows.select("shard", id_col, "shard_start", F.lit(0).cast("bigint").alias("n_tokens"), F.lit(0).cast("bigint").alias("ids_crc32"))
    found = rows.mapInArrow(checksums, out.schema).join(shard_offsets(files), "shard")
    return found.select(id_col, (F.col("shard_offset") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def token_output(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Write the files to the shared folder and return what is read back from them."""
    path = scratch(df.sparkSession, "tokens")
    write_token_files(df, path, id_col, text_col, **settings)
    return token_checksums(read_token_files(df.sparkSession, path, id_col), id_col)
