"""Exact deduplication by content sort, with DataFrame functions only.

Rows are range-partitioned on their normalised content by the splitters that Spark samples, sorted inside their partition so
that equal texts become neighbours, and every text is compared in full with the one before it. A run of equal texts keeps
the row with the smallest identifier.

The range key holds the first characters of the content and a 64-bit hash of all of it: splitters then have a bounded size,
and texts that share a long opening still spread out. Equal texts agree on both, so they stay together; texts that merely
agree on both are told apart by the full comparison. A text that holds more than 1/50,000 of all rows (and over 200 rows) is
cut into salted parts by its identifier. Such texts number fewer than 50,000, so their hashes may be broadcast. The head of
each part (at most `SALTS` a text) meets the others in a second, small round, by SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

PREFIX_CHARS = 24
SALTS = 64
HOT_LEAST, HOT_SHARE = 200, 50_000


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", payload: list | None = None) -> DataFrame:
    """The `payload` columns (default: all) of every row of `df`, with `keep_id`, `group_size`, `kept` and `text_sha256`.

    `keep_id` is the smallest identifier among the rows of equal normalised text, `group_size` their number, and exactly one
    row of them is `kept`. Null text equals empty text. Null identifiers sort last: a group without any other has a null
    `keep_id`. Rows that repeat both identifier and text are one group, of which one row is kept. Columns of the input that
    bear one of the four names are replaced. An empty table gives an empty result.
    """
    added = ("keep_id", "group_size", "kept", "text_sha256")
    names = [c for c in (df.columns if payload is None else payload) if c not in added]
    plain = [F.col(f"`{c}`") for c in names]
    norm = normalised(F.col(text_col))
    rows = df.select(*plain, *[F.col(c) for c in {id_col, text_col} - {*names}], norm.alias("_x_norm"))
    rows = rows.withColumn("_x_hash", F.xxhash64("_x_norm"))
    counts = (df.select(F.xxhash64(norm).alias("_x_hash")).groupBy("_x_hash").agg(F.count(F.lit(1)).alias("_x_n"))
              .where(F.col("_x_n") > HOT_LEAST))
    total = df.agg(F.count(F.lit(1)).alias("_x_total"))
    hot = (counts.join(F.broadcast(total), F.col("_x_n") * HOT_SHARE > F.col("_x_total"))
           .select("_x_hash", F.lit(True).alias("_x_hot")))
    rows = rows.join(F.broadcast(hot), "_x_hash", "left")
    salt = F.when(F.col("_x_hot"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    rows = rows.withColumn("_x_prefix", F.substring("_x_norm", 1, PREFIX_CHARS)).withColumn("_x_salt", salt)
    # the shuffle carries the text once: either as it is (normalised again behind it) or normalised
    rows = rows.drop("_x_norm") if text_col in names else rows.drop(text_col)
    part = ("_x_prefix", "_x_hash", "_x_salt")
    order = ("_x_norm", F.col(id_col).asc_nulls_last())
    rows = rows.repartitionByRange(*part)
    rows = rows.withColumn("_x_norm", norm) if text_col in names else rows
    rows = rows.sortWithinPartitions(*part, *order)
    before = F.lag("_x_norm").over(Window.partitionBy(*part).orderBy(*order))
    run = Window.partitionBy(*part, "_x_norm")
    rows = rows.withColumn("_x_head", ~F.col("_x_norm").eqNullSafe(before)).select(
        *plain, "_x_hot", "_x_head", F.min(id_col).over(run).alias("_x_keep"), F.count(F.lit(1)).over(run).alias("_x_size"),
        F.sha2(F.col("_x_norm").cast("binary"), 256).alias("text_sha256"))
    rows = stored(rows, "content-sort")
    heads = (rows.where(F.col("_x_hot") & F.col("_x_head")).groupBy("text_sha256")
             .agg(F.min("_x_keep").alias("_x_least"), F.sum("_x_size").alias("_x_all")))
    rows = rows.join(F.broadcast(heads), "text_sha256", "left")
    keep = F.when(F.col("_x_hot"), F.col("_x_least")).otherwise(F.col("_x_keep"))
    # a salt follows from the identifier, so the part that holds the smallest one has its only head
    first_part = F.col("_x_hot").isNull() | F.col("_x_keep").eqNullSafe(F.col("_x_least"))
    return rows.select(*plain, keep.alias("keep_id"), F.when(F.col("_x_hot"), F.col("_x_all")).otherwise(F.col("_x_size"))
                       .alias("group_size"), (F.col("_x_head") & first_part).alias("kept"), "text_sha256")
