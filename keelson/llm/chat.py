"""Chat formatting from every participant's perspective.

A dialogue is rendered once per participant: that speaker's turns as `assistant`, the others' as `user` with their name,
system turns as they are; masks mark what the assistant is to learn, its text and the end marker.

A conversation may be of any length. Turns are range-partitioned by conversation and order, so a long one spans several
partitions; character positions are running sums inside a partition plus the sums of the partitions before it, and the
rendering is cut into parts at turns, each of about `part_chars` characters, so that no task holds a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

PART_CHARS = 32_768
SYSTEM_ROLES = ("system",)
NAMELESS = "unknown"
ASSISTANT, USER, SYSTEM, END = "<|assistant|>\n", "<|user|>", "<|system|>\n", "<|end|>\n"


def ordered_turns(df: DataFrame, conv_col: str, turn_col: str, name_col: str, text_col: str) -> DataFrame:
    """conv, turn, name, text and slice: rows of one slice are neighbours in (conv, turn, name, text) order."""
    turns = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(name_col), F.lit(NAMELESS)).alias("name"),
                      F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = ("conv", "turn", "name", F.xxhash64("text"))        # a bounded key: splitters come to the driver
    # the slice numbers must stay as they are, hence the written table
    return stored(turns.repartitionByRange(*key).withColumn("slice", F.spark_partition_id()), "turns")


def rotate_perspectives(turns: DataFrame, system_roles=SYSTEM_ROLES) -> DataFrame:
    """One row per turn and participant of its conversation: conv, speaker, slice, order columns, segment, learn_from, learn_to.

    `segment` is the rendered turn; [learn_from, learn_to) inside it is what the assistant learns, empty for other turns.
    """
    system = F.col("name").isin(*system_roles)
    speakers = turns.where(~system).select(F.col("conv").alias("s_conv"), F.col("name").alias("speaker")).distinct()
    rows = turns.join(speakers, F.col("conv").eqNullSafe(F.col("s_conv"))).drop("s_conv")
    own = F.col("name") == F.col("speaker")
    head = F.when(own, F.lit(ASSISTANT)).when(system, F.lit(SYSTEM)).otherwise(F.concat(F.lit(USER), "name", F.lit("\n")))
    rows = rows.withColumn("segment", F.concat(head, "text", F.lit(END)))
    return rows.withColumn("learn_from", F.when(own, F.length(F.lit(ASSISTANT)))).withColumn("learn_to", F.when(own, F.length("segment")))


def chat_rotations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", name_col: str = "role", text_col: str = "text",
                   part_chars: int = PART_CHARS, system_roles=SYSTEM_ROLES) -> DataFrame:
    """conv_id, speaker, part, start, rendered, masks: every participant's rendering, in parts that begin `start` characters in.

    `masks` holds the character ranges [from, to) of `rendered` to learn. Turns are ordered by turn (null first), name and
    text; a null name is `unknown`, a null text empty; rows that repeat are rendered as often; rows without a conversation
    are one conversation. Conversations of system turns alone have no participant and give no row. A turn longer than a part
    is kept whole. Other columns are not read. An empty table gives an empty result.
    """
    rows = rotate_perspectives(ordered_turns(df, conv_col, turn_col, name_col, text_col), system_roles)
    order = (F.col("turn").asc_nulls_first(), "name", F.xxhash64("text"), "text")
    inside = Window.partitionBy("conv", "speaker", "slice").orderBy(*order)
    rows = rows.withColumn("size", F.length("segment").cast("bigint")).withColumn(
        "inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    sizes = rows.groupBy("conv", "speaker", "slice").agg(F.sum("size").alias("all"))
    before = Window.partitionBy("conv", "speaker").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv").alias("z_conv"), F.col("speaker").alias("z_speaker"), F.col("slice").alias("z_slice"),
                         F.coalesce(F.sum("all").over(before), F.lit(0)).alias("before"))
    placed = rows.join(sizes, F.col("conv").eqNullSafe(F.col("z_conv")) & (F.col("speaker") == F.col("z_speaker")) & (F.col("slice") == F.col("z_slice")))
    placed = placed.withColumn("at", F.col("before") + F.col("inside")).withColumn("part", F.floor(F.col("at") / part_chars))
    found = placed.groupBy("conv", "speaker", "part").agg(
        F.min("at").alias("start"), F.array_sort(F.collect_list(F.struct("at", "segment", "learn_from", "learn_to"))).alias("segments"))
    masks = F.transform(F.filter("segments", lambda s: s["learn_from"].isNotNull()), lambda s: F.struct(
        (s["at"] - F.col("start") + s["learn_from"]).alias("from"), (s["at"] - F.col("start") + s["learn_to"]).alias("to")))
    return found.select(F.col("conv").alias(conv_col), "speaker", "part", "start",
                        F.array_join(F.transform("segments", lambda s: s["segment"]), "").alias("rendered"), masks.alias("masks"))
