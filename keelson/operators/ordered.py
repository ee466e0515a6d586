"""Ordered computations that do not depend on any key being small.

`Window.partitionBy(key)` puts a whole key into one task, which is wrong when a single vessel owns a third of the table.
Here rows get a global position inside their key (range partitioning on key and order, so hot keys split by themselves),
positions are cut into slices of a fixed number of rows, and windows run per (key, slice). Frames that look a bounded number
of rows back or ahead get copies of the neighbouring rows; running frames get the state carried over from earlier slices,
computed from a table with one row per slice. This is the only plan, whatever the size of the input.

The last ordering column should be unique (a row id), so ties cannot make the result depend on partitioning.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from ..functions.columns import null_safe_join

ROWS_PER_SLICE = 1_000_000
SLIDING_ROWS = 250_000
PART_ROWS = 100_000
SLICE_CONF = "spark.keelson.rowsPerSlice"


def use_checkpoints(spark: SparkSession) -> None:
    """Point the context at the shared folder the cluster names in spark.checkpoint.dir.

    Only a session that runs wholly on this machine may leave the setting out; it gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="keelson-checkpoint-"))


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage into replicated storage, so a lost executor cannot change what was computed."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, folders=()) -> DataFrame:
    """Store rows as Parquet in the checkpoint folder and read them back: what was computed once, like a row's place in its
    file, cannot change, and later passes read only the columns they need, and of the `folders` columns only the values they ask for.
    The folder is left to whoever clears it."""
    spark = df.sparkSession
    use_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4().hex}"
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])       # a header may hold characters that Parquet does not allow
    plain.write.option("compression", "zstd").partitionBy(*[f"c{names.index(c)}" for c in folders]).parquet(path)
    back = spark.read.schema(plain.schema).parquet(path)
    return back.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


BROADCAST_BYTES = 16 << 20


def measured(table: DataFrame, metrics: dict | None = None) -> tuple[DataFrame, dict]:
    """Compute a per-group table once; hand it on for joining back to the rows, with `metrics` (name -> aggregate) over it.

    The table is stored, so later passes do not repeat the scan behind it. Its rows and the characters and elements in them
    are counted as it is written: up to BROADCAST_BYTES it is broadcast, which spares the row side a shuffle; beyond that it
    joins as usual.
    """
    kinds = {f.name: f.dataType.typeName() for f in table.schema.fields}
    sizes = [F.coalesce(F.length(F.col(f"`{c}`")) if k == "string" else F.size(F.col(f"`{c}`")) * 16, F.lit(0)) for c, k in kinds.items()
             if k in ("string", "array", "map")]
    held = F.lit(24 + 16 * len(kinds))
    for size in sizes:
        held = held + size
    seen = Observation()
    counted = table.observe(seen, F.sum(held.cast("bigint")).alias("_bytes"), *[m.alias(n) for n, m in (metrics or {}).items()])
    table, found = durable(counted), seen.get
    return (table if (found.get("_bytes") or 0) > BROADCAST_BYTES else F.broadcast(table)), found


def settled(table: DataFrame) -> DataFrame:
    return measured(table)[0]


def attach(rows: DataFrame, table: DataFrame, keys, how: str = "left") -> DataFrame:
    """Join a per-group table back to its rows (NULL keys match each other)."""
    return null_safe_join(rows, settled(table), keys, how)


def with_position(df: DataFrame, keys, order, name: str = "_pos") -> DataFrame:
    """0-based position of each row within its key, for keys of any size.

    The range-partitioned rows are checkpointed before they are numbered: the numbering refers to
    partition ids, which must not move if part of the job is run again.
    """
    keys, order = list(keys), list(order)
    ranged = durable(df.repartitionByRange(*[F.col(c) for c in keys], *order)
                     .sortWithinPartitions(*[F.col(c) for c in keys], *order)
                     .withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    runs = ranged.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*keys, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first"))
                       .alias("_shift"))
    return (attach(ranged, runs, [*keys, "_part"], "inner")
            .withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift"))


def in_sequence(df: DataFrame, keys, order) -> DataFrame:
    """The rows sorted on keys and order over range partitions of about PART_ROWS rows, stored as they lie; `_part` numbers these.

    A task that reads one partition gets its rows in order, and the partitions follow each other in the same order.
    """
    by = [*[F.col(c) for c in keys], *[F.col(o) if isinstance(o, str) else o for o in order]]
    size = min(int(df.sparkSession.conf.get(SLICE_CONF, str(PART_ROWS))), PART_ROWS)
    parts = max(1, -(-df.count() // size))
    return durable(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()))


class Ordered:
    """Rows of `df` in `order` within `keys`; see the module text for how it scales."""

    def __init__(self, df: DataFrame, keys, order):
        self.keys = list(keys)
        self.df = with_position(df, self.keys, [F.col(o) if isinstance(o, str) else o for o in order])
        self.rows_per_slice = int(df.sparkSession.conf.get(SLICE_CONF, str(ROWS_PER_SLICE)))

    def _window(self, *extra):
        return Window.partitionBy(*self.keys, *extra).orderBy("_pos")

    def position(self, name: str) -> "Ordered":
        self.df = self.df.withColumn(name, F.col("_pos"))
        return self

    def _spread(self, size: int, before: int, after: int) -> DataFrame:
        """The rows by slice (`_slice`) of `size` rows, with copies of the neighbouring ones (whose `_own` slice is another)."""
        own = F.floor(F.col("_pos") / size)
        inside = F.col("_pos") % size
        targets = F.array_compact(F.array(
            own,
            F.when(inside >= size - before, own + 1),
            F.when((inside < after) & (own > 0), own - 1)))
        return self.df.withColumn("_own", own).withColumn("_slice", F.explode(targets))

    def frame(self, columns, before: int = 0, after: int = 0) -> "Ordered":
        """Add `columns(window) -> {name: Column}` whose frames reach at most before/after rows."""
        spread = self._spread(max(self.rows_per_slice, 2 * (before + after + 1)), before, after)
        spread = spread.withColumns(columns(self._window("_slice")))
        self.df = spread.where(F.col("_slice") == F.col("_own")).drop("_slice", "_own")
        return self

    def sliding(self, before: int, after: int, name: str, value: str, function) -> "Ordered":
        """Add the double column `name`: `function(values)` gets the `value` column of consecutive rows as numpy doubles (NaN for
        NULL) and returns one number per row that depends on at most before/after rows around it.

        A slice is one Arrow table in a Python worker, so slices here have at most SLIDING_ROWS rows and the neighbours.
        """
        size = max(min(self.rows_per_slice, SLIDING_ROWS), 2 * (before + after + 1))
        spread = self._spread(size, before, after)
        schema = self.df.withColumn(name, F.lit(None).cast("double")).schema
        columns = schema.names

        def slid(table):
            table = table.sort_by("_pos")
            numbers = table.column(value).to_numpy(zero_copy_only=False).astype(float)
            table = table.append_column(name, pa.array(function(numbers), pa.float64(), from_pandas=True))
            return table.filter(pc.equal(table.column("_slice"), table.column("_own"))).select(columns)

        self.df = spread.groupBy(*self.keys, "_slice").applyInArrow(slid, schema)
        return self

    def running(self, sums: dict | None = None, lasts: dict | None = None) -> "Ordered":
        """Running totals up to and including the row, and latest non-null values before the row."""
        sums, lasts = sums or {}, lasts or {}
        rows = self.df.withColumns({"_slice": F.floor(F.col("_pos") / self.rows_per_slice),
                                    **{f"_in_{n}": c for n, c in {**sums, **lasts}.items()}})
        state = rows.groupBy(*self.keys, "_slice").agg(
            *[F.sum(f"_in_{n}").alias(f"_s_{n}") for n in sums],
            *[F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), F.col("_pos"))).alias(f"_l_{n}")
              for n in lasts])
        prior = (Window.partitionBy(*self.keys).orderBy("_slice")
                 .rowsBetween(Window.unboundedPreceding, -1))
        state = state.select(
            *self.keys, "_slice",
            *[F.coalesce(F.sum(f"_s_{n}").over(prior), F.lit(0)).alias(f"_c_{n}") for n in sums],
            *[F.last(f"_l_{n}", ignorenulls=True).over(prior).alias(f"_c_{n}") for n in lasts])
        rows = null_safe_join(rows, state, [*self.keys, "_slice"])
        w = self._window("_slice")
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        prior = w.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumns({
            **{n: F.sum(f"_in_{n}").over(upto) + F.col(f"_c_{n}") for n in sums},
            **{n: F.coalesce(F.last(f"_in_{n}", ignorenulls=True).over(prior), F.col(f"_c_{n}"))
               for n in lasts}})
        self.df = rows.drop("_slice", *[f"_{p}_{n}" for n in {**sums, **lasts} for p in ("in", "c")])
        return self

    def result(self) -> DataFrame:
        return self.df.drop("_pos")


def lagged(df: DataFrame, keys, order, columns: dict) -> DataFrame:
    """Add the previous row's value of each `name: Column` in `columns`."""
    return Ordered(df, keys, order).frame(
        lambda w: {n: F.lag(c).over(w) for n, c in columns.items()}, before=1).result()


def runs(df: DataFrame, keys, order, value, name: str = "run_id") -> DataFrame:
    """Number the maximal runs of equal consecutive `value` (NULL equals NULL) inside each key."""
    tagged = df.withColumn("_v", F.struct(value.alias("v")))
    o = Ordered(tagged, keys, order).frame(lambda w: {"_prev": F.lag("_v").over(w)}, before=1)
    # a first row has no previous struct; a null value sits inside a non-null struct
    starts = F.when(F.col("_prev").isNull() | ~F.col("_prev.v").eqNullSafe(F.col("_v.v")), 1).otherwise(0)
    return o.running(sums={name: starts}).result().drop("_v", "_prev")


def trailing_range(df: DataFrame, keys, time_col: str, span_us: int, columns) -> DataFrame:
    """Windows over (t - span, t] in time. `columns(window)` gets a RANGE window spec.

    Rows are counted per key and step of one span; steps in order are gathered into slices of a fixed number of rows, so a
    burst gets slices of its own. Each slice also receives the rows of the last span before it.
    """
    # the frame is (t - span, t]: a row exactly one span earlier is outside
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(time_col))
    rows = df.withColumn("_us", micros).withColumn("_step", F.floor(F.col("_us") / span_us))
    target = int(df.sparkSession.conf.get(SLICE_CONF, str(ROWS_PER_SLICE)))
    steps = rows.groupBy(*keys, "_step").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("_own", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / target))
    # a slice also needs the rows of the step before its first one
    ahead = F.lead(F.struct("_step", "_own")).over(Window.partitionBy(*keys).orderBy("_step"))
    steps = steps.withColumn("_ahead", ahead).select(*keys, "_step", "_own", F.array_compact(F.array(
        F.col("_own"), F.when((F.col("_ahead._step") == F.col("_step") + 1) & (F.col("_ahead._own") != F.col("_own")), F.col("_ahead._own")))).alias("_slices"))
    rows = attach(rows, steps, [*keys, "_step"]).withColumn("_slice", F.explode_outer("_slices"))
    spec = Window.partitionBy(*keys, "_slice").orderBy("_us").rangeBetween(-(span_us - 1), 0)
    return (rows.withColumns(columns(spec)).where(F.col("_slice").eqNullSafe(F.col("_own")))
            .drop("_us", "_step", "_own", "_slices", "_slice"))
