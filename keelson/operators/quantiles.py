"""Exact quantiles for groups of any size.

Spark's `percentile` keeps every distinct value of a group in one task. `quantiles` narrows first: a mergeable sketch brackets
every wanted rank with guaranteed error, the rows below each bracket are counted, and only the distinct values inside it are
ranked. Groups so large that a bracket may still hold over MOST_DISTINCT values have it narrowed again, with a sketch of the values
inside, until it does not. The result is the same linear-interpolated quantile; nothing is approximate in it.

All values and probabilities of a call share the passes over the wide rows: one aggregate for the sketches, and one that counts
the rows below the brackets and gathers the members, which are few.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import any_of, col, null_safe_join
from .ordered import measured

SKETCH_ACCURACY = 2_000
MOST_DISTINCT = 1_000_000
#: Probabilities of the sketch that narrows a bracket: it is cut into this many parts.
CUTS = 256
#: Ends of brackets that a worker holds; beyond them the brackets are joined.
WIDE_NUMBERS = 2_000_000
CHUNK_ROWS = 1 << 17
#: Margins for short groups, as multiples of the sketch's.
WIDER = (10, 200)


def quantiles(df: DataFrame, keys, values: dict, probs, accuracy: int = SKETCH_ACCURACY, most: int = MOST_DISTINCT) -> DataFrame:
    """One row per key with an array of quantiles (in the order of `probs`) per named value column; NULL where a value is never
    there."""
    keys, probs, names = list(keys), [float(p) for p in probs], list(values)
    on, every = [*keys, "_i"], range(len(probs))
    wide = df.select(*keys, *[col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(values.values())])
    first, found = measured(_first_brackets(wide, keys, len(names), probs, accuracy), {"most": F.max("_n")})
    largest = found["most"] or 0
    left = largest * 4.0 / accuracy + 2 if largest * 2.0 / accuracy >= 4 else largest
    long = wide.unpivot(keys, [F.col(f"_v{i}").alias(str(i)) for i in range(len(names))], "_i", "_v").where("_v IS NOT NULL")
    brackets, before = first, left + 1
    while most < left < before:
        brackets, inside = measured(_narrowed(long, on, brackets, probs, accuracy), {"most": F.max("_left")})
        before, left = left, inside["most"] or 0
    kept = _ranked(wide, long, keys, first, brackets, len(names), len(probs))
    upto = Window.partitionBy(*on, "_j").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_j") + 1) * (F.col("_n") - 1)
    kept = kept.withColumns({"_end": F.sum("_c").over(upto) + F.get("_below", F.col("_j")), "_rank": rank})
    start = F.col("_end") - F.col("_c")

    def at(r):
        return F.max(F.when((start <= r) & (r < F.col("_end")), F.col("_v")))

    down, up = F.floor("_rank"), F.ceil("_rank")
    per = kept.groupBy(*on, "_j").agg(F.first("_rank").alias("_rank"), at(down).alias("_l"), at(up).alias("_h"))
    answer = F.when(F.col("_l").isNull() | F.col("_h").isNull(),
                    F.raise_error(F.lit("quantile rank fell outside its bracket")).cast("double")).when(
        (down == up) | (F.col("_l") == F.col("_h")), F.col("_l")).otherwise(
        (up - F.col("_rank")) * F.col("_l") + (F.col("_rank") - down) * F.col("_h"))
    answers = per.select(*keys, F.struct(F.col("_i").alias("i"), F.col("_j").alias("j"), answer.alias("v")).alias("_a")).groupBy(*keys).agg(
        F.array_sort(F.collect_list("_a")).alias("_a"))

    def of(i):
        own = F.transform(F.filter("_a", lambda s: s["i"] == str(i)), lambda s: s["v"])
        return F.when(F.size(own) > 0, own)

    # keys whose values are all null still get a row, like the plain aggregate gives
    return null_safe_join(first.select(*keys).distinct(), answers, keys).select(*keys, *[of(i).alias(n) for i, n in enumerate(names)])


def _first_brackets(wide: DataFrame, keys, n_values: int, probs, accuracy: int) -> DataFrame:
    """keys, _g (a number for the key), _i (value), _n (its readings), _lo0, _hi0, ...: a bracket for each probability, from one sketch per value.

    A bracket reaches the margin of the sketch to both sides; in groups so short that this does not cover two rows, a multiple of
    it. Open brackets hold the extreme ranks, and whole groups that are too short for any.
    """
    margins = [2.0 * m / accuracy for m in (1, *WIDER) if 2.0 * m / accuracy < 0.5]
    bounds = F.array(*[F.lit(b) for m in margins for p in probs for b in (max(p - m, 0.0), min(p + m, 1.0))])
    sketch = wide.groupBy(*keys).agg(*[F.struct(F.lit(str(i)).alias("_i"), F.count(f"_v{i}").alias("_n"),
                                                F.percentile_approx(f"_v{i}", bounds, accuracy).alias("_b")).alias(f"_s{i}") for i in range(n_values)]).withColumn("_g", F.monotonically_increasing_id())
    long = sketch.select(*keys, "_g", F.inline(F.array(*[f"_s{i}" for i in range(n_values)])))

    def end(j, side, beyond):
        found = F.when(F.col("_b").isNull(), beyond)
        for at, m in enumerate(margins):
            p = probs[j] + (m if side else -m)
            known = F.lit(beyond) if not 0 < p < 1 else F.get("_b", F.lit(2 * (at * len(probs) + j) + side))
            found = found.when(F.col("_n") * m >= 4, known)
        return found.otherwise(beyond)

    return long.select(*keys, "_g", "_i", "_n", *[e for j in range(len(probs)) for e in (
        end(j, 0, float("-inf")).alias(f"_lo{j}"), end(j, 1, float("inf")).alias(f"_hi{j}"))])


def _ranked(wide: DataFrame, long: DataFrame, keys, first: DataFrame, brackets: DataFrame, n_values: int, n_probs: int) -> DataFrame:
    """on, _j, _v, _c (copies), _below (readings below each bracket), _n: a row for each distinct value inside a bracket.

    One pass over the wide rows counts both, against all brackets as arrays in the Python workers. Brackets of more than
    WIDE_NUMBERS numbers are joined to the unpivoted rows instead.
    """
    on, every = [*keys, "_i"], range(n_probs)
    groups = WIDE_NUMBERS // (2 * n_values * n_probs)
    ends = [f"_{side}{j}" for j in every for side in ("lo", "hi")]
    ids = [r[0] for r in first.where("_i = '0'").select("_g").limit(groups + 1).collect()]
    if len(ids) > groups:
        rows = null_safe_join(long, brackets, on, "inner")
        below = rows.groupBy(*on).agg(F.array(*[F.count(F.when(F.col("_v") < F.col(f"_lo{j}"), 1)) for j in every]).alias("_below"), F.first("_n").alias("_n"))
        kept = _members(rows, on, lambda j: F.col("_v").between(F.col(f"_lo{j}"), F.col(f"_hi{j}")), every).groupBy(*on, "_j", "_v").agg(
            F.count(F.lit(1)).alias("_c"))
        return null_safe_join(kept, below, on)
    ids = np.sort(np.array(ids, np.int64))
    lows, highs = np.full((n_values, n_probs, len(ids)), np.inf), np.full((n_values, n_probs, len(ids)), -np.inf)
    for r in brackets.select("_g", "_i", *ends).collect():
        at = np.searchsorted(ids, r["_g"])
        lows[int(r["_i"]), :, at], highs[int(r["_i"]), :, at] = r[2::2], r[3::2]
    lows, highs = in_order(lows), in_order(highs)
    shared = wide.sparkSession.sparkContext.broadcast((ids, lows, highs))
    names = ["_g", "_i", "_j", "_v", "_c"]

    def count(batches):
        ids, lows, highs = shared.value
        below, held, size = np.zeros(lows.shape, np.int64), [], 0

        def members():
            table, found = pa.Table.from_batches(held), []
            group = np.searchsorted(ids, table.column(n_values).to_numpy())
            for i in range(n_values):
                column = table.column(i)
                known = column.is_valid().to_numpy()
                v, g = in_order(column.fill_null(0.0).to_numpy()[known]), group[known]
                for j in every:
                    low = lows[i, j][g]
                    below[i, j] += np.bincount(g[v < low], minlength=len(ids))
                    inside = (v >= low) & (v <= highs[i, j][g])
                    if inside.any():
                        found.append(np.column_stack([g[inside], np.full(inside.sum(), i * n_probs + j), v[inside]]))
            if found:
                found = np.concatenate(found)
                found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
                starts = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]).any(axis=1)]))
                g, at, v = found[starts].T
                yield pa.RecordBatch.from_arrays([pa.array(ids[g]), pa.array((at // n_probs).astype(np.int32)), pa.array((at % n_probs).astype(np.int32)),
                                                  pa.array(from_order(v)), pa.array(np.diff(np.append(starts, len(found))))], names=names)

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
                if size >= CHUNK_ROWS:
                    yield from members()
                    held, size = [], 0
        if held:
            yield from members()
        i, j, g = np.nonzero(below)
        if len(g):
            yield pa.RecordBatch.from_arrays([pa.array(ids[g]), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.nulls(len(g), pa.float64()),
                                              pa.array(below[i, j, g])], names=names)

    marked = null_safe_join(wide, F.broadcast(first.where("_i = '0'").select(*keys, "_g")), keys, "inner")
    counts = marked.select(*[f"_v{i}" for i in range(n_values)], "_g").mapInArrow(count, "_g bigint, _i int, _j int, _v double, _c bigint")
    summed = counts.groupBy(*names[:4]).agg(F.sum("_c").alias("_c")).withColumn("_i", F.col("_i").cast("string"))
    own = Window.partitionBy("_g", "_i", "_j")
    summed = summed.withColumn("_under", F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_c"))).over(own), F.lit(0))).where("_v IS NOT NULL")
    # each row has the count below its own bracket; the others of the array are not looked at
    of = brackets.select("_g", "_i", *keys, "_n").alias("b")
    kept = summed.join(of, ["_g", "_i"])
    return kept.withColumn("_below", F.array_repeat("_under", n_probs)).drop("_g", "_under")


def in_order(x: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order, with Spark's equality: -0 equals 0, and NaN is one value above all others."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def from_order(n: np.ndarray) -> np.ndarray:
    return (n ^ ((n >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


def _members(rows: DataFrame, on, inside, every) -> DataFrame:
    """on, _j (probability), _v: a row for each reading inside a bracket; most readings are in none."""
    near = rows.where(any_of([inside(j) for j in every]))
    return near.select(*on, "_v", F.explode(F.array_compact(F.array(*[F.when(inside(j), F.lit(j)) for j in every]))).alias("_j"))


def _narrowed(long: DataFrame, on, brackets: DataFrame, probs, accuracy: int) -> DataFrame:
    """The brackets, each cut down to the parts of a sketch of the readings between its ends around the wanted rank, and `_left`,
    a bound on the distinct values in the fullest one. Copies of an end do not count, so a heavy value cannot stop the cutting."""
    every, slack = range(len(probs)), 1 + -(-2 * CUTS // accuracy)
    ends = [f"_{side}{j}" for j in every for side in ("lo", "hi")]
    rows = null_safe_join(long, brackets.select(*on, "_g", "_n", *ends), on, "inner")
    counts = rows.groupBy(*on).agg(*[F.count(F.when(F.col("_v") <= F.col(f"_lo{j}"), 1)).alias(f"_upto{j}") for j in every],
                                   *[F.first(c).alias(c) for c in ("_g", "_n", *ends)])
    grid = F.array(*[F.lit(i / CUTS) for i in range(CUTS + 1)])
    parts = _members(rows, on, lambda j: (F.col("_v") > F.col(f"_lo{j}")) & (F.col("_v") < F.col(f"_hi{j}")), every).groupBy(*on, "_j").agg(
        F.count(F.lit(1)).alias("c"), F.percentile_approx("_v", grid, accuracy).alias("g"))
    own = [F.when(F.col("_j") == j, F.struct("c", "g")) for j in every]
    parts = parts.groupBy(*on).agg(*[F.first(o, ignorenulls=True).alias(f"_p{j}") for j, o in enumerate(own)])
    state = null_safe_join(counts, parts, on)

    def cut(j):
        count, part = F.coalesce(F.col(f"_p{j}.c"), F.lit(0)), F.col(f"_p{j}.g")
        rank, upto, lo, hi = F.lit(probs[j]) * (F.col("_n") - 1), F.col(f"_upto{j}"), F.col(f"_lo{j}"), F.col(f"_hi{j}")
        cell = CUTS / F.greatest(count, F.lit(1))
        low, high = F.floor((rank - upto) * cell).cast("int") - slack, F.ceil((rank - upto + 1) * cell).cast("int") + slack
        new_lo = F.when(F.floor(rank) >= upto + count, hi).when(low > 0, F.get(part, low)).otherwise(lo)
        new_hi = F.when(F.ceil(rank) < upto, lo).when(high < CUTS, F.get(part, F.greatest(high, F.lit(0)))).otherwise(hi)
        share = F.least((F.least(high, F.lit(CUTS)) - F.greatest(low, F.lit(0)) + 2.0 * CUTS / accuracy) / CUTS, F.lit(1.0))
        return {f"_lo{j}": new_lo, f"_hi{j}": new_hi}, F.when(new_lo >= new_hi, F.lit(1.0)).otherwise(share * count + 2)

    cuts = [cut(j) for j in every]
    lefts = [c[1] for c in cuts]
    most: Column = reduce(F.greatest, lefts[1:], lefts[0])
    return state.select(*on, "_g", "_n", *[e.alias(n) for c in cuts for n, e in c[0].items()], most.alias("_left"))


def quantile(df: DataFrame, keys, value, p: float, name: str) -> DataFrame:
    out = quantiles(df, keys, {name: value}, [p])
    return out.withColumn(name, F.col(name)[0])


def with_quantiles(df: DataFrame, keys, values: dict, probs, suffixes) -> DataFrame:
    """`quantiles` spread into one column per (value, prob): `<value>_<suffix>`."""
    q = quantiles(df, keys, values, probs)
    return q.select(*keys, *[F.col(n)[i].alias(f"{n}_{s}" if s else n)
                             for n in values for i, s in enumerate(suffixes)])
