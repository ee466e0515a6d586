"""Row-order analytics: steps, rates of change, runs, rolling statistics."""

from __future__ import annotations

import copy
import pickle
from decimal import ROUND_HALF_EVEN, Decimal
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import half_even, seconds
from .ordered import Ordered, attach, in_sequence, lagged, runs, trailing_range, written
from .quantiles import quantile

MAX_STEP_S = 300.0


def step_diff(df: DataFrame, value: str, keys=("vessel_id",), time="Date", rid="rid") -> DataFrame:
    out = lagged(df, keys, [time, rid], {"_t": F.col(time), "_v": F.col(value)})
    return out.withColumns({"dt_s": seconds("_t", time), "dv": F.col(value) - F.col("_v")}).drop("_t", "_v")


class SequenceState:
    """What is known of one key after its rows so far: their number, the time of the last one, and per signal the last reading
    and the run of equal readings that it belongs to."""

    def __init__(self, signals: int, key=None):
        self.key, self.rows, self.last = key, 0, (0, False)
        self.has = [False] * signals
        self.first, self.value = ([np.nan] * signals for _ in range(2))                      # the first reading and the last one
        self.time, self.began = ([(0, False)] * signals for _ in range(2))                   # of the last reading and of its run's first
        self.runs, self.length = ([0] * signals for _ in range(2))

    def followed_by(self, later: "SequenceState") -> "SequenceState":
        """The state after the rows of both, `later` being that of the rows behind this one's."""
        if later.key != self.key:
            return later
        out = copy.deepcopy(later)
        out.rows += self.rows
        for j, has in enumerate(later.has):
            if not self.has[j]:
                continue
            out.first[j] = self.first[j]
            if not has:
                for name in ("has", "value", "time", "began", "runs", "length"):
                    getattr(out, name)[j] = getattr(self, name)[j]
                continue
            goes_on = bool(_same(np.array([self.value[j]]), np.array([later.first[j]]))[0])
            if goes_on and later.runs[j] == 1:
                out.length[j], out.began[j] = out.length[j] + self.length[j], self.began[j]
            out.runs[j] += self.runs[j] - goes_on
        return out


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal at 4 decimals, rounded half to even on the shortest decimal form as Spark's bround does. NaN equals NaN. Only numbers
    that differ by no more than a unit of the last place have to be rounded."""
    same = (a == b) | (np.isnan(a) & np.isnan(b))
    with np.errstate(invalid="ignore"):
        close = np.flatnonzero(~same & (np.abs(a - b) <= 1.001e-4))
    for i in close:
        same[i] = Decimal(repr(float(a[i]))).quantize(PLACE, ROUND_HALF_EVEN) == Decimal(repr(float(b[i]))).quantize(PLACE, ROUND_HALF_EVEN)
    return same


PLACE = Decimal("0.0001")


def _key_at(batch, n_keys: int, i: int) -> str:
    return repr(tuple(batch.column(k)[i].as_py() for k in range(n_keys)))


def _numbers(column) -> tuple:
    """Values of a numeric Arrow column and where they are not null."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False), known


def walked(batch, n_keys: int, n_signals: int, state: SequenceState) -> tuple:
    """(state after the batch, [(values, known)] of its new columns). Columns of the batch: keys, microseconds, and the readings.
    New columns: position in the key, microseconds from the row before, and the STEP columns of every signal."""
    n = batch.num_rows
    at, new = np.arange(n), np.zeros(n, bool)
    for k in range(n_keys):
        codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    key = _key_at(batch, n_keys, 0)
    new[0] = key != state.key
    if new[0]:
        state = SequenceState(n_signals, key)
        new[0] = False                                          # the fresh state stands before the first row
    ours = np.cumsum(new) == 0                                  # rows of the key that the state belongs to
    start = np.maximum.accumulate(np.where(new, at, 0))
    end = state if ours[-1] else SequenceState(n_signals, _key_at(batch, n_keys, n - 1))
    us, timed = _numbers(batch.column(n_keys))
    back = np.maximum(at - 1, 0)
    before, before_known = np.where(at > start, us[back], 0), np.where(at > start, timed[back], False)
    if ours[0]:
        before[0], before_known[0] = state.last
    out = [(at - start + np.where(ours, state.rows, 0), np.ones(n, bool)), (us - before, timed & before_known)]
    nxt = copy.deepcopy(end)
    nxt.rows, nxt.last = int(out[0][0][-1]) + 1, (int(us[-1]), bool(timed[-1]))
    for j in range(n_signals):
        x, m = _numbers(batch.column(n_keys + 1 + j))
        latest = np.maximum.accumulate(np.where(m, at, -1))
        prev = np.concatenate([[-1], latest[:-1]])
        inside = prev >= start
        have = m & (inside | (ours & state.has[j]))
        prev = np.maximum(prev, 0)
        old_t, old_timed = np.where(inside, us[prev], state.time[j][0]), np.where(inside, timed[prev], state.time[j][1])
        old = np.where(inside, x[prev], state.value[j])
        same = np.zeros(n, bool)
        same[have] = _same(x[have], old[have])
        changed = m & ~same
        runs, seen = np.cumsum(changed), np.cumsum(m)
        run = runs - (runs - changed)[start] + np.where(ours, state.runs[j], 0)
        opened = np.maximum.accumulate(np.where(changed, at, -1))
        here, opened = opened >= start, np.maximum(opened, 0)
        length = np.where(here, seen - seen[opened] + 1, seen + state.length[j])
        began, began_known = np.where(here, us[opened], state.began[j][0]), np.where(here, timed[opened], state.began[j][1])
        out += [(x, m), (x - old, have), (us - old_t, have & timed & old_timed), (run, m),
                (length, same), (us - began, same & timed & began_known), (old_t - began, same & old_timed & began_known)]
        i = int(latest[-1])
        if i >= start[-1]:
            if not end.has[j]:
                nxt.first[j] = float(x[int(start[-1]) + int(np.argmax(m[start[-1]:]))])
            nxt.has[j], nxt.value[j], nxt.time[j] = True, float(x[i]), (int(us[i]), bool(timed[i]))
            nxt.runs[j], nxt.length[j], nxt.began[j] = int(run[i]), int(length[i]), (int(began[i]), bool(began_known[i]))
    return nxt, out


STEP = {"v": "double", "dv": "double", "dt": "bigint", "run": "bigint", "len": "bigint", "age": "bigint", "old": "bigint"}


def step_table(df: DataFrame, signals, keys=("vessel_id",), time="Date", order=("Date", "rid")) -> DataFrame:
    """The rows in order, wide and stored: keys, `ts`, `pos`, `step_us` (since the row before), and per signal the STEP columns.

    These are the reading, its difference and microseconds to the signal's previous reading, the number of its run of equal
    values (at 4 decimals), and for all but the first reading of a run the readings in it so far and the microseconds from its first
    reading to this one and to the previous one.
    """
    signals = list(signals)
    new = {"pos": "bigint", "step_us": "bigint", **{f"_{c}_{s}": kind for s in signals for c, kind in STEP.items()}}
    return _walk(df, signals, keys, time, order, new, lambda columns: columns)


RATE = {"rate": "double", "still": "tinyint", "more": "bigint"}


def rate_table(df: DataFrame, signals, keys=("vessel_id",), time="Date", order=("Date", "rid"), max_step_s: float = MAX_STEP_S,
               frozen_s: float = np.inf) -> DataFrame:
    """What reports on rates need of a `step_table`, a third of its columns: keys, `ts`, `step_us`, and per signal the RATE columns.

    `rate` is the size of the rate of change, `still` is 1 where a reading equals the one before and 0 on other readings, `more` by
    how much the reading raises the number of those in runs of `frozen_s` seconds or longer (see `frozen_points`).
    """
    signals = list(signals)
    new = {"step_us": "bigint", **{f"_{c}_{s}": kind for s in signals for c, kind in RATE.items()}}

    def rates(columns):
        out = [columns[1]]
        for j in range(len(signals)):
            (_, m), (dv, have), (us, timed), _, (length, _), (age, aged), (old, olden) = columns[2 + 7 * j:9 + 7 * j]
            dt = us / 1e6
            rated = have & timed & (dt > 0) & (dt <= max_step_s)
            with np.errstate(all="ignore"):
                rate = np.abs(dv / np.where(rated, dt, 1.0))
            now, then = aged & (age / 1e6 >= frozen_s), olden & (old / 1e6 >= frozen_s)
            out += [(rate, rated), ((have & (dv == 0)).astype(np.int8), m), (np.where(now, length, 0) - np.where(then, length - 1, 0), m)]
        return out

    return _walk(df, signals, keys, time, order, new, rates)


_ARROW = {"double": pa.float64(), "bigint": pa.int64(), "tinyint": pa.int8()}


def _walk(df: DataFrame, signals, keys, time, order, new: dict, made) -> DataFrame:
    """keys, `ts` and the `new` columns of the rows in order, stored. `made` turns the columns of `walked` into these.

    The sorted partitions are walked twice, batch by batch: first for the state at the end of each, one small row a partition, then
    with the state that the partitions before leave to its first key.
    """
    keys, n_keys, n = list(keys), len(list(keys)), len(signals)
    rows = in_sequence(df.select(*dict.fromkeys([*keys, *order, time, *signals])), keys, order)
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast(df.schema[time].dataType), F.col(time))
    value = [F.col(s).cast("double") for s in signals]
    given = rows.select(*keys, micros.alias("_us"), *[v.alias(f"_v{j}") for j, v in enumerate(value)], F.col(time).alias("ts"), "_part")

    def ends(batches):
        state = first = part = None
        for b in batches:
            if b.num_rows:
                first, part = (first or _key_at(b, n_keys, 0)), b.column(b.num_columns - 1)[0].as_py()
                state = walked(b, n_keys, n, state or SequenceState(n))[0]
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps((first, state))], pa.binary())], names=["part", "state"])

    carried, before = {}, SequenceState(n)
    for r in sorted(given.mapInArrow(ends, "part int, state binary").collect(), key=lambda r: r["part"]):
        first, state = pickle.loads(r["state"])
        carried[r["part"]] = before
        before = before.followed_by(state)
    shared = df.sparkSession.sparkContext.broadcast(carried)
    shape = given.select(*keys, "ts", *[F.lit(None).cast(kind).alias(c) for c, kind in new.items()]).schema

    def steps(batches):
        state = None
        for b in batches:
            if b.num_rows:
                state, columns = walked(b, n_keys, n, state or shared.value[b.column(b.num_columns - 1)[0].as_py()])
                cells = [pa.array(x, _ARROW[kind], mask=~known) for (x, known), kind in zip(made(columns), new.values())]
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(n_keys)], b.column(b.num_columns - 2), *cells], names=shape.names)

    return written(given.mapInArrow(steps, shape))


def step_columns(s: str, max_step_s: float = MAX_STEP_S) -> dict:
    """The columns of one signal of a `step_table`. `roc` is NULL unless 0 < dt <= max_step_s."""
    dt = F.col(f"_dt_{s}") / 1e6
    return {"value": F.col(f"_v_{s}"), "dv": F.col(f"_dv_{s}"), "dt_s": dt, "run_id": F.col(f"_run_{s}"),
            "run_length": F.coalesce(F.col(f"_len_{s}"), F.lit(1)), "run_s": F.col(f"_age_{s}") / 1e6, "run_before_s": F.col(f"_old_{s}") / 1e6,
            "roc": F.when((dt > 0) & (dt <= max_step_s), F.col(f"_dv_{s}") / dt)}


def signal_steps(df: DataFrame, signals, keys=("vessel_id",), time="Date", order=("Date", "rid"),
                 max_step_s: float = MAX_STEP_S) -> DataFrame:
    """One row per non-missing reading: value, step to the signal's previous reading, rate, run id.

    The wide table is ordered once for all signals; "previous reading" skips the signal's own gaps.
    `roc` is NULL unless 0 < dt <= max_step_s. Run ids number runs of equal value at 4 decimals; `run_length` and `run_s` are the
    readings and seconds of the run so far, `run_before_s` the seconds up to the previous reading (both NULL on a run's first).
    What is stored is the wide table; whoever reads the steps scans the columns it needs, signal by signal.
    """
    wide = step_table(df, signals, keys, time, order)
    return reduce(DataFrame.unionByName, [
        wide.where(F.col(f"_v_{s}").isNotNull()).select(*keys, "ts", "pos", F.lit(s).alias("signal"), *[c.alias(n) for n, c in step_columns(s, max_step_s).items()])
        for s in signals])


def run_length_islands(df: DataFrame, value: str, digits: int = 4, keys=("vessel_id",), time="Date",
                       rid="rid") -> DataFrame:
    """Maximal runs of equal value: length, first and last time."""
    narrow = df.where(F.col(value).isNotNull()).select(*keys, time, rid, value)
    tagged = runs(narrow, keys, [rid], half_even(F.col(value), digits))
    return tagged.groupBy(*keys, "run_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(rid).alias("rid_start"), F.max(rid).alias("rid_end"),
        F.min(time).alias("ts_start"), F.max(time).alias("ts_end"), F.first(half_even(F.col(value), digits)).alias("v"))


def anomaly_runs(df: DataFrame, flag="is_anomaly", keys=("vessel_id",), time="Date", rid="rid") -> DataFrame:
    """Consecutive anomalous rows in time order: length, start and end."""
    narrow = df.where(F.col(time).isNotNull()).select(*keys, time, rid, F.coalesce(F.col(flag), F.lit(False)).alias("_flag"))
    tagged = runs(narrow, keys, [time, rid], F.col("_flag"))
    return tagged.where("_flag").groupBy(*keys, "run_id").agg(
        F.count(F.lit(1)).alias("run_length"), F.min(time).alias("run_start"), F.max(time).alias("run_end"))


def run_length_histogram(found: DataFrame, keys=("vessel_id",), longest: int | None = None) -> DataFrame:
    """Runs by length; with `longest`, longer ones are left out."""
    return (found if longest is None else found.where(F.col("run_length") <= longest)).groupBy(*keys, "run_length").agg(F.count(F.lit(1)).alias("n_runs"))


def rolling_rate(df: DataFrame, flag="is_anomaly", keys=("vessel_id",), time="Date", hours: float = 1.0,
                 name="rolling_rate_pct") -> DataFrame:
    """Share of flagged rows in (t - 1 h, t], in percent."""
    value = F.col(flag).cast("double")
    return trailing_range(df.where(F.col(time).isNotNull()), keys, time, int(hours * 3_600_000_000),
                          lambda w: {name: F.avg(value).over(w) * 100})


def rolling_mean_centered(df: DataFrame, signals, keys=("vessel_id",), order=("Date", "rid"), rows: int = 200,
                          at_least: int = 20) -> DataFrame:
    """Centred row-count rolling mean: rows i - n/2 … i + n/2 - 1, NULL below `at_least` values."""
    half = rows // 2

    def cols(w):
        w = w.rowsBetween(-half, half - 1)
        return {f"roll_{s}": F.when(F.count(s).over(w) >= at_least, F.avg(s).over(w)) for s in signals}

    return Ordered(df, keys, order).frame(cols, before=half, after=half).result()


def rolling_median_by(df: DataFrame, value: str, by: str, keys=("vessel_id",), rid="rid", rows: int = 400,
                      at_least: int = 30, name="rolling_median") -> DataFrame:
    """Centred rolling median of `value` in the order of `by`, after clipping it to ± p99 of its size."""
    p99 = quantile(df, keys, F.abs(F.col(value)), 0.99, "_p99")
    clipped = attach(df, p99, keys).withColumn(
        "clipped", F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), -F.col("_p99")), F.col("_p99")))).drop("_p99")
    half = rows // 2

    def medians(values):
        # a trailing window that ends half - 1 rows later; its ordered values are kept in a skip list that rows enter and leave
        ahead = pd.Series(np.concatenate([values, np.full(half - 1, np.nan)]))
        return ahead.rolling(2 * half, min_periods=at_least).median().to_numpy()[half - 1:]

    return Ordered(clipped, keys, [by, rid]).sliding(half, half, name, "clipped", medians).result()


def leg_direction(df: DataFrame, lat="GPS_LAT", keys=("vessel_id",), order=("rid",)) -> DataFrame:
    """'northing' while latitude does not fall; the first row counts as northing."""
    out = lagged(df, keys, order, {"_lat": F.col(lat)})
    d = F.coalesce(F.col(lat) - F.col("_lat"), F.lit(0.0))
    return out.withColumn("leg", F.when(d >= 0, "northing").otherwise("southing")).drop("_lat")
