"""The same analytics on unbounded input (an extension: the batch pipeline scores files only)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import utc_wall_clock
from ..operators.flags import constraint_flags


EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def event_time(stream: DataFrame, time: str) -> DataFrame:
    """Watermarks need an instant: a zone-free time is read as UTC, whatever the session's zone is."""
    if stream.schema[time].dataType.typeName() == "timestamp":
        return stream
    return stream.withColumn(time, F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, {EPOCH}, {time}))"))


def stream_score(stream: DataFrame, model) -> DataFrame:
    """Constraint flags and a saved detector on a stream; stateless, parameters joined by broadcast."""
    return model.transform(constraint_flags(stream))


def stream_rolling_rate(stream: DataFrame, keys=("vessel_id",), time="Date", late: str = "10 minutes", span: str = "1 hour",
                        slide: str = "5 minutes", flag="is_anomaly") -> DataFrame:
    """Sliding-window share of flagged rows; partial counts are combined before the state is touched."""
    w = F.window(time, span, slide)
    return (event_time(stream, time).withWatermark(time, late).groupBy(*keys, w.alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), (F.avg(F.col(flag).cast("double")) * 100).alias("rate_pct"))
            .select(*keys, utc_wall_clock(F.col("w.start")).alias("window_start"), utc_wall_clock(F.col("w.end")).alias("window_end"), "n", "rate_pct"))


ALERT = "active_from timestamp, gap_start timestamp, n_records bigint, status string, gap_end timestamp"
STATE = "starts array<bigint>, ends array<bigint>, counts array<bigint>, silent_since bigint"


def stream_gap_alert(stream: DataFrame, interval_s: int, keys=("vessel_id",), time="Date", late: str = "10 minutes") -> DataFrame:
    """Silences longer than ten intervals, by a timer per key: an alert while the key is still silent, also if it never reports again.

    Per key the state holds the spells of activity that the watermark has not passed. A timer runs to the moment the latest
    spell has been over for the limit; when the watermark reaches it, a row with status `silent` is sent (start and end of the
    spell, number of its records). When the key is known to report again, a row with status `resumed` and `gap_end` follows.
    Records that come late, but before the watermark passes them, join or connect spells. Rows without a time are left out.
    """
    keys, limit = list(keys), 10 * interval_s * 1_000_000
    rows = event_time(stream, time).where(F.col(time).isNotNull()).withWatermark(time, late).select(
        *keys, time, F.unix_micros(time).alias("_us"))
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)

    def spells(starts, ends, counts):
        joined = []
        for start, end, n in sorted(zip(starts, ends, counts)):
            if joined and start - joined[-1][1] <= limit:
                last = joined[-1]
                joined[-1] = (last[0], max(last[1], end), last[2] + n)
            else:
                joined.append((start, end, n))
        return joined

    def watch(key, batches, state):
        starts, ends, counts, silent = map(lambda v: list(v) if isinstance(v, (list, np.ndarray)) else v, state.get if state.exists else ([], [], [], None))
        for pdf in batches:
            at = np.sort(pdf["_us"].to_numpy(dtype=np.int64))
            cut = np.flatnonzero(np.diff(at) > limit) + 1
            for part in np.split(at, cut):
                if len(part):
                    starts, ends, counts = [*starts, int(part[0])], [*ends, int(part[-1])], [*counts, len(part)]
        held, out, passed = spells(starts, ends, counts), [], state.getCurrentWatermarkMs() * 1000
        while held:
            start, end, n = held[0]
            if silent is not None and start <= passed:
                out.append((None, silent, None, "resumed", start))
                silent = None
            if end + limit + 1 > passed:
                break
            out.append((start, end, n, "silent", None))
            silent, held = end, held[1:]
        if held or silent is not None:
            state.update(tuple([int(s[i]) for s in held] for i in range(3)) + (silent,))
            if held:
                due = held[0][1] + limit + 1 if silent is None else held[0][0]
                state.setTimeoutTimestamp(max(-(-due // 1000), passed // 1000 + 1))
        elif state.exists:
            state.remove()
        if out:
            frame = pd.DataFrame(out, columns=["active_from", "gap_start", "n_records", "status", "gap_end"])
            frame["n_records"] = frame["n_records"].astype("Int64")
            for c in ("active_from", "gap_start", "gap_end"):
                frame[c] = pd.to_datetime(frame[c], unit="us", utc=True)
            for i, k in enumerate(keys):
                frame.insert(i, k, [key[i]] * len(frame))
            yield frame

    found = rows.groupBy(*keys).applyInPandasWithState(watch, f"{key_ddl}, {ALERT}", STATE, "append", "EventTimeTimeout")
    return found.withColumns({c: utc_wall_clock(F.col(c)) for c in ("active_from", "gap_start", "gap_end")})


def run_available(stream: DataFrame, output: str, checkpoint: str, mode: str = "append") -> None:
    """Drain what is available into a Parquet folder (exactly once, through the checkpoint)."""
    query = (stream.writeStream.outputMode(mode).format("parquet").option("path", output)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
