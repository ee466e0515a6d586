"""Column expressions shared by the operators. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds(start, end) -> Column:
    """Elapsed seconds with microsecond resolution; safe for TIMESTAMP_NTZ."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end)) / F.lit(1e6)


def half_even(c, digits: int = 0) -> Column:
    return F.bround(col(c), digits)


def share(part, whole, digits: int) -> Column:
    """part / whole as a rounded percentage, NULL for an empty whole."""
    return half_even(col(part) / F.nullif(col(whole), F.lit(0)) * 100, digits)


def count_where(cond) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def nan_to_null(c) -> Column:
    return F.nanvl(col(c), F.lit(None).cast("double"))


def to_numeric(c) -> Column:
    """Lenient numeric cast: text that is not a number, and NaN, become NULL."""
    return nan_to_null(col(c).try_cast("double"))


def blank_to_null(c) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def wrap_angle(c) -> Column:
    return F.pmod(col(c), F.lit(360.0))


def utc_wall_clock(instant: Column) -> Column:
    """Zone-free UTC time of an instant."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def parse_timestamp(c) -> Column:
    """Year-first text is read as ISO, everything else day-first; unreadable text becomes NULL.

    Day-first text is reordered and then cast like ISO text, so no session time zone is involved;
    text with an offset is taken to UTC.
    """
    text = F.trim(col(c))
    iso = F.when(text.rlike(r"^\d{4}[-/T]"), F.regexp_replace(text, r"^(\d{4})/(\d{1,2})/", "$1-$2-")).otherwise(
        F.regexp_replace(text, r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", "$3-$2-$1"))
    with_offset = iso.rlike(r"\d:\d.*(Z|[+-]\d{2}:?\d{2})$")
    return F.when(with_offset, utc_wall_clock(iso.try_cast("timestamp"))).otherwise(iso.try_cast("timestamp_ntz"))


def strict_timestamp(c, fmt: str) -> Column:
    return F.try_to_timestamp(F.trim(col(c)), F.lit(fmt)).cast("timestamp_ntz")


def day_key(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def month_key(c) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def iso_week_key(c) -> Column:
    """%G-W%V label: ISO year and ISO week number."""
    return F.concat(F.date_part(F.lit("YEAROFWEEK"), col(c)).cast("string"), F.lit("-W"),
                    F.lpad(F.date_part(F.lit("WEEK"), col(c)).cast("string"), 2, "0"))


def week_span_key(c) -> Column:
    """Monday/Sunday span label of the week the timestamp falls in."""
    monday = F.date_trunc("week", col(c))
    return F.concat(F.date_format(monday, "yyyy-MM-dd"), F.lit("/"),
                    F.date_format(monday + F.expr("INTERVAL 6 DAYS"), "yyyy-MM-dd"))


def unit_in_name(c) -> Column:
    """Unit written in a raw column name: `[unit]` anywhere, else a trailing `(unit)`."""
    bracket = F.regexp_extract(col(c), r"\[([^\]]+)\]", 1)
    paren = F.regexp_extract(col(c), r"\(([^)]*)\)\s*$", 1)
    unit = F.replace(F.trim(F.when(bracket != "", bracket).otherwise(paren)), F.lit("Â°"), F.lit("°"))
    return F.when(unit.rlike(r"^\d+$") | (F.length(unit) > 20), "").otherwise(unit)


def scaled(c, lo, hi) -> Column:
    """Min-max scaling that maps a constant column to 0 and never clips."""
    return (col(c) - col(lo)) / F.coalesce(F.nullif(col(hi) - col(lo), F.lit(0.0)), F.lit(1.0))


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "left") -> DataFrame:
    """Join that also matches NULL keys, keeping the left copy of each key."""
    keys = list(keys)
    if not keys:
        return left.crossJoin(right)
    marked = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = all_of([F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(marked, on, how).drop(*[f"_r_{k}" for k in keys])


def unpivot(df: DataFrame, ids, cols, name: str = "signal", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), [F.col(c).cast("double").alias(c) for c in cols], name, value)
