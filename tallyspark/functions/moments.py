"""Times. `now` is always an argument, never the clock; the session's time zone is UTC."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR, DAY, WEEK = 3600, 86_400, 604_800


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def moment(at: datetime) -> Column:
    """A literal that compares with a timestamp column without a cast, so that filters reach the scan."""
    return F.expr(f"TIMESTAMP_NTZ '{at.isoformat(sep=' ')}'")


def micros(ts: str | Column) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def seconds(start: str | Column, end: str | Column) -> Column:
    """Seconds from `start` to `end`, as a double."""
    return (micros(end) - micros(start)) / F.lit(1e6)


def shifted(ts: str | Column, by: Column | float) -> Column:
    """`ts` moved by seconds."""
    by = by if isinstance(by, Column) else F.lit(float(by))
    return col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), by.cast("decimal(18,6)"))


def cell(ts: str | Column, length: int) -> Column:
    """Number of the cell of `length` seconds since the epoch that holds `ts`."""
    return F.floor(micros(ts) / F.lit(length * 1_000_000)).cast("long")


def cell_start(number: str | Column, length: int) -> Column:
    return F.timestamp_micros(col(number) * F.lit(length * 1_000_000)).cast("timestamp_ntz")


def day(ts: str | Column) -> Column:
    return F.to_date(col(ts))


def repaired_day(saved: str | Column) -> Column:
    """The day of a saved day start after the zone moved: that of its midpoint."""
    return F.to_date(shifted(saved, 12 * HOUR))


def last_days(d: str | Column, now: datetime, n: int) -> Column:
    """Whether day `d` is one of the `n` calendar days that end with that of `now`."""
    today = F.lit(now.date())
    return (col(d) > F.date_sub(today, n)) & (col(d) <= today)
