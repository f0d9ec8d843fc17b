"""Clock and calendar expressions on zone-less timestamps (session zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKET_ZONE = "Australia/Brisbane"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def micros(ts: str | Column) -> Column:
    return F.unix_micros(_c(ts).cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def bucket_to(ts: str | Column, minutes: int, side: str = "end") -> Column:
    """Label a timestamp with its bucket.

    ``side='end'`` labels an interval *end* with the end of the bucket holding it
    (12:05 ... 12:30 -> 12:30); ``side='start'`` floors (12:00 ... 12:29 -> 12:00).
    """
    width = minutes * 60 * 1_000_000
    us = micros(ts)
    # floor, also before 1970: pmod is never negative
    down = us - F.pmod(us, F.lit(width))
    if side == "start":
        return from_micros(down)
    if side == "end":
        return from_micros(us + F.pmod(-us, F.lit(width)))
    raise ValueError(f"side must be 'start' or 'end', not {side!r}")


def to_local(ts: str | Column, zone: str | Column, source_zone: str = MARKET_ZONE) -> Column:
    """Wall time in ``zone`` (a column or a name) of a wall time in ``source_zone``."""
    target = F.lit(zone) if isinstance(zone, str) else zone
    return F.convert_timezone(F.lit(source_zone), target, _c(ts))


def minus_minutes(ts: str | Column, n: int) -> Column:
    return _c(ts) - F.expr(f"INTERVAL '{n}' MINUTE")


def plus_minutes(ts: str | Column, n: int) -> Column:
    return _c(ts) + F.expr(f"INTERVAL '{n}' MINUTE")


def hour_number(ts: str | Column) -> Column:
    """Time of day as one number: 13:30 -> 13.5."""
    ts = _c(ts)
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def is_midday(start: str | Column, end: str | Column) -> Column:
    """True for intervals inside 12:00-15:00 whose end hour is before 15."""
    start, end = _c(start), _c(end)
    return F.hour(start).between(12, 14) & F.hour(end).between(12, 14)


def is_weekend(day_of_week: str | Column) -> Column:
    return _c(day_of_week).isin(1, 7)


def day_of_week(d: str | Column) -> Column:
    """Sunday = 1 ... Saturday = 7."""
    return F.dayofweek(_c(d))
