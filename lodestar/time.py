"""Time arithmetic. A day difference is floored elapsed time, never a calendar difference."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000
#: Microseconds of a window unit.
UNITS = {"h": 3_600_000_000, "d": DAY_MICROS, "w": 7 * DAY_MICROS}


def as_time(value: Column | str | datetime) -> Column:
    """A timestamp column from a column, or from a literal time."""
    return value.cast("timestamp") if isinstance(value, Column) else F.lit(value).cast("timestamp")


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days from earlier to later, towards minus infinity."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(DAY_MICROS)).cast("bigint")


def exact_days(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(DAY_MICROS))


def window_micros(window: str) -> int | None:
    """`7d`, `24h`, `2w`, or `all_time` (None)."""
    if window == "all_time":
        return None
    if not (m := re.fullmatch(r"(\d+)([hdw])", window)):
        raise ValueError(f"window {window!r} is none of Nh, Nd, Nw and all_time")
    return int(m[1]) * UNITS[m[2]]


def inside(time: Column, reference: Column, window: str, upper_bound: bool = True) -> Column:
    """reference - window <= time, and time <= reference unless upper_bound is False."""
    micros = window_micros(window)
    after = F.lit(True) if micros is None else F.unix_micros(time) >= F.unix_micros(reference) - F.lit(micros)
    return after & (time <= reference) if upper_bound else after
