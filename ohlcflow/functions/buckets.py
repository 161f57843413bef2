"""Calendar bucket keys for resampling (left-closed, labelled at the left edge)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# 1970-01-05 is a Monday: weekly buckets are Monday-aligned from there.
MONDAY_EPOCH_OFFSET_DAYS = 4

_EVERY = re.compile(r"^(\d+)(d|w|mo|q|y)$")


def parse_every(every: str) -> tuple[int, str]:
    m = _EVERY.match(every.strip())
    if not m:
        raise ValueError(f"unsupported resample interval: {every!r} (use Nd, Nw, Nmo, Nq, Ny)")
    return int(m.group(1)), m.group(2)


def date_bucket(date: Column, every: str) -> Column:
    """Start date of the ``every`` bucket holding ``date``."""
    n, unit = parse_every(every)
    if unit == "d":
        if n == 1:
            return date
        return F.date_from_unix_date(F.floor(F.unix_date(date) / n) * n)
    if unit == "w":
        if n == 1:
            return F.trunc(date, "week")
        off = MONDAY_EPOCH_OFFSET_DAYS
        span = 7 * n
        return F.date_from_unix_date(F.floor((F.unix_date(date) - off) / span) * span + off)
    months = n * {"mo": 1, "q": 3, "y": 12}[unit]
    if months == 1:
        return F.trunc(date, "month")
    if months == 12:
        return F.trunc(date, "year")
    idx = F.year(date) * 12 + F.month(date) - 1
    b = F.floor(idx / months) * months
    return F.make_date(F.floor(b / 12).cast("int"), (b % 12 + 1).cast("int"), F.lit(1))
