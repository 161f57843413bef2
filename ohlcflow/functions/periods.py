"""Lookback period strings such as ``1y``, ``6mo``, ``2w``, ``10d``.

Rule (fixed values that must match the screener): the leading ``<digits><letters>``
is read; a unit starting with ``y`` is 365 days, with ``m`` 30 days (so
``15min`` is 15 * 30 days), with ``w`` 7 days, with ``d`` 1 day; any other
unit, or no match at all (``1Y``, ``junk``), falls back to 365 days.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days per unit initial, and the fallback.
UNIT_DAYS = {"y": 365, "m": 30, "w": 7, "d": 1}
FALLBACK_DAYS = 365
_PATTERN = r"^(\d+)([a-z]+)"


def period_to_days(period: str) -> int:
    m = re.match(_PATTERN, period)
    if not m:
        return FALLBACK_DAYS
    n, unit = int(m.group(1)), m.group(2)
    for initial, days in UNIT_DAYS.items():
        if unit.startswith(initial):
            return n * days
    return FALLBACK_DAYS


def period_days_col(period: Column) -> Column:
    """The same rule as a Column (periods stored in a table)."""
    n = F.regexp_extract(period, _PATTERN, 1)
    unit = F.regexp_extract(period, _PATTERN, 2)
    num = F.when(n != "", n.cast("long"))
    expr = F.lit(FALLBACK_DAYS).cast("long")
    for initial, days in reversed(list(UNIT_DAYS.items())):
        expr = F.when(num.isNotNull() & unit.startswith(initial), num * days).otherwise(expr)
    return expr
