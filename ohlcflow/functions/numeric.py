"""Numeric helpers shared by the library and the registered queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(c: Column, digits: int) -> Column:
    """Round half away from zero on the scaled binary value: round(x * 10^d) / 10^d.

    Scaling first rounds the value the machine holds (1234.565 is stored as
    1234.5649999...) instead of its shortest decimal text, the way printf-style
    formatting does, and matches the SQL ``round(x * 10^d) / 10^d`` used by
    the oracle exactly (both add 0.0 so -0.0 prints as 0.0)."""
    scale = float(10 ** digits)
    # + 0.0 turns a negative zero into 0.0
    return F.round(c * F.lit(scale)) / F.lit(scale) + F.lit(0.0)
