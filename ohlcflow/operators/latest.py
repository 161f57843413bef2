"""A1: latest bar of every symbol (optionally as of a date).

Two steps, both hash aggregates or joins on small sides: ``max(date)`` per symbol is a
fixed-width aggregate (one row per symbol and map task is shuffled, nothing is sorted)
and is written as a small table; its smallest date is a literal bound that the scan of
the second step gets pushed.  Bars on a symbol's last date are then found by an
equi-join, and only these - duplicates of one day - meet a row-ordering aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import once, scratch_table


def latest_bars(bars: DataFrame, as_of=None, key: str = "symbol", order: str = "date") -> DataFrame:
    """The latest bar per ``key``; of several on one date the greatest by all other columns."""
    if as_of is not None:
        bars = bars.where(F.col(order) <= F.lit(as_of))
    bars = once(bars, "latest-input")
    last = scratch_table(bars.groupBy(key).agg(F.max(order).alias("_last")), "latest-dates")
    first = last.agg(F.min("_last")).first()[0]
    if first is not None:
        bars = bars.where(F.col(order) >= F.lit(first))
    own = last.withColumnRenamed(key, "_key")
    rows = bars.join(own, (F.col(key) == F.col("_key")) & (F.col(order) == F.col("_last"))).select(*bars.columns)
    cols = [c for c in bars.columns if c != key]
    return (rows.groupBy(key).agg(F.max(F.struct(order, *[c for c in cols if c != order])).alias("_r"))
                .select(key, *[F.col(f"_r.{c}").alias(c) for c in cols]))
