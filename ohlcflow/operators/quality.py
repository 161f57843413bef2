"""Q1-Q3: data-quality checks on a bar table.

* stale symbols: last bar older than ``k`` days before the table's last date
  (the table maximum is a scalar subquery, not a join);
* duplicate bars: more than one row per (symbol, date) — a hash aggregate
  with map-side partial counts;
* missing bars: market dates (dates on which any symbol traded) inside a
  symbol's first..last span on which the symbol has no bar.  Market dates
  are numbered; a bar whose number is not the previous bar's plus one closes
  a gap, and only gaps are expanded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_table
from .series import frame, lag


def stale_symbols(bars: DataFrame, max_age_days: int = 7) -> DataFrame:
    """(symbol, last_date, days_behind) for symbols more than ``max_age_days`` behind."""
    table_max = bars.select(F.max("date")).scalar()
    last = bars.groupBy("symbol").agg(F.max("date").alias("last_date"))
    return (last.withColumn("days_behind", F.datediff(table_max, F.col("last_date")))
                .where(F.col("days_behind") > max_age_days))


def duplicate_bars(bars: DataFrame, keys=("symbol", "date")) -> DataFrame:
    """(symbol, date, n) for keys that occur more than once."""
    return (bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
                .where(F.col("n") > 1))


def missing_bars(bars: DataFrame) -> DataFrame:
    """(symbol, date) market dates missing from a symbol inside its own span."""
    # the market's calendar: one row per date that was traded, numbered in order
    market = scratch_table(bars.select("date").distinct().withColumn(
        "_k", F.row_number().over(Window.orderBy("date")).cast("long")), "market-dates")
    fr = frame(bars.select("symbol", "date").distinct().join(market, "date"), 1)
    gaps = fr.finish(fr.df.withColumn("_before", lag(fr, "_k", 1)).where(F.col("_k") > F.col("_before") + 1))
    missing = gaps.select("symbol", F.explode(F.sequence(F.col("_before") + 1, F.col("_k") - 1)).alias("_k"))
    return missing.join(market, "_k").select("symbol", "date")
