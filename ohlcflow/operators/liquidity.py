"""A2/A3: trailing dollar volume and the liquidity flag.

Dollar volume of a symbol = sum(close * volume) in double over bars dated on or after
(its own last date - 60 calendar days).  A symbol with nothing in range has 0.0.

Two aggregates, no join of bars: the per-symbol last date is a small written table, whose
smallest last date bounds the days that can count, as a literal that reaches the scan.
Bars since then are summed per (symbol, date), partially before the shuffle, so what
meets the last dates is one row per symbol and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import once
from .resample import symbol_max_dates

# Fixed values of the screener's bulk sync.
LOOKBACK_DAYS = 60
VOLUME_THRESHOLD = 150_000_000.0


def dollar_volume(bars: DataFrame, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """(symbol, dollar_volume); NULL products count as 0, a NaN close gives NaN."""
    bars = once(bars, "dollar-volume-input")
    last = symbol_max_dates(bars)
    first = last.agg(F.min("_max_date")).first()[0]
    if first is not None:
        bars = bars.where(F.col("date") >= F.date_sub(F.lit(first), lookback_days))
    days = bars.groupBy("symbol", "date").agg(F.sum(F.col("close") * F.col("volume").cast("double")).alias("_value"))
    in_range = F.col("date") >= F.date_sub(F.col("_max_date"), lookback_days)
    sums = days.join(last, "symbol").where(in_range).groupBy("symbol").agg(F.sum("_value").alias("_total"))
    return last.select("symbol").join(sums, "symbol", "left").select(
        "symbol", F.coalesce("_total", F.lit(0.0)).alias("dollar_volume"))


def liquidity(bars: DataFrame, threshold: float = VOLUME_THRESHOLD, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """A3: (symbol, dollar_volume, eligible)."""
    dv = dollar_volume(bars, lookback_days)
    return dv.withColumn("eligible", F.col("dollar_volume") >= F.lit(float(threshold)))


def eligible_count(bars: DataFrame, threshold: float = VOLUME_THRESHOLD,
                   lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """A3: one row (n_symbols, n_eligible)."""
    lq = liquidity(bars, threshold, lookback_days)
    return lq.agg(F.count(F.lit(1)).alias("n_symbols"),
                  F.count_if(F.col("eligible")).alias("n_eligible"))
