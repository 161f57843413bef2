"""A4/A5, R-D, R-I, R-P, R-M, I12: bar resampling and chart data.

Every fold is a hash aggregate on (symbol, bucket): partial aggregation runs
map-side, so a symbol holding a third of all bars is reduced in every map
task before the shuffle, and nothing is sorted.  Open/close are
``min_by``/``max_by`` on one number: the time, and below it a hash of the bar,
which orders bars of equal time (a struct as order would make it a sort
aggregate).  Volume is summed with an empty sum of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import date_bucket
from ..functions.periods import period_to_days
from ..session import once, scratch_table
from . import indicators as I
from .series import Framed


#: Bits of a day number, and of microseconds inside a bucket, in the order of a fold.
DAY_BITS, MICRO_BITS = 24, 40

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def time_order(time: Column, bits: int, *rest: str) -> Column:
    """One long that orders by ``time`` (a whole number of ``bits`` bits), then by a hash of the columns ``rest``."""
    low = 63 - bits
    return F.shiftleft(time.cast("long"), low).bitwiseOR(F.xxhash64(*rest).bitwiseAND(F.lit((1 << low) - 1)))


def micros_in(window: Column, time: Column) -> Column:
    """Microseconds from the window's start."""
    return F.unix_micros(time.cast("timestamp")) - F.unix_micros(window["start"].cast("timestamp"))


def fits_micros(timeframe: str) -> bool:
    """Whether a bucket's microseconds fit ``MICRO_BITS`` bits (12 days; written as ``15 minutes``)."""
    parts = timeframe.lower().split()
    known = len(parts) == 2 and parts[0].isdigit() and parts[1].rstrip("s") in _UNIT_SECONDS
    return known and int(parts[0]) * _UNIT_SECONDS[parts[1].rstrip("s")] * 1_000_000 < 1 << MICRO_BITS


def _fold(df: DataFrame, keys, order: Column, skip_null_open: bool = False) -> DataFrame:
    first = F.when(F.col("open").isNotNull(), order) if skip_null_open else order
    last = F.when(F.col("close").isNotNull(), order) if skip_null_open else order
    return df.groupBy(*keys).agg(
        F.min_by("open", first).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", last).alias("close"), F.coalesce(F.sum("volume"), F.lit(0)).cast("bigint").alias("volume"))


_BAR = ("high", "low", "open", "close", "volume")


def resample_daily(bars: DataFrame, every: str = "1d") -> DataFrame:
    """R-D: calendar resample of daily bars; output labelled by the bucket's first day."""
    if not every:
        return bars
    keyed = bars.withColumn("_bucket", date_bucket(F.col("date"), every))
    out = _fold(keyed, ["symbol", "_bucket"], time_order(F.unix_date("date"), DAY_BITS, *_BAR))
    return out.withColumnRenamed("_bucket", "date").select(
        "symbol", "date", "open", "high", "low", "close", "volume")


def resample_intraday(bars: DataFrame, timeframe: str = "15 minutes", time_col: str = "ts") -> DataFrame:
    """R-I: epoch-aligned buckets of ``timeframe`` per symbol; NULL prices are skipped."""
    keyed = bars.withColumn("_win", F.window(F.col(time_col), timeframe))
    keyed = keyed.withColumn("_w", F.col("_win.start"))
    # longer buckets do not leave room for the hash: ordered by a struct
    order = (time_order(micros_in(F.col("_win"), F.col(time_col)), MICRO_BITS, *_BAR) if fits_micros(timeframe)
             else F.struct(time_col, *_BAR))
    out = _fold(keyed, ["symbol", "_w"], order, skip_null_open=True)
    return out.withColumnRenamed("_w", time_col).select(
        "symbol", time_col, "open", "high", "low", "close", "volume")


def ticks_to_bars(ticks: DataFrame, timeframe: str = "15 minutes") -> DataFrame:
    """Ticks (symbol, ts, price, size) -> intraday OHLCV bars."""
    t = ticks.select("symbol", "ts", F.col("price").alias("open"), F.col("price").alias("high"),
                     F.col("price").alias("low"), F.col("price").alias("close"),
                     F.col("size").alias("volume"))
    return resample_intraday(t, timeframe)


def symbol_max_dates(bars: DataFrame, key: str = "symbol", order: str = "date") -> DataFrame:
    """Per-symbol last date as a small written table (size-checked broadcast, shuffle beyond)."""
    return scratch_table(bars.groupBy(key).agg(F.max(order).alias("_max_date")), "symbol-max-date")


def period_filter(bars: DataFrame, period: str | None) -> DataFrame:
    """R-P: keep bars with date >= (symbol's last date - period), inclusive; None keeps all."""
    if not period:
        return bars
    days = period_to_days(period)
    bars = once(bars, "period-input")
    mx = symbol_max_dates(bars)
    first = mx.agg(F.min("_max_date")).first()[0]
    if first is not None:  # no symbol keeps an older bar: a literal bound that reaches the scan
        bars = bars.where(F.col("date") >= F.date_sub(F.lit(first), days))
    return (bars.join(mx, "symbol")
                .where(F.col("date") >= F.date_sub(F.col("_max_date"), days))
                .drop("_max_date"))


def chart_bars(bars: DataFrame, *, resample: str = "1d", period: str | None = None,
               sort: bool = False) -> DataFrame:
    """R-M + P3 (+O3): period filter, then resample, then ``date`` -> ``time`` as a timestamp.

    ``sort=True`` orders by (symbol, time) with a range-partitioned global sort."""
    out = resample_daily(period_filter(bars, period), resample)
    out = out.select("symbol", F.col("date").cast("timestamp_ntz").alias("time"),
                     "open", "high", "low", "close", "volume")
    return out.orderBy("symbol", "time") if sort else out


def overlay_sma(bars: DataFrame, *, resample: str = "1d", period: str | None = None,
                lengths=(50, 200)) -> DataFrame:
    """SMA overlays on the prepared chart bars, long format (symbol, time, series, value).

    A series is emitted for a symbol only if it has more bars than the SMA
    length; warm-up rows (NULL) are dropped."""
    prepared = resample_daily(period_filter(bars, period), resample)
    fr = I.frame_with(prepared, [I.sma(n) for n in lengths])
    # all lengths from one pass, exploded
    shown = F.array_compact(F.array(*[F.when(
        F.col(f"sma_{n}").isNotNull() & (F.col("_total") > n),
        F.struct(F.lit(f"sma_{n}").alias("series"), F.col(f"sma_{n}").alias("value"))) for n in lengths]))
    df = fr.finish(fr.df.withColumn("_shown", shown).where(F.size("_shown") > 0))
    return df.select("symbol", F.col("date").cast("timestamp_ntz").alias("time"), F.inline("_shown"))


__all__ = ["resample_daily", "resample_intraday", "ticks_to_bars", "period_filter", "chart_bars",
           "overlay_sma", "symbol_max_dates", "Framed"]
