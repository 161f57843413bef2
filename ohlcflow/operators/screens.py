"""T2 screens written down in the screener's methodology notes (not built there).

Each screen is an indicator set plus a condition, evaluated either on the
latest bar (``scan``) or on every bar (``history=True``).  Choices the notes
leave open are marked *(ours)*.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.predicates import Predicate, trend_template
from . import indicators as I
from .series import Framed, lag, roll, rolling


def prior_high(n: int) -> I.Indicator:
    """Highest high of the ``n`` rows before the current one *(current excluded: ours)*."""
    name = f"prior_high_{n}"
    return I.Indicator(name, n, lambda fr, df: rolling(fr, df, "max", "high", n, name, skip=1),
                       latest=lambda back: {name: I.last_rows(back - 1, n, "high", F.max)})


def range_min(n: int = 7) -> I.Indicator:
    name = f"range_min_{n}"
    return I.Indicator(name, n - 1,
                       lambda fr, df: df.withColumn(name, roll(fr, F.min, F.col("high") - F.col("low"), n)),
                       latest=lambda back: {name: I.last_rows(back, n, F.col("high") - F.col("low"), F.min)})


def prev_bar() -> I.Indicator:
    def apply(fr: Framed, df: DataFrame) -> DataFrame:
        return (df.withColumn("prev_high", lag(fr, "high", 1))
                  .withColumn("prev_low", lag(fr, "low", 1))
                  .withColumn("volume_lag1", lag(fr, "volume", 1))
                  .withColumn("volume_lag2", lag(fr, "volume", 2)))
    return I.Indicator("prev_bar", 2, apply, ("prev_high", "prev_low", "volume_lag1", "volume_lag2"),
                       lambda back: {"prev_high": I.row_at(back, 1, "high"), "prev_low": I.row_at(back, 1, "low"),
                                     "volume_lag1": I.row_at(back, 1, "volume"),
                                     "volume_lag2": I.row_at(back, 2, "volume")})


def breakout(n: int = 20) -> Predicate:
    """P-BO: close above the highest high of the previous ``n`` rows."""
    return Predicate(f"breakout_{n}", (prior_high(n),), lambda: F.col("close") > F.col(f"prior_high_{n}"))


def inside_day() -> Predicate:
    """P-ID: high below and low above the previous bar's."""
    return Predicate("inside_day", (prev_bar(),),
                     lambda: (F.col("high") < F.col("prev_high")) & (F.col("low") > F.col("prev_low")))


def nr7() -> Predicate:
    """P-NR: today's range is the smallest of the last 7 rows (today included)."""
    return Predicate("nr7", (range_min(7),), lambda: (F.col("high") - F.col("low")) == F.col("range_min_7"))


def volatility_squeeze() -> Predicate:
    """P-VS: (NR7 or inside day) and adr_20 > 3 and volume falling two bars in a row."""
    cond = lambda: (((F.col("high") - F.col("low")) == F.col("range_min_7"))
                    | ((F.col("high") < F.col("prev_high")) & (F.col("low") > F.col("prev_low")))) \
        & (F.col("adr_20") > 3) & (F.col("volume") < F.col("volume_lag1")) \
        & (F.col("volume_lag1") < F.col("volume_lag2"))
    return Predicate("vol_squeeze", (range_min(7), prev_bar(), I.adr(20)), cond)


def rsi_oversold() -> Predicate:
    """P-RO: close above sma_200 and (rsi_14 < 30 or rsi_2 < 10)."""
    return Predicate("rsi_oversold", (I.sma(200), I.rsi(14), I.rsi(2)),
                     lambda: (F.col("close") > F.col("sma_200"))
                     & ((F.col("rsi_14") < 30) | (F.col("rsi_2") < 10)))


def bollinger_snapback() -> Predicate:
    """P-BB: close below sma_20 - 2 * population stddev_20, and rsi_14 < 30."""
    return Predicate("bollinger_snapback", (I.sma(20), I.rolling_stddev(20), I.rsi(14)),
                     lambda: (F.col("close") < F.col("sma_20") - 2 * F.col("std_20")) & (F.col("rsi_14") < 30))


def consolidation_breakout() -> Predicate:
    """P-CB: trend template, close >= 0.95 * high of 20 rows, atr_5 < atr_20, volume < 50-row average."""
    tt = trend_template()
    inds = tt.indicators + (I.rolling_max(20, "high", "high_20"), I.atr(5), I.atr(20),
                            I.sma(50, col="volume", name="avg_volume_50"))
    return Predicate("consolidation_breakout", inds,
                     lambda: tt.condition & (F.col("close") >= 0.95 * F.col("high_20"))
                     & (F.col("atr_5") < F.col("atr_20")) & (F.col("volume") < F.col("avg_volume_50")))


def distance_from_sma(bars: DataFrame, lengths=(20, 50)) -> DataFrame:
    """P-DS: (close - sma_n) / sma_n * 100 per bar."""
    df = I.add_indicators(bars, [I.sma(n) for n in lengths])
    for n in lengths:
        df = df.withColumn(f"dist_sma_{n}", F.try_divide(F.col("close") - F.col(f"sma_{n}"), F.col(f"sma_{n}")) * 100.0)
    return df
