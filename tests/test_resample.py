import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import make_bars, series
from ohlcflow.functions.periods import period_to_days
from ohlcflow.operators import resample as R

D = dt.date.fromisoformat


@pytest.mark.parametrize("s,days", [("1y", 365), ("6mo", 180), ("2w", 14), ("10d", 10), ("15min", 450),
                                    ("1Y", 365), ("junk", 365), ("3x", 365)])
def test_period_parser(s, days):
    assert period_to_days(s) == days


def test_period_parser_column_matches(spark):
    from ohlcflow.functions.periods import period_days_col
    cases = ["1y", "6mo", "2w", "10d", "15min", "1Y", "junk", "3x"]
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    got = {r.p: r.d for r in df.select("p", period_days_col(F.col("p")).alias("d")).collect()}
    assert got == {c: period_to_days(c) for c in cases}


def test_week_and_month_buckets(spark):
    # 2024-01-05 is a Friday, 2024-01-08 a Monday; 2024-01-31 / 2024-02-01 cross a month
    rows = [("A", D("2024-01-05"), 1.0, 2.0, 0.5, 1.5, 10), ("A", D("2024-01-08"), 2.0, 3.0, 1.5, 2.5, 20),
            ("A", D("2024-01-31"), 3.0, 4.0, 2.5, 3.5, 30), ("A", D("2024-02-01"), 4.0, 5.0, 3.5, 4.5, 40)]
    bars = make_bars(spark, rows)
    wk = {r.date: r for r in R.resample_daily(bars, "1w").collect()}
    assert sorted(wk) == [D("2024-01-01"), D("2024-01-08"), D("2024-01-29")]
    jan29 = wk[D("2024-01-29")]
    assert (jan29.open, jan29.high, jan29.low, jan29.close, jan29.volume) == (3.0, 5.0, 2.5, 4.5, 70)
    mo = {r.date: r for r in R.resample_daily(bars, "1mo").collect()}
    assert sorted(mo) == [D("2024-01-01"), D("2024-02-01")]
    assert mo[D("2024-01-01")].volume == 60 and mo[D("2024-01-01")].close == 3.5
    two = {r.date for r in R.resample_daily(bars, "2w").collect()}
    assert all(d.weekday() == 0 for d in two)


def test_resample_preserves_volume_and_is_idempotent(small_bars):
    total = small_bars.agg(F.sum("volume")).first()[0]
    for every in ("1d", "1w", "2w", "1mo", "3mo", "1y"):
        assert R.resample_daily(small_bars, every).agg(F.sum("volume")).first()[0] == total
    once = R.resample_daily(small_bars, "1d")
    assert once.exceptAll(small_bars).count() == 0 and small_bars.exceptAll(once).count() == 0


def test_period_filter_is_per_symbol_and_inclusive(spark):
    rows = series("A", "2024-01-01", [1.0] * 40) + series("B", "2024-02-01", [1.0] * 5)
    out = R.period_filter(make_bars(spark, rows), "10d")
    got = {r.symbol: (r.n, r.first) for r in out.groupBy("symbol").agg(F.count("*").alias("n"),
                                                                       F.min("date").alias("first")).collect()}
    assert got["A"] == (11, D("2024-01-30")) and got["B"] == (5, D("2024-02-01"))


def test_overlay_only_with_enough_bars(spark):
    rows = series("A", "2024-01-01", [float(i) for i in range(60)]) + series("B", "2024-01-01", [1.0] * 50)
    out = R.overlay_sma(make_bars(spark, rows), lengths=(50, 200))
    got = out.groupBy("symbol", "series").count().collect()
    assert {(r.symbol, r.series, r["count"]) for r in got} == {("A", "sma_50", 11)}


def test_intraday_buckets_epoch_aligned(spark):
    from ohlcflow.schema import TICK_SCHEMA
    T = dt.datetime
    ticks = spark.createDataFrame([("X", T(2024, 1, 1, 9, 14, 59), 1.0, 1), ("X", T(2024, 1, 1, 9, 15), 2.0, 1),
                                   ("X", T(2024, 1, 1, 9, 29), 3.0, 2), ("X", T(2024, 1, 1, 9, 1), None, 1)],
                                  TICK_SCHEMA)
    out = {r.ts: r for r in R.ticks_to_bars(ticks, "15 minutes").collect()}
    assert sorted(out) == [T(2024, 1, 1, 9, 0), T(2024, 1, 1, 9, 15)]
    first = out[T(2024, 1, 1, 9, 0)]
    assert (first.open, first.close, first.volume) == (1.0, 1.0, 2)   # NULL price skipped for open
    second = out[T(2024, 1, 1, 9, 15)]
    assert (second.open, second.high, second.low, second.close, second.volume) == (2.0, 3.0, 2.0, 3.0, 3)
