"""Hand-computed cases for the data-quality checks, T2 screens and performance measures."""

import datetime as dt
import math

from conftest import make_bars
from ohlcflow.operators import quality as Q
from ohlcflow.operators import screens as SC
from ohlcflow.operators import strategy as ST
from ohlcflow.plans.scan import scan

D = dt.date.fromisoformat


def _bar(sym, day, high, low, close=None, volume=100):
    c = float(close if close is not None else (high + low) / 2)
    return (sym, D(day), c, float(high), float(low), c, volume)


def test_quality_checks(spark):
    rows = [_bar("A", f"2024-01-0{d}", 10, 9) for d in range(1, 6)]
    rows.append(_bar("A", "2024-01-03", 10, 9))                      # duplicate bar
    rows += [_bar("B", "2024-01-01", 5, 4), _bar("B", "2024-01-03", 5, 4)]  # 01-02 missing
    rows.append(_bar("C", "2023-12-01", 3, 2))                       # 35 days behind
    bars = make_bars(spark, rows)
    stale = [(r.symbol, r.last_date, r.days_behind) for r in Q.stale_symbols(bars, 7).collect()]
    assert stale == [("C", D("2023-12-01"), 35)]
    dups = [(r.symbol, r.date, r.n) for r in Q.duplicate_bars(bars).collect()]
    assert dups == [("A", D("2024-01-03"), 2)]
    missing = sorted((r.symbol, r.date) for r in Q.missing_bars(bars).collect())
    assert missing == [("B", D("2024-01-02"))]


def test_inside_day_breakout_nr7(spark):
    # highs / lows chosen so that day 2 is an inside day, day 3 breaks out above
    # the two prior highs, and days 8 and 9 have the narrowest range of their last 7 rows
    hl = [(10, 5), (9, 6), (12, 8), (12, 9), (13, 9), (13, 10), (14, 10), (14, 11), (13.5, 12.5)]
    closes = [7, 7, 11.5, 10, 11, 12, 12, 13, 13]
    rows = [_bar("X", (D("2024-02-01") + dt.timedelta(days=i)).isoformat(), h, lo, c)
            for i, ((h, lo), c) in enumerate(zip(hl, closes))]
    bars = make_bars(spark, rows)
    inside = {r.date for r in scan(bars, [SC.inside_day()], history=True).collect()}
    assert D("2024-02-02") in inside and D("2024-02-03") not in inside
    brk = {r.date for r in scan(bars, [SC.breakout(2)], history=True).collect()}
    assert D("2024-02-03") in brk            # 11.5 > max(10, 9)
    assert D("2024-02-02") not in brk        # first two rows lack two prior highs or fail
    nr = {r.date for r in scan(bars, [SC.nr7()], history=True).collect()}
    # ranges 5 3 4 3 4 3 4 3 1: day 7 (4) is not the minimum of its 7 rows, day 8 (3)
    # ties the minimum, day 9 (1) is it; days 1-6 have fewer than 7 rows
    assert nr == {D("2024-02-08"), D("2024-02-09")}


def test_performance_measures(spark):
    trades = spark.createDataFrame(
        [("S", "AAA", D("2024-01-01"), D("2024-01-10"), 0.10),
         ("S", "BBB", D("2024-01-05"), D("2024-01-20"), -0.05)],
        "strategy string, symbol string, entry_date date, exit_date date, ret double")
    r = ST.performance(trades).collect()[0]
    assert r.n_trades == 2
    assert math.isclose(r.win_rate, 0.5)
    assert math.isclose(r.expectancy, 0.025)
    assert math.isclose(r.total_return, 1.1 * 0.95 - 1.0)
    assert math.isclose(r.max_drawdown, -0.05)
    years = 10 / 365.25
    assert math.isclose(r.cagr, (1.1 * 0.95) ** (1 / years) - 1.0, rel_tol=1e-9)
