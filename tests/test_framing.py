"""Strategy tables over several partitions per symbol, exponential averages on degenerate input, dollar volume."""

import math
import random

import pytest

from conftest import make_bars, series
from ohlcflow.operators import indicators as I
from ohlcflow.operators import liquidity, strategy
from ohlcflow.operators import series as framing
from ohlcflow.operators.series import frame, lag


def _walk(symbol, n, seed):
    rng = random.Random(seed)
    closes, x = [], 100.0
    for _ in range(n):
        x = max(5.0, x + rng.uniform(-2, 2.1))
        closes.append(round(x, 2))
    return series(symbol, "1990-01-01", closes, [rng.randrange(100, 1000) for _ in range(n)])


@pytest.fixture(scope="module")
def long_bars(spark):
    return make_bars(spark, _walk("AAA", 9000, 1) + _walk("BBB", 700, 2)).repartition(4).cache()


def _rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("table", [
    lambda b: strategy.forward_trades(b, (5, 40)),
    lambda b: strategy.param_sweep(b, (10, 50), 20, "2000-01-01"),
    lambda b: strategy.next_bar_signals(b).drop("rank"),
    lambda b: strategy.relative_strength(b, "BBB", 20).drop("rs_rank"),
    lambda b: strategy.regime(b, "AAA"),
], ids=["forward_trades", "param_sweep", "next_bar_signals", "relative_strength", "regime"])
def test_partitions_lose_nothing(long_bars, monkeypatch, table):
    """Small partitions (8 lookbacks, or less) give the rows of one partition per symbol."""
    monkeypatch.setattr(framing, "MIN_SPAN_ROWS", 1)
    got = _rows(table(long_bars).na.fill(-1))
    monkeypatch.setattr(framing, "MIN_SPAN_ROWS", 10 ** 9)
    assert got == _rows(table(long_bars).na.fill(-1)) and got


def test_newest_signal_is_there(spark):
    closes = [10.0] * 40 + [30.0]
    got = strategy.next_bar_signals(make_bars(spark, series("AAA", "2024-01-01", closes))).collect()
    assert [(r.entry_date, r.entry, r.rank) for r in got] == [(None, None, 1)]


def test_lag_beyond_the_frame_is_refused(long_bars):
    fr = frame(long_bars, 10)
    lag(fr, "close", 10)
    with pytest.raises(ValueError):
        lag(fr, "close", 11)
    with pytest.raises(ValueError):
        lag(fr, "close", 5, depth=6)


def _rsi(closes, period=14):
    g = lo = None
    out = []
    for i, c in enumerate(closes):
        d = c - closes[i - 1] if i else 0.0
        up, down = max(d, 0.0), max(-d, 0.0)
        # in logarithms a decay never reaches zero: the ratio is what counts
        g = up if g is None else g * (period - 1) / period + up / period
        lo = down if lo is None else lo * (period - 1) / period + down / period
        if i and d == 0 and out:
            out.append(out[-1])
        else:
            out.append(math.nan if g == lo == 0 else 100.0 if lo == 0 else 100 - 100 / (1 + g / lo))
    return out


@pytest.mark.parametrize("flat", [1500, 9000])
def test_rsi_of_a_series_that_stands_still(spark, flat):
    rng = random.Random(4)
    closes = [100 + rng.randrange(-20, 20) / 4 for _ in range(300)]
    closes += [closes[-1]] * flat
    tails = {"AAA": closes, "BBB": closes + [closes[-1] + 1.0, closes[-1] - 0.5], "CCC": [7.0] * flat}
    bars = make_bars(spark, [r for s, c in tails.items() for r in series(s, "1960-01-01", c)])
    got = {}
    for r in I.add_indicators(bars, [I.rsi(14)]).collect():
        got.setdefault(r.symbol, []).append((r.date, r.rsi_14))
    for s, c in tails.items():
        for (_, have), want in zip(sorted(got[s]), _rsi(c), strict=True):
            assert (math.isnan(have) and math.isnan(want)) or abs(have - want) < 1e-6, (s, have, want)
    for r in I.snapshot_with(bars, [I.rsi(14)]).collect():
        want = _rsi(tails[r.symbol])[-1]
        assert (math.isnan(r.rsi_14) and math.isnan(want)) or abs(r.rsi_14 - want) < 1e-6


def test_null_input_makes_ewm_null_until_it_weighs_nothing(spark):
    n = 2 * framing.ewm_block(2 / 6) + 5
    rows = [list(r) for r in series("AAA", "2024-01-01", [10.0] * n, spread=0.5)]
    rows[2][5] = None
    for k in (3, 4):
        rows[1][k] = None
    bars = make_bars(spark, [tuple(r) for r in rows])
    got = [r.ema_5 for r in I.add_indicators(bars, [I.ema(5)]).orderBy("date").collect()]
    assert None not in got[:2] and got[2] is None and got[3] is None
    assert all(x is None or abs(x - 10.0) < 1e-12 for x in got) and abs(got[-1] - 10.0) < 1e-12
    lead = make_bars(spark, [tuple(r[:5] + [None if i == 0 else 10.0] + r[6:]) for i, r in enumerate(
        map(list, series("AAA", "2024-01-01", [10.0] * 6)))])
    assert {r.ema_5 for r in I.add_indicators(lead, [I.ema(5)]).collect()} == {None}
    assert I.snapshot_with(lead, [I.ema(5)]).first().ema_5 is None


@pytest.mark.parametrize("close, volume, want", [
    (2.0, 2 ** 62, 2.0 ** 63), (1e12, 10 ** 9, 1e21), (3e-8, 10 ** 12, 30000.0), (5.0, 0, 0.0), (None, 7, 0.0)])
def test_dollar_volume_extremes(spark, close, volume, want):
    row = list(series("AAA", "2024-01-01", [1.0])[0])
    row[5], row[6] = close, volume
    r = liquidity.dollar_volume(make_bars(spark, [tuple(row)])).first()
    assert abs(r.dollar_volume - want) <= 1e-9 * want


def test_dollar_volume_of_nan_is_nan(spark):
    rows = series("AAA", "2024-01-01", [1.0, float("nan")])
    assert math.isnan(liquidity.dollar_volume(make_bars(spark, rows)).first().dollar_volume)


def test_frame_deals_its_rows_to_tasks_in_proportion(spark, monkeypatch):
    """Twice the rows give twice the tasks, whatever the number of shuffle partitions; the values stay."""
    from ohlcflow.operators import indicators, series as framing
    tasks = {}
    for n in (40, 80):
        rows = [r for k in range(n) for r in series(f"S{k}", "2024-01-01", [float(i % 7 + k) for i in range(100)])]
        bars = make_bars(spark, rows)
        monkeypatch.setattr(framing, "ROWS_PER_TASK", 1 << 18)
        want = sorted(map(str, indicators.add_indicators(bars, [indicators.atr(5)]).collect()))
        monkeypatch.setattr(framing, "ROWS_PER_TASK", 100)
        df = indicators.add_indicators(bars, [indicators.atr(5)])
        assert sorted(map(str, df.collect())) == want
        tasks[n] = indicators.frame_with(bars, [indicators.atr(5)]).df.rdd.getNumPartitions()
    assert tasks[40] >= 40 and tasks[80] == 2 * tasks[40]
