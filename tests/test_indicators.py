"""Indicators against a pandas reference, incl. forced multi-partition halos, and edge cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import make_bars, series
from ohlcflow.operators import indicators as I

INDS = [I.sma(50), I.rvol(20), I.adr(20), I.extrema(252), I.sma_200_1m_ago(), I.prev_high(),
        I.ema(20), I.rsi(14), I.atr(14), I.diff("close")]


def pandas_reference(pdf):
    res = []
    for _, g in pdf.sort_values(["symbol", "date"]).groupby("symbol"):
        g = g.copy()
        g["sma_50"] = g.close.rolling(50).mean()
        g["avg_volume_20"] = g.volume.rolling(20).mean()
        g["rvol_20"] = g.volume / g.avg_volume_20
        g["adr_20"] = ((g.high - g.low) / g.low * 100).rolling(20).mean()
        g["high_252"] = g.high.rolling(252).max()
        g["low_252"] = g.low.rolling(252).min()
        g["sma_200_1m_ago"] = g.close.rolling(200).mean().shift(20)
        g["prev_high"] = g.high.shift(1)
        g["close_diff"] = g.close.diff()
        g["ema_20"] = g.close.ewm(span=20, adjust=False).mean()
        d = g.close.diff()
        up, dn = d.where(d > 0, 0.0), (-d).where(d < 0, 0.0)
        ag = up.ewm(alpha=1 / 14, adjust=False).mean()
        al = dn.ewm(alpha=1 / 14, adjust=False).mean()
        g["rsi_14"] = 100 - 100 / (1 + ag / al)
        pc = g.close.shift(1)
        tr = pd.concat([g.high - g.low, (g.high - pc).abs(), (g.low - pc).abs()], axis=1).max(axis=1)
        g["atr_14"] = tr.ewm(alpha=1 / 14, adjust=False).mean()
        res.append(g)
    return pd.concat(res)


COLS = ["sma_50", "avg_volume_20", "rvol_20", "adr_20", "high_252", "low_252", "sma_200_1m_ago",
        "prev_high", "close_diff", "ema_20", "rsi_14", "atr_14"]


@pytest.mark.parametrize("span,width", [(None, None), (64, 5)])
def test_against_pandas(small_bars, span, width):
    out = I.add_indicators(small_bars, INDS, span=span, width=width).toPandas()
    exp = pandas_reference(small_bars.toPandas())
    m = out.merge(exp, on=["symbol", "date"], suffixes=("", "_e"))
    assert len(m) == len(exp) == len(out)
    for c in COLS:
        a, e = m[c].astype(float), m[c + "_e"].astype(float)
        assert (a.isna() == e.isna()).all(), c
        ok = a.notna()
        assert np.allclose(a[ok], e[ok], rtol=1e-9, atol=1e-9), c


def test_snapshot_plan_equals_rolling(small_bars):
    from ohlcflow.operators.series import Framed
    inds = [I.sma(50), I.rsi(14), I.extrema(252), I.sma_200_1m_ago()]
    snap = I.frame_with(small_bars, inds, latest=True)
    roll = I.frame_with(small_bars, inds, latest=False)
    a = snap.finish(snap.df.where(Framed.is_latest())).toPandas().sort_values("symbol").reset_index(drop=True)
    b = roll.finish(roll.df.where(Framed.is_latest())).toPandas().sort_values("symbol").reset_index(drop=True)
    assert len(a) == small_bars.select("symbol").distinct().count()
    pd.testing.assert_frame_equal(a, b, rtol=1e-12)


def test_warmup_needs_exactly_n_rows(spark):
    for n_rows in (19, 20, 49, 199, 219, 220, 251, 252):
        bars = make_bars(spark, series("X", "2020-01-01", [10.0 + i for i in range(n_rows)]))
        r = I.add_indicators(bars, [I.sma(20), I.sma(50), I.sma_200_1m_ago(), I.extrema(252)]) \
            .orderBy("date").collect()[-1]
        assert (r.sma_20 is not None) == (n_rows >= 20)
        assert (r.sma_50 is not None) == (n_rows >= 50)
        assert (r.sma_200_1m_ago is not None) == (n_rows >= 220)
        assert (r.high_252 is not None) == (n_rows >= 252)


def test_rsi_limits(spark):
    flat = series("FLAT", "2020-01-01", [100.0] * 30)
    up = series("UP", "2020-01-01", [100.0 + i for i in range(30)])
    df = I.add_indicators(make_bars(spark, flat + up), [I.rsi(14)]).orderBy("symbol", "date").toPandas()
    assert df[df.symbol == "FLAT"].rsi_14.apply(math.isnan).all()
    up_rsi = df[df.symbol == "UP"].rsi_14.tolist()
    assert math.isnan(up_rsi[0]) and all(v == 100.0 for v in up_rsi[1:])


def test_zero_low_and_zero_volume_give_null(spark):
    rows = series("Z", "2020-01-01", [10.0] * 25, volumes=[0] * 25)
    rows = [(s, d, o, h, 0.0 if i == 24 else lo, c, v) for i, (s, d, o, h, lo, c, v) in enumerate(rows)]
    r = I.add_indicators(make_bars(spark, rows), [I.adr(20), I.rvol(20)]).orderBy("date").collect()[-1]
    assert r.adr_20 is None and r.rvol_20 is None and r.avg_volume_20 == 0.0


def test_null_close_inside_window(spark):
    rows = series("N", "2020-01-01", [10.0] * 25)
    rows[22] = rows[22][:5] + (None,) + rows[22][6:]
    out = I.add_indicators(make_bars(spark, rows), [I.sma(20)]).orderBy("date").collect()
    assert out[21].sma_20 == 10.0 and out[22].sma_20 is None and out[24].sma_20 is None


def test_large_volume_no_overflow(spark):
    big = 2 ** 62
    rows = series("V", "2020-01-01", [10.0] * 21, volumes=[big] * 21)
    r = I.add_indicators(make_bars(spark, rows), [I.rvol(20)]).orderBy("date").collect()[-1]
    assert r.rvol_20 == pytest.approx(1.0)


def _latest_by_windows(bars, inds):
    from ohlcflow.operators.series import Framed
    fr = I.frame_with(bars, inds, latest=False)
    return fr.finish(fr.df.where(Framed.is_latest()))


def _assert_same(a_df, b_df):
    a = a_df.toPandas().sort_values("symbol").reset_index(drop=True)
    b = b_df.select(*a_df.columns).toPandas().sort_values("symbol").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, rtol=1e-12, check_dtype=False)


def test_latest_aggregate_form_equals_windows(small_bars):
    from ohlcflow.operators import screens as S
    inds = [I.sma(50), I.sma(150), I.sma(200), I.extrema(252), I.sma_200_1m_ago(), I.rvol(20), I.adr(20),
            I.prev_high(), I.diff("close"), I.shifted("volume", 2), I.rolling_stddev(20),
            I.rolling_max(20, "high", "high_20"), S.prior_high(20), S.range_min(7), S.prev_bar()]
    snap = I.snapshot_with(small_bars, inds)
    assert snap is not None
    assert snap.count() == small_bars.select("symbol").distinct().count()
    _assert_same(snap, _latest_by_windows(small_bars, inds))


def test_latest_aggregate_form_short_and_null_histories(spark):
    # 3 rows (warm-up everywhere), 25 rows with a NULL close inside the 20-row window, 60 clean rows
    rows = series("S3", "2024-01-01", [10.0, 11.0, 12.0])
    gappy = series("NUL", "2024-01-01", [20.0 + i for i in range(25)])
    gappy[15] = gappy[15][:5] + (None,) + gappy[15][6:]
    rows += gappy + series("OK", "2023-06-01", [30.0 + (i % 7) for i in range(60)])
    bars = make_bars(spark, rows)
    inds = [I.sma(20), I.sma(50), I.rvol(20), I.shifted("close", 1), I.diff("close"), I.rolling_stddev(20)]
    _assert_same(I.snapshot_with(bars, inds), _latest_by_windows(bars, inds))


def test_latest_aggregate_form_of_ewms_equals_windows(small_bars):
    inds = [I.ema(20), I.ema(1), I.rsi(14), I.rsi(2), I.atr(14), I.atr(5),
            I.lagged(I.ema(10, name="ema_10__base"), 3, "ema_10_3ago"), I.sma(50)]
    a = I.snapshot_with(small_bars, inds).toPandas().sort_values("symbol").reset_index(drop=True)
    b = _latest_by_windows(small_bars, inds).select(*a.columns).toPandas().sort_values("symbol").reset_index(drop=True)
    for c in ("ema_20", "ema_1", "rsi_14", "rsi_2", "atr_14", "atr_5", "ema_10_3ago"):
        assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-10, atol=1e-10, equal_nan=True), c


def test_latest_aggregate_form_falls_back_without_one(small_bars):
    plain = I.Indicator("close_copy", 0, lambda fr, df: df.withColumn("close_copy", F.col("close")))
    assert I.snapshot_with(small_bars, [I.sma(20), plain]) is None
