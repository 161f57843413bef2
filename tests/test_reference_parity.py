"""The screener's three characterization tests, on both scan plans."""

import datetime as dt

import pytest

from ohlcflow.plans import predicates as P
from ohlcflow.plans.scan import scan

PLANS = ["snapshot", "rolling"]


@pytest.mark.parametrize("plan", PLANS)
def test_latest_row_per_symbol(ref_fixtures, plan):
    out = {r.symbol: r.date for r in scan(ref_fixtures["latest"], [], plan=plan).collect()}
    assert out == {"AAA": dt.date(2026, 1, 2), "BBB": dt.date(2026, 1, 3)}


@pytest.mark.parametrize("plan", PLANS)
def test_min_price_and_gap(ref_fixtures, plan):
    rows = scan(ref_fixtures["gap"], [P.min_price(11.5), P.gap_up(5.0)], plan=plan).collect()
    assert [r.symbol for r in rows] == ["GAP"]
    assert rows[0].prev_high == 11.0


@pytest.mark.parametrize("plan", PLANS)
def test_rvol_and_trend_template(ref_fixtures, plan):
    rows = scan(ref_fixtures["trend"], [P.min_rvol(1.5), P.trend_template()], plan=plan).collect()
    assert [r.symbol for r in rows] == ["TREND"]
    r = rows[0]
    assert r.rvol_20 == pytest.approx(2_000_000 / 1_050_000)
    assert r.sma_50 > r.sma_150 > r.sma_200 > r.sma_200_1m_ago


def test_predicates_after_latest_row(ref_fixtures):
    # close >= 11.5 must not move the latest row of NOGAP back to a passing bar
    rows = scan(ref_fixtures["gap"], [P.min_price(10.0)]).collect()
    assert sorted((r.symbol, r.date) for r in rows) == [("GAP", dt.date(2026, 1, 2)),
                                                        ("NOGAP", dt.date(2026, 1, 2))]
