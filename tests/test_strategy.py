"""As-of join, equity curves and walk-forward folds against plain recomputation."""

import datetime as dt
import math
import random
import re

import pytest

from conftest import make_bars, series
from ohlcflow.operators import strategy as ST
from ohlcflow.operators.asof import asof_join

D0 = dt.date(2020, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("by", [(), ("k",), ("k", "j")])
def test_asof_join_by_brute_force(spark, by):
    rng = random.Random(len(by))
    day = lambda: D0 + dt.timedelta(days=rng.randrange(900)) if rng.random() < .97 else None
    key = lambda: rng.choice(["a", "a", "a", "b", None])
    left = [(key(), rng.randrange(2), day(), i) for i in range(400)]
    right = [(key(), rng.randrange(2), day(), rng.choice([None, 1.0, 2.0, 3.0]), rng.randrange(9)) for _ in range(60)]
    l_df = spark.createDataFrame(left, "k string, j int, date date, i int").repartition(4)
    r_df = spark.createDataFrame(right, "k string, j int, date date, v double, w int").repartition(3)
    got = {r.i: (r.v, r.w) for r in asof_join(l_df, r_df, ["v", "w"], by=by).collect()}
    at = {"k": 0, "j": 1}
    want = {}
    for row in left:
        mine = [r for r in right if row[2] and r[2] and r[2] <= row[2]
                and all(r[at[b]] == row[at[b]] and row[at[b]] is not None for b in by)]
        best = max(mine, key=lambda r: (r[2], r[3] is not None, r[3] or 0.0, r[4]), default=None)
        want[row[3]] = (best[3], best[4]) if best else (None, None)
    assert got == want


def test_asof_join_of_empty_sides(spark):
    left = spark.createDataFrame([(D0, 1)], "date date, i int")
    right = spark.createDataFrame([], "date date, v double")
    assert [tuple(r) for r in asof_join(left, right, ["v"]).collect()] == [(D0, 1, None)]
    assert asof_join(left.limit(0), right, ["v"]).collect() == []


def _metrics(points):
    e = [v for _, v in sorted(points)]
    ret = [b / a - 1.0 for a, b in zip(e, e[1:]) if a]
    top, fall = -math.inf, None
    for v in e:
        top = max(top, v)
        if top > 0:
            fall = v / top - 1.0 if fall is None else min(fall, v / top - 1.0)
    return (len(e), sum(r > 0 for r in ret) / len(ret) if ret else None, sum(ret) / len(ret) if ret else None, fall)


def test_equity_metrics_by_brute_force(spark):
    """Curves over years with gaps, one point, repeated days, nulls and a fall that spans every level."""
    rng = random.Random(2)
    curves = {"one": [(0, 5.0)], "fall": [(0, 100.0), (9000, 1.0), (9001, 50.0)], "flat": [(i, 1.0) for i in range(300)],
              "minus": [(0, -1.0), (1, -2.0), (500, 3.0), (501, 2.0)]}
    for k in range(4):
        v, points = 100.0, []
        for i in range(0, 12_000, rng.choice([1, 7, 90])):
            v *= math.exp(rng.gauss(0, .02))
            points.append((i, v))
        curves[f"walk{k}"] = points + [(5, 80.0), (5, 70.0)]
    rows = [(s, D0 + dt.timedelta(days=d), v) for s, p in curves.items() for d, v in p]
    df = spark.createDataFrame(rows + [("one", None, 3.0), ("one", D0, None), ("null", D0, None)],
                               "strategy string, date date, equity double").repartition(6)
    got = ST.equity_metrics(df)
    near = lambda a, b: a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))
    rows = {r.strategy: r for r in got.collect()}
    assert set(rows) == set(curves)
    for s, p in curves.items():
        want = _metrics([(d, v) for d, v in p])
        r = rows[s]
        assert all(map(near, (r.n_points, r.win_rate, r.expectancy, r.max_drawdown), want)), (s, r, want)
    assert near(rows["fall"].total_return, -0.5) and near(rows["fall"].max_drawdown, -0.99)
    # no window over a whole strategy: every one is partitioned by a chunk as well
    windows = re.findall(r"windowspecdefinition\(([^)]*?) (?:ASC|DESC)", _plan(got))
    assert windows and all("_chunk" in w or "_group" in w for w in windows), windows
    assert ST.equity_metrics(df.limit(0)).collect() == []


def test_walk_forward_uses_known_exits_only(spark):
    """The training part of a fold counts no signal whose exit lies in its test part."""
    rng = random.Random(5)
    v, closes = 100.0, []
    for _ in range(700):
        v *= math.exp(rng.gauss(0.001, .02))
        closes.append(v)
    bars = make_bars(spark, series("AAA", "2020-01-01", closes) + series("BBB", "2020-01-01", closes[::-1]))
    opts = dict(lengths=(3, 8), horizon=10)
    fired = [(r.param, (r._sig_date - D0).days, (r._exit_date - D0).days, r.fwd_ret)
             for r in ST._sweep(bars, **opts).collect()]
    got = {r.fold: r for r in ST.walk_forward(bars, start="2020-01-01", train_days=200, test_days=80, step_days=50,
                                               **opts).collect()}
    for f in range(20):
        a = 50 * f
        train = {p: [r for q, s, e, r in fired if q == p and a <= s and e < a + 200] for p in (3, 8)}
        train = {p: x for p, x in train.items() if x}
        if not train:
            assert f not in got
            continue
        best = max(train, key=lambda p: (round(sum(train[p]) / len(train[p]), 9), -p))
        test = [r for q, s, _, r in fired if q == best and a + 200 <= s < a + 280]
        r = got[f]
        assert (r.param, r.n_train, r.n_test) == (best, len(train[best]), len(test))
        assert r.test_start == D0 + dt.timedelta(days=a + 200)
        assert (r.test_ret is None) == (not test) and (not test or math.isclose(r.test_ret, sum(test) / len(test), abs_tol=1e-12))


def test_relative_strength_as_of_fills_only_missing_days(spark):
    a = series("AAA", "2024-01-01", [10.0 + i for i in range(60)])
    b = [r for i, r in enumerate(series("IDX", "2024-01-01", [50.0 + i % 7 for i in range(60)])) if i % 5]
    bars = make_bars(spark, a + b)
    plain = {(r.symbol, r.date): r.bench_ret_20 for r in ST.relative_strength(bars, "IDX", 20).collect()}
    asof = {(r.symbol, r.date): r.bench_ret_20 for r in ST.relative_strength(bars, "IDX", 20, as_of=True).collect()}
    assert all(asof[k] == v for k, v in plain.items() if v is not None)
    last = None
    for i in range(60):
        d = dt.date(2024, 1, 1) + dt.timedelta(days=i)
        last = plain.get(("IDX", d), last)
        if ("AAA", d) in asof:
            assert asof[("AAA", d)] == last
    assert any(v is None for v in plain.values())


@pytest.mark.parametrize("n", [2, 5, 16, 33, 70])
def test_sliding_share_by_brute_force(spark, n):
    """Ties, nulls, NaN and several partitions of a symbol: every rank from the plain window."""
    from ohlcflow.operators.series import frame, sliding_share
    rng = random.Random(n)
    rows = []
    for s, size in (("A", 700), ("B", 40), ("C", n), ("D", 1)):
        for i in range(size):
            rows.append((s, D0 + dt.timedelta(days=2 * i), rng.choice([None] * (s == "A" and 300 < i < 305) + [
                float(rng.randint(0, 9)), rng.random() * 9, float("nan")][:3])))
    df = spark.createDataFrame(rows, "symbol string, date date, x double").repartition(5)
    fr = frame(df, n - 1, width=8, span=64)
    got = {(r.symbol, r.date): r.share for r in fr.finish(sliding_share(fr, fr.df, "x", n, "share")).collect()}
    key = lambda v: (v != v, 0.0 if v != v else v)  # noqa: E731  (NaN is largest and equals itself)
    assert len(got) == len(rows)
    by = {}
    for s, d, x in rows:
        by.setdefault(s, []).append((d, x))
    for s, seen in by.items():
        for i, (d, x) in enumerate(seen):
            last = [v for _, v in seen[max(0, i - n + 1):i + 1]]
            if len(last) < n or None in last:
                assert got[s, d] is None
            else:
                assert got[s, d] == sum(key(v) <= key(x) for v in last) / n


def test_atr_percentile_collects_no_list(spark):
    bars = make_bars(spark, series("AAA", "2020-01-01", [100.0 + i % 9 for i in range(400)]))
    text = _plan(ST.atr_percentile(bars))
    assert "collect_list" not in text and text.count("Exchange hashpartitioning(symbol") <= 2
