"""Plan shape: one shuffle of the bars for any mix of indicators; pruned scan; partial top-k."""

import os
import re
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ohlcflow.operators import indicators as I
from ohlcflow.plans import predicates as P
from ohlcflow.plans.scan import scan
from ohlcflow.sources.derived import bars_from_lineitem
from ohlcflow.sources.store import save_bars


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _stored(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="plan-"), "bars")
    save_bars(bars_from_lineitem(spark, SF_SMALL), path, buckets=4)
    return spark.read.parquet(path)


def test_scan_shuffles_bars_once(spark):
    bars = _stored(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for plan in ("snapshot", "rolling"):
            df = scan(bars, [P.min_rvol(1.0), P.trend_template(), P.gap_up(1.0)], plan=plan)
            text = _plan(df)
            assert text.count("Exchange hashpartitioning(symbol") == 1, text
            assert "BroadcastHashJoin" in text
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_scan_reads_only_needed_columns(spark):
    bars = _stored(spark)
    # an average of closes over the last rows reads no volume and no open
    text = _plan(scan(bars, [P.Predicate("close", (I.sma(20),), lambda: F.col("sma_20") > 0)]).select("symbol", "sma_20"))
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert scans and all("volume" not in s and "open" not in s for s in scans), scans


def test_head_each_uses_partial_group_limit(spark):
    from ohlcflow.sources.store import head_each
    text = _plan(head_each(_stored(spark), 10))
    assert "WindowGroupLimit" in text


def test_latest_bar_is_partial_aggregate(spark):
    from ohlcflow.operators.latest import latest_bars
    text = _plan(latest_bars(_stored(spark)))
    # no sort of the history: the rows of the last dates are found by a join, with a pushed date bound
    assert "GreaterThanOrEqual(date," in text, text
    assert "BroadcastHashJoin" in text, text


def test_trailing_questions_push_a_date_bound(spark):
    from ohlcflow.operators import liquidity, resample
    bars = _stored(spark)
    for df in (liquidity.dollar_volume(bars), resample.period_filter(bars, "6mo")):
        assert "GreaterThanOrEqual(date," in _plan(df)


def test_overlays_and_trades_frame_once(spark):
    from ohlcflow.operators import resample, strategy
    bars = _stored(spark)
    for df in (resample.overlay_sma(bars, lengths=(20, 50)), strategy.forward_trades(bars, (3, 5))):
        assert "Union" not in _plan(df)


def test_wide_windows_share_one_sort(spark):
    """Trend template (windows of 50..252 rows): one sort, a handful of window operators."""
    text = _plan(scan(_stored(spark), [P.trend_template()], history=True))
    assert text.count("Sort [") == 1, text
    assert text.count("Window [") <= 10, text


def test_rsi_gain_and_loss_share_the_block_sort(spark):
    text = _plan(I.add_indicators(_stored(spark), [I.rsi(14)]))
    assert text.count("Sort [") == 2, text


def test_block_rolling_equals_native_frames(spark, monkeypatch):
    from pyspark.sql import functions as F
    from ohlcflow.operators import series
    from ohlcflow.operators.series import frame, roll, rolling
    # force the block form onto widths the small fixture can fill
    monkeypatch.setattr(series, "NATIVE_FRAME_MAX_ROWS", 32)
    monkeypatch.setattr(series, "MIN_BLOCK_ROWS", 16)
    fr = frame(_stored(spark), 260)
    df, checks = fr.df, []
    for agg, fn, col in [("avg", F.avg, "close"), ("sum", F.sum, "volume"),
                         ("max", F.max, "high"), ("min", F.min, "low")]:
        for n in (33, 50, 200, 252):
            df = rolling(fr, df, agg, col, n, f"b_{agg}_{n}")
            df = df.withColumn(f"n_{agg}_{n}", roll(fr, fn, col, n))
            checks.append((f"b_{agg}_{n}", f"n_{agg}_{n}"))
    df = rolling(fr, df, "max", "high", 50, "b_prev")
    out = fr.finish(df)
    assert not [c for c in out.columns if c.startswith("_")]
    bad = out.agg(*[F.sum(F.when(~(F.col(a).eqNullSafe(F.col(b))
                                   | (F.abs(F.col(a) - F.col(b)) <= 1e-9 * F.abs(F.col(b)))), 1)
                          .otherwise(0)).alias(a) for a, b in checks]).collect()[0].asDict()
    assert all(v == 0 for v in bad.values()), bad
    assert out.where(F.col("b_avg_252").isNotNull()).count() > 0


def test_snapshot_pushes_a_date_cutoff_to_the_scan(spark):
    text = _plan(scan(_stored(spark), [P.trend_template()]))
    assert "GreaterThanOrEqual(date," in text, text


def test_chunk_start_inverts_chunk_column(spark):
    import datetime as dt
    from ohlcflow.operators.series import chunk_column, chunk_start
    days = spark.createDataFrame([(dt.date(1999, 12, 31),), (dt.date(2024, 2, 29),), (dt.date(1970, 1, 1),)], "d date")
    stamps = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30, 1),), (dt.datetime(1999, 1, 1, 0, 0, 0),)],
                                   "t timestamp_ntz")
    for df, col in ((days, "d"), (stamps, "t")):
        for (k, value) in df.select(chunk_column(df, col), col).collect():
            start = df.select(chunk_start(df, col, int(k)).alias(col)).limit(1)
            row = start.select(chunk_column(start, col).alias("k"), F.col(col)).first()
            assert row["k"] == k and row[col] <= value


def test_folds_are_hash_aggregates(spark):
    from ohlcflow.operators import resample
    from ohlcflow.sources.derived import ticks_from_events
    bars = _stored(spark)
    for df in (resample.resample_daily(bars, "1w"), resample.resample_daily(bars, "1mo"),
               resample.ticks_to_bars(ticks_from_events(spark, SF_SMALL), "15 minutes")):
        text = _plan(df)
        assert "HashAggregate" in text and "SortAggregate" not in text and "Sort [" not in text, text


def test_folds_of_equal_times_are_defined(spark):
    """Bars of one time: open and close come from one bar each, whatever the order of the rows."""
    import datetime as dt
    import random
    from ohlcflow.operators import resample
    rng = random.Random(1)
    rows = [("A", dt.datetime(2024, 1, 1, 9, rng.choice([0, 7, 14])), float(i), float(i + 9), float(i - 9), float(i) / 2, i)
            for i in range(40)]
    schema = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long"
    for frame in ("15 minutes", "30 days"):
        seen = set()
        for _ in range(3):
            rng.shuffle(rows)
            df = spark.createDataFrame(rows, schema).repartition(rng.randint(1, 5))
            seen.add(tuple(resample.resample_intraday(df, frame).collect()))
        assert len(seen) == 1
        (r,), = seen
        first, last = min(x[1] for x in rows), max(x[1] for x in rows)
        assert r.open in {x[2] for x in rows if x[1] == first} and r.close in {x[5] for x in rows if x[1] == last}


def test_bucketed_store_scans_without_an_exchange_of_bars(spark):
    from ohlcflow.sources.store import read_bucketed, save_bucketed
    path = tempfile.mkdtemp(prefix="bucketed-")
    save_bucketed(bars_from_lineitem(spark, SF_SMALL), "bars_bucketed", os.path.join(path, "bars"), buckets=4)
    bars = read_bucketed(spark, "bars_bucketed")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for plan in ("snapshot", "rolling"):
            text = _plan(scan(bars, [P.min_rvol(1.0), P.trend_template(), P.gap_up(1.0)], plan=plan))
            assert "Exchange hashpartitioning" not in text and "BroadcastHashJoin" in text, text
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sql("DROP TABLE bars_bucketed")


def test_symbols_against_a_store_prune_its_buckets(spark):
    from ohlcflow.sources.store import store_has, store_lacks
    path = os.path.join(tempfile.mkdtemp(prefix="pruned-"), "bars")
    save_bars(bars_from_lineitem(spark, SF_SMALL), path, buckets=16)
    asked = spark.createDataFrame([(" s1",), ("S2",), ("NONE",), (None,)], "symbol string")
    assert sorted(r.symbol for r in store_has(spark, path, asked).collect()) == [" s1", "S2"]
    assert {r.symbol for r in store_lacks(spark, path, asked).collect()} == {"NONE", None}
    assert "dynamicpruning" in _plan(store_has(spark, path, asked))


def test_drop_scratch_tables(spark):
    from ohlcflow.session import drop_scratch_tables, scratch_table
    t = scratch_table(spark.range(3), "probe")
    assert t.count() == 3
    assert drop_scratch_tables(spark)
    assert not drop_scratch_tables(spark)


FORBIDDEN_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                   "FlatMapGroupsInPandas", "MapInPandas")


def test_no_registered_query_plans_pairs_or_python(spark):
    """Every registered query: no cross product, no nested-loop join, no Python evaluation."""
    from conftest import SF_SMALL
    from ohlcflow.plans import catalog
    bad = {}
    for name, fn in catalog.QUERIES.items():
        text = _plan(fn(spark, SF_SMALL))
        found = [n for n in FORBIDDEN_NODES if n in text]
        if found:
            bad[name] = found
    assert not bad, bad
