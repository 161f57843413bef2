"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (sum of per-query medians, sec),
"unit", "queries": {name: median sec}, "sf", ...}.  A query's time is that of
making its DataFrame (``build``: written helper tables) and of writing every
column of every row to a sink that keeps nothing (``run``), so no computed
column can be optimized away.  Each query is run ``$BENCH_REPS`` times (default
3) after one warm-up; the two parts are also reported apart.  The last two
entries compare the snapshot and the rolling plan over one written store.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ohlcflow.plans import catalog  # noqa: E402
from ohlcflow.plans.scan import scan, scan_store  # noqa: E402
from ohlcflow.plans.spec import ScanSpec  # noqa: E402
from ohlcflow.session import ensure_checkpoint_dir, get_spark  # noqa: E402
from ohlcflow.sources.derived import bars_from_lineitem  # noqa: E402
from ohlcflow.sources.store import build_tail, read_bars, save_bars  # noqa: E402

HEADLINE = [
    "scan_combined", "scan_trend_template", "trend_history", "ind_ema", "ind_rsi", "ind_atr",
    "resample_week", "resample_month", "resample_intraday", "batch_scan", "dollar_volume", "latest_bar",
    "batch_scan_table", "equity_metrics", "atr_percentile",
]


def _batch_100(spark, sf):
    recipes = [(f"r{i}", ScanSpec(min_price=float(500 + 10 * i), min_relative_volume=0.5 + (i % 10) / 10,
                                  min_adr=float(i % 5))) for i in range(100)]
    return catalog.batch_scan(bars_from_lineitem(spark, sf), recipes)


def _stored_scan(plan: str):
    """The combined scan over a bar store written once."""
    paths = {}

    def run(spark, sf):
        if sf not in paths:
            paths[sf] = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bench-store-{uuid.uuid4().hex}"
            save_bars(bars_from_lineitem(spark, sf), paths[sf])
        return scan(read_bars(spark, paths[sf]), catalog.COMBINED, plan=plan)
    return run


def _tail_scan():
    """The combined scan over a store with a tail table."""
    paths = {}

    def run(spark, sf):
        if sf not in paths:
            paths[sf] = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bench-store-{uuid.uuid4().hex}"
            save_bars(bars_from_lineitem(spark, sf), paths[sf])
            build_tail(spark, paths[sf])
        return scan_store(spark, paths[sf], catalog.COMBINED)
    return run


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = get_spark(master=f"local[{cpus}]")
    runs = {name: catalog.QUERIES[name] for name in HEADLINE}
    runs["batch_scan_100_recipes"] = _batch_100
    runs["scan_combined_store_snapshot"] = _stored_scan("snapshot")
    runs["scan_combined_store_rolling"] = _stored_scan("rolling")
    runs["scan_combined_store_tail"] = _tail_scan()
    out, parts = {}, {}
    for name, fn in runs.items():
        times = []
        for i in range(reps + 1):
            t0 = time.perf_counter()
            df = fn(spark, sf_dir)
            t1 = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            if i:
                times.append((time.perf_counter() - t0, t1 - t0))
        out[name] = round(statistics.median(t for t, _ in times), 3)
        build = statistics.median(b for _, b in times)
        parts[name] = {"build": round(build, 3), "run": round(out[name] - build, 3)}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum_median_query_sec", "value": round(sum(out.values()), 3), "unit": "sec",
        "queries": out, "parts": parts, "sf": float(m.group(1)) if m else sf_dir,
        "spark": spark.version, "cpus": cpus,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"), "reps": reps,
    }))


if __name__ == "__main__":
    main()
