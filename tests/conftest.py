import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from ohlcflow.schema import BAR_SCHEMA  # noqa: E402
from ohlcflow.session import LOCAL_CONF  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    b = SparkSession.builder.master("local[*]").appName("ohlcflow-tests")
    for k, v in LOCAL_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ohlcflow-test-ckpt-"))
    yield s
    s.stop()


def make_bars(spark, rows):
    """rows: (symbol, date, open, high, low, close, volume)."""
    return spark.createDataFrame(rows, BAR_SCHEMA)


def series(symbol, start, closes, volumes=None, spread=1.0, open_off=-0.5):
    d0 = dt.date.fromisoformat(start) if isinstance(start, str) else start
    vols = volumes or [1_000_000] * len(closes)
    out = []
    for i, c in enumerate(closes):
        out.append((symbol, d0 + dt.timedelta(days=i), c + open_off, c + spread, c - spread, c, vols[i]))
    return out


@pytest.fixture(scope="session")
def ref_fixtures(spark):
    """The screener's own characterization fixtures."""
    D = dt.date.fromisoformat
    aaa = [("AAA", D("2026-01-01"), 10.0, 11.0, 9.5, 10.5, 1000),
           ("AAA", D("2026-01-02"), 11.0, 12.0, 10.5, 11.5, 1200)]
    bbb = [("BBB", D("2026-01-01"), 20.0, 20.5, 19.5, 20.0, 500),
           ("BBB", D("2026-01-03"), 21.0, 22.0, 20.5, 21.5, 700)]
    gap = [("GAP", D("2026-01-01"), 10.0, 11.0, 9.5, 10.5, 1000),
           ("GAP", D("2026-01-02"), 11.6, 12.2, 11.2, 12.0, 1800)]
    nogap = [("NOGAP", D("2026-01-01"), 10.0, 11.0, 9.5, 10.5, 1000),
             ("NOGAP", D("2026-01-02"), 11.2, 11.6, 10.8, 11.1, 1800)]
    n = 280
    trend_c = [50 + 0.8 * i for i in range(n)]
    trend = [("TREND", D("2024-01-01") + dt.timedelta(days=i), c - 0.5, c + 1, c - 1, c,
              2_000_000 if i == n - 1 else 1_000_000) for i, c in enumerate(trend_c)]
    flat = [("FLAT", D("2024-01-01") + dt.timedelta(days=i), 100.0, 100.5, 99.5, 100.0, 1_000_000)
            for i in range(n)]
    return {
        "latest": make_bars(spark, aaa + bbb),
        "gap": make_bars(spark, gap + nogap),
        "trend": make_bars(spark, trend + flat),
    }


@pytest.fixture(scope="session")
def small_bars(spark):
    from ohlcflow.sources.derived import bars_from_lineitem
    # a plan of its own: tests that look at the plan of the bars must not meet the cached one in its place
    return bars_from_lineitem(spark, SF_SMALL).select("*", F.lit(1).alias("_own")).cache().drop("_own")
