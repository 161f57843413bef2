"""Bars and ticks derived from the generated test tables.

The test tables hold no market data, so bars are folded out of ``lineitem``
(one symbol per supplier, one bar per ship date) and ticks out of ``events``
(one symbol per user).  Both are pure DataFrame plans over the whole tables:
the fold is a hash aggregate with a map-side partial step, so a supplier
holding a third of all rows is reduced inside each map task before any
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bars_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: symbol = 'S' || suppkey, date = shipdate, price = extendedprice / quantity.

    Open/close are the first/last trade in a total order over the line's key
    columns (the key alone is not unique in the generated data, so the price
    inputs close the tie).
    """
    li = table(spark, sf_dir, "lineitem")
    # A (supplier, ship date) holds about one line at every scale factor (the
    # number of suppliers grows with the data), so a map-side partial
    # aggregate would only sort the whole scan without reducing it.  The lines
    # are hash-partitioned on the bar key instead (a hot supplier is spread
    # over its dates) and folded once on the reduce side.  Only the table's own
    # columns are moved: the symbol, the price and the order of the lines are
    # made of them behind the exchange.
    lines = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
                      F.col("l_shipdate").cast("date").alias("date")).repartition("l_suppkey", "date")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    folded = lines.groupBy("l_suppkey", "date").agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, key).alias("close"), F.sum("l_quantity").cast("bigint").alias("volume"))
    return folded.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
                         "date", "open", "high", "low", "close", "volume")


def _trend(date, key) -> F.Column:
    """A drift with a triangular 160-day wave whose phase depends on the supplier."""
    days = F.unix_date(date)
    wave = F.abs(F.pmod(days + F.lit(37) * key, F.lit(160)) - F.lit(80)) / F.lit(80.0)
    return (F.lit(1.0) + F.lit(0.0006) * (days - F.lit(8000))) * (F.lit(0.85) + F.lit(0.3) * wave)


def trending_bars_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bars with every price p as 100 * trend * (0.985 + p / 100000): series that
    rise and fall for long enough to meet the trend screens."""
    bars = bars_from_lineitem(spark, sf_dir)
    trend = _trend(F.col("date"), F.substring("symbol", 2, 18).cast("bigint"))
    return bars.select("symbol", "date", *[
        (F.lit(100.0) * trend * (F.lit(0.985) + F.col(c) / F.lit(100000.0))).alias(c)
        for c in ("open", "high", "low", "close")], "volume")


def ticks_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks: symbol = 'U' || user_id, ts, price = value, size = 1."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
                     F.col("ts"), F.col("value").alias("price"), F.lit(1).cast("bigint").alias("size"))


def intraday_bars_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-tick intraday bars (open = high = low = close = price) in the intraday bar schema."""
    t = ticks_from_events(spark, sf_dir)
    return t.select("symbol", "ts", F.col("price").alias("open"), F.col("price").alias("high"),
                    F.col("price").alias("low"), F.col("price").alias("close"),
                    F.col("size").alias("volume"))


# DuckDB text of the same derivations, used by the SQL oracle.
BARS_SQL = """
SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
       arg_min(l_extendedprice / l_quantity,
               row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS open,
       max(l_extendedprice / l_quantity) AS high,
       min(l_extendedprice / l_quantity) AS low,
       arg_max(l_extendedprice / l_quantity,
               row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS close,
       CAST(sum(l_quantity) AS BIGINT) AS volume
FROM lineitem GROUP BY 1, 2
"""

_TREND_SQL = ("(1.0 + 0.0006 * ((date - DATE '1970-01-01') - 8000)) * (0.85 + 0.3 * "
              "(abs(((date - DATE '1970-01-01') + 37 * CAST(substr(symbol, 2) AS BIGINT)) % 160 - 80) / 80.0::DOUBLE))")
TRENDING_BARS_SQL = "SELECT symbol, date, " + ", ".join(
    f"100.0::DOUBLE * ({_TREND_SQL}) * (0.985::DOUBLE + {c} / 100000.0::DOUBLE) AS {c}"
    for c in ("open", "high", "low", "close")) + f", volume FROM ({BARS_SQL})"

TICKS_SQL = """
SELECT 'U' || user_id AS symbol, ts, value AS price, CAST(1 AS BIGINT) AS size FROM events
"""
