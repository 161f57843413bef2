"""Registered queries: a Spark plan and an independent DuckDB SQL text per operator.

Every query reads the generated tables (bars are folded out of ``lineitem``,
ticks out of ``events``) over their whole extent.  Computed doubles are
rounded to 4 decimals on both sides; raw prices are compared unrounded
(both engines compute them with the same IEEE division).
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import indicators as I
from ..functions.numeric import round_to
from ..functions.periods import period_days_col
from ..operators.latest import latest_bars
from ..sources.derived import (BARS_SQL, TICKS_SQL, TRENDING_BARS_SQL, bars_from_lineitem,
                               intraday_bars_from_events, table, ticks_from_events, trending_bars_from_lineitem)
from ..operators import liquidity as L
from ..operators import quality as Q
from ..operators import screens as SC
from ..operators import strategy as ST
from ..operators import resample as R
from ..session import scratch_folder, scratch_table
from ..sources import ingest as IN
from ..sources.files import write_files
from ..sources import store as S
from . import predicates as P
from ..streaming.resample_stream import read_stream_store, run_to_store
from .batch import batch_scan
from .recipe_index import batch_scan_table
from .scan import report, run_spec, scan, sort_results, top_k, trend_scorecard
from .spec import ScanSpec

SparkQuery = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, SparkQuery] = {}
ORACLE: dict[str, str] = {}

BASE = ("symbol", "date", "open", "high", "low", "close", "volume")


def register(name: str, sql: str | None = None):
    def deco(fn: SparkQuery) -> SparkQuery:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return bars_from_lineitem(spark, sf)


def r4(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[round_to(F.col(c), 4).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------------------
# SQL helpers (DuckDB dialect)
# ---------------------------------------------------------------------------

def with_bars(body: str, *ctes: str, recursive: bool = False) -> str:
    parts = [f"bars AS ({BARS_SQL})", *ctes]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + body


def trending(body: str, *ctes: str, recursive: bool = False) -> str:
    """``with_bars`` over the trending series."""
    return with_bars(body, *ctes, recursive=recursive).replace(f"bars AS ({BARS_SQL})", f"bars AS ({TRENDING_BARS_SQL})", 1)


def w(n: int, order: str = "date") -> str:
    return f"(PARTITION BY symbol ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll_sql(agg: str, expr: str, n: int) -> str:
    return f"CASE WHEN count({expr}) OVER {w(n)} = {n} THEN {agg}({expr}) OVER {w(n)} END"


WS = "(PARTITION BY symbol ORDER BY date)"
LATEST = "row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn"
BASE_SQL = "symbol, date, open, high, low, close, volume"

IND_SQL = {
    "sma_50": roll_sql("avg", "close", 50),
    "sma_150": roll_sql("avg", "close", 150),
    "sma_200": roll_sql("avg", "close", 200),
    "sma_20": roll_sql("avg", "close", 20),
    "avg_volume_20": roll_sql("avg", "volume", 20),
    "adr_20": roll_sql("avg", "((high - low) / low * 100)", 20),
    "high_252": roll_sql("max", "high", 252),
    "low_252": roll_sql("min", "low", 252),
    "prev_high": f"lag(high) OVER {WS}",
    "close_diff": f"close - lag(close) OVER {WS}",
    "std_20": roll_sql("stddev_pop", "close", 20),
}


def ind_cte(name: str, cols: list[str], src: str = "bars", extra: str = "") -> str:
    sel = ", ".join(f"{IND_SQL[c]} AS {c}" for c in cols)
    return f"{name} AS (SELECT *, {sel}{extra} FROM {src})"


def ewm_ctes(alpha: float, x_expr_cte: str, prefix: str) -> list[str]:
    """Recursive CTE computing y0 = x0, yt = a*xt + (1-a)*y(t-1) over column x of ``x_expr_cte``."""
    d = 1.0 - alpha
    return [
        f"{prefix}_rec AS (SELECT symbol, i, x AS y FROM {x_expr_cte} WHERE i = 0 "
        f"UNION ALL SELECT s.symbol, s.i, {alpha!r} * s.x + {d!r} * r.y "
        f"FROM {prefix}_rec r JOIN {x_expr_cte} s ON s.symbol = r.symbol AND s.i = r.i + 1)"
    ]


def numbered(name: str, x_expr: str, src: str = "bars") -> str:
    return (f"{name} AS (SELECT symbol, date, {x_expr} AS x, "
            f"row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i FROM {src})")


# ---------------------------------------------------------------------------
# A1 / scans
# ---------------------------------------------------------------------------

@register("latest_bar", with_bars(f"SELECT {BASE_SQL} FROM (SELECT *, {LATEST} FROM bars) WHERE rn = 1"))
def q_latest_bar(spark, sf):
    return latest_bars(bars(spark, sf)).select(*BASE)


@register("scan_min_price", with_bars(
    f"SELECT {BASE_SQL} FROM (SELECT *, {LATEST} FROM bars) WHERE rn = 1 AND close >= 1500"))
def q_scan_min_price(spark, sf):
    return scan(bars(spark, sf), [P.min_price(1500)]).select(*BASE)


@register("scan_min_volume", with_bars(
    f"SELECT {BASE_SQL} FROM (SELECT *, {LATEST} FROM bars) WHERE rn = 1 AND volume >= 25"))
def q_scan_min_volume(spark, sf):
    return scan(bars(spark, sf), [P.min_volume(25)]).select(*BASE)


@register("scan_rvol", with_bars(
    f"SELECT {BASE_SQL}, (round((avg_volume_20) * 10000) / 10000 + 0.0) AS avg_volume_20, (round((rvol_20) * 10000) / 10000 + 0.0) AS rvol_20 "
    f"FROM (SELECT *, volume / avg_volume_20 AS rvol_20 FROM i) WHERE rn = 1 AND rvol_20 >= 1.5",
    ind_cte("i", ["avg_volume_20"], extra=f", {LATEST}")))
def q_scan_rvol(spark, sf):
    return r4(scan(bars(spark, sf), [P.min_rvol(1.5)]), "avg_volume_20", "rvol_20")


@register("scan_adr", with_bars(
    f"SELECT {BASE_SQL}, (round((adr_20) * 10000) / 10000 + 0.0) AS adr_20 FROM i WHERE rn = 1 AND adr_20 >= 3",
    ind_cte("i", ["adr_20"], extra=f", {LATEST}")))
def q_scan_adr(spark, sf):
    return r4(scan(bars(spark, sf), [P.min_adr(3)]), "adr_20")


@register("scan_gap_up", with_bars(
    f"SELECT {BASE_SQL}, prev_high FROM i WHERE rn = 1 AND open > prev_high * 1.05",
    ind_cte("i", ["prev_high"], extra=f", {LATEST}")))
def q_scan_gap_up(spark, sf):
    return scan(bars(spark, sf), [P.gap_up(5)])


TREND_COLS = ["sma_50", "sma_150", "sma_200", "high_252", "low_252"]
TREND_CTE = ind_cte("t0", TREND_COLS, extra=f", {LATEST}")
TREND_CTE2 = "t AS (SELECT *, lag(sma_200, 20) OVER (PARTITION BY symbol ORDER BY date) AS sma_200_1m_ago FROM t0)"
TREND_COND = ("close > sma_50 AND sma_50 > sma_150 AND sma_150 > sma_200 AND sma_200 > sma_200_1m_ago "
              "AND close > low_252 * 1.25 AND close > high_252 * 0.75")
TREND_OUT = ", ".join(f"(round(({c}) * 10000) / 10000 + 0.0) AS {c}" for c in ["sma_50", "sma_150", "sma_200"]) + \
    ", high_252, low_252, (round((sma_200_1m_ago) * 10000) / 10000 + 0.0) AS sma_200_1m_ago"
TREND_R4 = ("sma_50", "sma_150", "sma_200", "sma_200_1m_ago")


@register("scan_trend_template", trending(
    f"SELECT {BASE_SQL}, {TREND_OUT} FROM t WHERE rn = 1 AND {TREND_COND}", TREND_CTE, TREND_CTE2))
def q_scan_trend_template(spark, sf):
    return r4(scan(trending_bars_from_lineitem(spark, sf), [P.trend_template()]), *TREND_R4)


@register("trend_history", with_bars(
    f"SELECT {BASE_SQL}, {TREND_OUT} FROM t WHERE {TREND_COND}", TREND_CTE, TREND_CTE2))
def q_trend_history(spark, sf):
    return r4(scan(bars(spark, sf), [P.trend_template()], history=True), *TREND_R4)


@register("trend_scorecard", with_bars(
    "SELECT symbol, date, close > sma_50 AS close_gt_sma_50, sma_50 > sma_150 AS sma_50_gt_sma_150, "
    "sma_150 > sma_200 AS sma_150_gt_sma_200, sma_200 > sma_200_1m_ago AS sma_200_rising, "
    "close > low_252 * 1.25 AS above_low_252, close > high_252 * 0.75 AS near_high_252, "
    f"coalesce({TREND_COND}, false) AS passes FROM t WHERE rn = 1", TREND_CTE, TREND_CTE2))
def q_trend_scorecard(spark, sf):
    return trend_scorecard(bars(spark, sf))


COMBINED = ScanSpec(min_price=1000.0, min_relative_volume=1.0, min_adr=2.0, gap_up=0.0)


@register("scan_combined", with_bars(
    f"SELECT {BASE_SQL}, (round((avg_volume_20) * 10000) / 10000 + 0.0) AS avg_volume_20, (round((rvol_20) * 10000) / 10000 + 0.0) AS rvol_20, "
    "(round((adr_20) * 10000) / 10000 + 0.0) AS adr_20, prev_high FROM (SELECT *, volume / avg_volume_20 AS rvol_20 FROM i) "
    "WHERE rn = 1 AND close >= 1000 AND rvol_20 >= 1.0 AND adr_20 >= 2.0 AND open > prev_high * 1.0",
    ind_cte("i", ["avg_volume_20", "adr_20", "prev_high"], extra=f", {LATEST}")))
def q_scan_combined(spark, sf):
    return r4(scan(bars(spark, sf), COMBINED), "avg_volume_20", "rvol_20", "adr_20")


REPORT_SPEC = ScanSpec(min_price=1500.0, min_relative_volume=1.0, trend_template=False, sort="rvol_20")
REPORT_SQL_COLS = ("symbol, date, (round((close) * 100) / 100 + 0.0) AS close, volume, "
                   "CASE WHEN rvol_20 IS NULL OR rvol_20 = 0 THEN NULL ELSE (round((rvol_20) * 100) / 100 + 0.0) END AS rvol_20, "
                   "CAST(NULL AS DOUBLE) AS adr_20, CAST(NULL AS DOUBLE) AS sma_50, CAST(NULL AS DOUBLE) AS sma_200")


@register("scan_report", with_bars(
    f"SELECT {REPORT_SQL_COLS} FROM (SELECT *, volume / avg_volume_20 AS rvol_20 FROM i) "
    "WHERE rn = 1 AND close >= 1500 AND rvol_20 >= 1.0",
    ind_cte("i", ["avg_volume_20"], extra=f", {LATEST}")))
def q_scan_report(spark, sf):
    return sort_results(report(scan(bars(spark, sf), REPORT_SPEC)), REPORT_SPEC.sort)


@register("scan_top_k", with_bars(
    f"SELECT {REPORT_SQL_COLS} FROM (SELECT *, volume / avg_volume_20 AS rvol_20 FROM i) "
    "WHERE rn = 1 AND rvol_20 >= 0 ORDER BY (round((rvol_20) * 100) / 100 + 0.0) DESC NULLS FIRST, symbol LIMIT 10",
    ind_cte("i", ["avg_volume_20"], extra=f", {LATEST}")))
def q_scan_top_k(spark, sf):
    return top_k(report(scan(bars(spark, sf), [P.min_rvol(0.0)])), "rvol_20", 10)


# ---------------------------------------------------------------------------
# Indicator library
# ---------------------------------------------------------------------------

@register("ind_sma", with_bars(
    "SELECT symbol, date, (round((sma_20) * 10000) / 10000 + 0.0) AS sma_20, (round((sma_50) * 10000) / 10000 + 0.0) AS sma_50 FROM i",
    ind_cte("i", ["sma_20", "sma_50"])))
def q_ind_sma(spark, sf):
    df = I.add_indicators(bars(spark, sf), [I.sma(20), I.sma(50)])
    return r4(df.select("symbol", "date", "sma_20", "sma_50"), "sma_20", "sma_50")


@register("ind_ema", with_bars(
    "SELECT n.symbol, n.date, (round((r.y) * 10000) / 10000 + 0.0) AS ema_20 FROM n JOIN e_rec r ON r.symbol = n.symbol AND r.i = n.i",
    numbered("n", "close"), *ewm_ctes(2.0 / 21.0, "n", "e"), recursive=True))
def q_ind_ema(spark, sf):
    df = I.add_indicators(bars(spark, sf), [I.ema(20)])
    return r4(df.select("symbol", "date", "ema_20"), "ema_20")


RSI_GAIN = "greatest(close - lag(close) OVER (PARTITION BY symbol ORDER BY date), 0)"
RSI_LOSS = "greatest(lag(close) OVER (PARTITION BY symbol ORDER BY date) - close, 0)"


def rsi_sql_ctes(period: int) -> list[str]:
    a = 1.0 / period
    return [
        f"g AS (SELECT symbol, date, coalesce({RSI_GAIN}, 0) AS x, "
        "row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i FROM bars)",
        f"l AS (SELECT symbol, date, coalesce({RSI_LOSS}, 0) AS x, "
        "row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i FROM bars)",
        *ewm_ctes(a, "g", "gg"), *ewm_ctes(a, "l", "ll"),
        f"rsi AS (SELECT g.symbol, g.date, g.i, CASE WHEN ll.y = 0 THEN CASE WHEN gg.y = 0 THEN 'NaN'::DOUBLE "
        "ELSE 100.0 END ELSE 100.0 - 100.0 / (1.0 + gg.y / ll.y) END AS rsi "
        "FROM g JOIN gg_rec gg ON gg.symbol = g.symbol AND gg.i = g.i "
        "JOIN ll_rec ll ON ll.symbol = g.symbol AND ll.i = g.i)",
    ]


@register("ind_rsi", with_bars(
    "SELECT symbol, date, (round((rsi) * 10000) / 10000 + 0.0) AS rsi_14 FROM rsi",
    *rsi_sql_ctes(14), recursive=True))
def q_ind_rsi(spark, sf):
    df = I.add_indicators(bars(spark, sf), [I.rsi(14)])
    return r4(df.select("symbol", "date", "rsi_14"), "rsi_14")


TR_SQL = ("greatest(high - low, coalesce(abs(high - lag(close) OVER (PARTITION BY symbol ORDER BY date)), 0), "
          "coalesce(abs(low - lag(close) OVER (PARTITION BY symbol ORDER BY date)), 0))")


@register("ind_atr", with_bars(
    "SELECT n.symbol, n.date, (round((r.y) * 10000) / 10000 + 0.0) AS atr_14 FROM n JOIN a_rec r ON r.symbol = n.symbol AND r.i = n.i",
    numbered("n", TR_SQL), *ewm_ctes(1.0 / 14.0, "n", "a"), recursive=True))
def q_ind_atr(spark, sf):
    df = I.add_indicators(bars(spark, sf), [I.atr(14)])
    return r4(df.select("symbol", "date", "atr_14"), "atr_14")


@register("ind_adr", with_bars("SELECT symbol, date, (round((adr_20) * 10000) / 10000 + 0.0) AS adr_20 FROM i", ind_cte("i", ["adr_20"])))
def q_ind_adr(spark, sf):
    df = I.add_indicators(bars(spark, sf), [I.adr(20)])
    return r4(df.select("symbol", "date", "adr_20"), "adr_20")


@register("ind_rvol", with_bars(
    "SELECT symbol, date, (round((avg_volume_20) * 10000) / 10000 + 0.0) AS avg_volume_20, "
    "(round((volume / avg_volume_20) * 10000) / 10000 + 0.0) AS rvol_20 FROM i", ind_cte("i", ["avg_volume_20"])))
def q_ind_rvol(spark, sf):
    df = I.add_indicators(bars(spark, sf), [I.rvol(20)])
    return r4(df.select("symbol", "date", "avg_volume_20", "rvol_20"), "avg_volume_20", "rvol_20")


@register("ind_extrema", with_bars(
    "SELECT symbol, date, high_252, low_252 FROM i", ind_cte("i", ["high_252", "low_252"])))
def q_ind_extrema(spark, sf):
    df = I.add_indicators(bars(spark, sf), [I.extrema(252)])
    return df.select("symbol", "date", "high_252", "low_252")


@register("ind_common", with_bars(
    "SELECT i.symbol, i.date, (round((sma_50) * 10000) / 10000 + 0.0) AS sma_50, (round((sma_200) * 10000) / 10000 + 0.0) AS sma_200, "
    "(round((rsi.rsi) * 10000) / 10000 + 0.0) AS rsi_14 FROM i JOIN rsi ON rsi.symbol = i.symbol AND rsi.date = i.date",
    *rsi_sql_ctes(14), ind_cte("i", ["sma_50", "sma_200"]), recursive=True))
def q_ind_common(spark, sf):
    df = I.add_indicators(bars(spark, sf), I.common_suite())
    return r4(df.select("symbol", "date", "sma_50", "sma_200", "rsi_14"), "sma_50", "sma_200", "rsi_14")


@register("ind_lag_diff", with_bars(
    "SELECT symbol, date, prev_high, close_diff, "
    "(round((lag(sma_200, 20) OVER (PARTITION BY symbol ORDER BY date)) * 10000) / 10000 + 0.0) AS sma_200_1m_ago FROM i",
    ind_cte("i", ["prev_high", "close_diff", "sma_200"])))
def q_ind_lag_diff(spark, sf):
    df = I.add_indicators(bars(spark, sf), [I.prev_high(), I.diff("close"), I.sma_200_1m_ago()])
    return r4(df.select("symbol", "date", "prev_high", "close_diff", "sma_200_1m_ago"), "sma_200_1m_ago")


EWM_LATEST = P.Predicate("ewm_latest", (I.ema(20), I.rsi(14), I.atr(14)), lambda: F.lit(True))


@register("scan_latest_ewm", with_bars(
    "SELECT b.symbol, b.date, b.close, (round((em.y) * 10000) / 10000 + 0.0) AS ema_20, "
    "(round((rsi.rsi) * 10000) / 10000 + 0.0) AS rsi_14, (round((a.y) * 10000) / 10000 + 0.0) AS atr_14 "
    f"FROM (SELECT *, {LATEST} FROM bars) b "
    "JOIN e ON e.symbol = b.symbol AND e.date = b.date JOIN em_rec em ON em.symbol = e.symbol AND em.i = e.i "
    "JOIN rsi ON rsi.symbol = b.symbol AND rsi.date = b.date "
    "JOIN n ON n.symbol = b.symbol AND n.date = b.date JOIN a_rec a ON a.symbol = n.symbol AND a.i = n.i "
    "WHERE b.rn = 1",
    *rsi_sql_ctes(14), numbered("e", "close"), *ewm_ctes(2.0 / 21.0, "e", "em"),
    numbered("n", TR_SQL), *ewm_ctes(1.0 / 14.0, "n", "a"), recursive=True))
def q_scan_latest_ewm(spark, sf):
    """EMA / RSI / ATR on the latest bar (snapshot plan: decay-weighted sums over the tail)."""
    df = scan(bars(spark, sf), [EWM_LATEST])
    return r4(df.select("symbol", "date", "close", "ema_20", "rsi_14", "atr_14"), "ema_20", "rsi_14", "atr_14")


# ---------------------------------------------------------------------------
# Resampling and chart data (A4, A5, R-D, R-I, R-P, R-M, P3, I12)
# ---------------------------------------------------------------------------

def fold_sql(bucket: str, src: str = "bars", t: str = "date") -> str:
    return (f"SELECT symbol, {bucket} AS {t}, arg_min(open, {t}) AS open, max(high) AS high, "
            f"min(low) AS low, arg_max(close, {t}) AS close, "
            f"CAST(coalesce(sum(volume), 0) AS BIGINT) AS volume FROM {src} GROUP BY 1, 2")


@register("resample_1d", with_bars(fold_sql("date")))
def q_resample_1d(spark, sf):
    return R.resample_daily(bars(spark, sf), "1d")


@register("resample_week", with_bars(fold_sql("CAST(date_trunc('week', date) AS DATE)")))
def q_resample_week(spark, sf):
    return R.resample_daily(bars(spark, sf), "1w")


@register("resample_2w", with_bars(fold_sql(
    "CAST(DATE '1970-01-05' + CAST(floor((date - DATE '1970-01-05') / 14) * 14 AS INTEGER) AS DATE)")))
def q_resample_2w(spark, sf):
    return R.resample_daily(bars(spark, sf), "2w")


@register("resample_month", with_bars(fold_sql("CAST(date_trunc('month', date) AS DATE)")))
def q_resample_month(spark, sf):
    return R.resample_daily(bars(spark, sf), "1mo")


@register("resample_quarter", with_bars(fold_sql("CAST(date_trunc('quarter', date) AS DATE)")))
def q_resample_quarter(spark, sf):
    return R.resample_daily(bars(spark, sf), "3mo")


@register("resample_intraday",
          f"WITH ticks AS ({TICKS_SQL}) SELECT symbol, time_bucket(INTERVAL '15 minutes', ts) AS ts, "
          "arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, "
          "CAST(sum(size) AS BIGINT) AS volume FROM ticks GROUP BY 1, 2")
def q_resample_intraday(spark, sf):
    return R.ticks_to_bars(ticks_from_events(spark, sf), "15 minutes")


@register("resample_hourly_by_type",
          "SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, "
          "arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, "
          "CAST(count(*) AS BIGINT) AS volume FROM events GROUP BY 1, 2")
def q_resample_hourly_by_type(spark, sf):
    t = (spark.read.parquet(f"{sf.rstrip('/')}/events.parquet")
         .select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"),
                 F.lit(1).cast("bigint").alias("size")))
    return R.ticks_to_bars(t, "1 hour")


MAXD = "mx AS (SELECT symbol, max(date) AS m FROM bars GROUP BY 1)"


@register("period_filter", with_bars(
    f"SELECT {BASE_SQL} FROM bars JOIN mx USING (symbol) WHERE date >= CAST(m - INTERVAL 180 DAY AS DATE)", MAXD))
def q_period_filter(spark, sf):
    return R.period_filter(bars(spark, sf), "6mo").select(*BASE)


@register("chart_data", with_bars(
    "SELECT symbol, CAST(date_trunc('week', date) AS TIMESTAMP) AS time, arg_min(open, date) AS open, "
    "max(high) AS high, min(low) AS low, arg_max(close, date) AS close, "
    "CAST(coalesce(sum(volume), 0) AS BIGINT) AS volume "
    "FROM bars JOIN mx USING (symbol) WHERE date >= CAST(m - INTERVAL 365 DAY AS DATE) GROUP BY 1, 2", MAXD))
def q_chart_data(spark, sf):
    return R.chart_bars(bars(spark, sf), resample="1w", period="1y")


@register("overlay_sma", with_bars(
    "SELECT symbol, CAST(date AS TIMESTAMP) AS time, series, (round((value) * 10000) / 10000 + 0.0) AS value FROM ("
    "SELECT symbol, date, 'sma_50' AS series, sma_50 AS value, n FROM o UNION ALL "
    "SELECT symbol, date, 'sma_200', sma_200, n FROM o) "
    "WHERE value IS NOT NULL AND n > CAST(substr(series, 5) AS INTEGER)",
    MAXD, "p AS (SELECT bars.* FROM bars JOIN mx USING (symbol) WHERE date >= CAST(m - INTERVAL 730 DAY AS DATE))",
    ind_cte("o", ["sma_50", "sma_200"], src="p", extra=", count(*) OVER (PARTITION BY symbol) AS n")))
def q_overlay_sma(spark, sf):
    return r4(R.overlay_sma(bars(spark, sf), resample="1d", period="2y"), "value")


# ---------------------------------------------------------------------------
# Liquidity (A2, A3)
# ---------------------------------------------------------------------------

DV_SQL = ("dv AS (SELECT symbol, coalesce(sum(CASE WHEN date >= m - 60 THEN close * CAST(volume AS DOUBLE) END), "
          "0.0) AS dollar_volume FROM bars JOIN mx USING (symbol) GROUP BY 1)")
DV_OUT = "(round(dollar_volume * 100) / 100 + 0.0) AS dollar_volume"


def dv2(df: DataFrame) -> DataFrame:
    # sums of doubles depend on their order in the last digits
    return df.withColumn("dollar_volume", round_to(F.col("dollar_volume"), 2))


@register("dollar_volume", with_bars(
    f"SELECT symbol, {DV_OUT} FROM dv", MAXD, DV_SQL))
def q_dollar_volume(spark, sf):
    return dv2(L.dollar_volume(bars(spark, sf)))


LIQ_THRESHOLD = 1_500_000.0


@register("liquidity_flag", with_bars(
    f"SELECT symbol, {DV_OUT}, dollar_volume >= 1500000 AS eligible FROM dv", MAXD, DV_SQL))
def q_liquidity_flag(spark, sf):
    return dv2(L.liquidity(bars(spark, sf), LIQ_THRESHOLD))


@register("eligible_count", with_bars(
    "SELECT count(*) AS n_symbols, count(*) FILTER (WHERE dollar_volume >= 1500000) AS n_eligible FROM dv",
    MAXD, DV_SQL))
def q_eligible_count(spark, sf):
    return L.eligible_count(bars(spark, sf), LIQ_THRESHOLD)


# ---------------------------------------------------------------------------
# Store surface
# ---------------------------------------------------------------------------

# more names than there are symbols, so some are stored and some are not
REQUESTED_SQL = "req AS (SELECT 'S' || c_custkey AS symbol FROM customer)"


def requested(spark, sf):
    names = spark.read.parquet(f"{sf.rstrip('/')}/customer.parquet")
    return names.select(F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("symbol"))


@register("symbol_list", with_bars("SELECT DISTINCT symbol FROM bars"))
def q_symbol_list(spark, sf):
    return S.list_symbols(bars(spark, sf))


@register("symbol_head", with_bars(
    f"SELECT {BASE_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM bars) "
    "WHERE k <= 10"))
def q_symbol_head(spark, sf):
    return S.head_each(bars(spark, sf), 10)


@register("symbols_semi", with_bars("SELECT symbol FROM req WHERE symbol IN (SELECT symbol FROM bars)", REQUESTED_SQL))
def q_symbols_semi(spark, sf):
    return S.symbols_present(requested(spark, sf), bars(spark, sf))


@register("symbols_anti", with_bars(
    "SELECT symbol FROM req WHERE symbol NOT IN (SELECT symbol FROM bars)", REQUESTED_SQL))
def q_symbols_anti(spark, sf):
    return S.symbols_missing(requested(spark, sf), bars(spark, sf))


# ---------------------------------------------------------------------------
# Batch scan (R2)
# ---------------------------------------------------------------------------

RECIPES = [
    ("momentum", ScanSpec(min_price=1000.0, min_relative_volume=1.2)),
    ("volatile", ScanSpec(min_adr=3.0, min_volume=20.0)),
    ("gappers", ScanSpec(gap_up=2.0)),
    ("quiet_large", ScanSpec(min_price=1500.0, min_relative_volume=0.0)),
    ("trend", ScanSpec(trend_template=True)),
]


def _batch_sql(body: str | None = None) -> str:
    conds = {
        "momentum": "close >= 1000.0 AND rvol_20 >= 1.2",
        "volatile": "adr_20 >= 3.0 AND volume >= 20.0",
        "gappers": "open > prev_high * 1.02",
        "quiet_large": "close >= 1500.0 AND rvol_20 >= 0.0",
        "trend": TREND_COND,
    }
    unions = " UNION ALL ".join(
        f"SELECT '{name}' AS recipe, symbol, date, close, volume FROM s WHERE {c}" for name, c in conds.items())
    return with_bars(
        body or unions,
        ind_cte("t0", TREND_COLS + ["avg_volume_20", "adr_20", "prev_high"], extra=f", {LATEST}"),
        "s AS (SELECT *, volume / avg_volume_20 AS rvol_20, "
        "lag(sma_200, 20) OVER (PARTITION BY symbol ORDER BY date) AS sma_200_1m_ago FROM t0 QUALIFY rn = 1)")


@register("batch_scan", None)
def q_batch_scan(spark, sf):
    return batch_scan(bars(spark, sf), RECIPES)


ORACLE["batch_scan"] = _batch_sql()

RECIPE_TABLE_SQL = """
SELECT 'R' || o_orderkey AS recipe,
       CASE WHEN o_orderkey % 10 <> 0 THEN 1700 + o_totalprice % 500 END AS min_price,
       CASE WHEN o_custkey % 5 = 0 THEN 30 + o_totalprice % 20 END AS min_volume,
       CASE WHEN o_orderkey % 9 <> 0 THEN 1.5 + (o_totalprice % 100) / 100 END AS min_relative_volume,
       CASE WHEN o_custkey % 7 = 0 THEN o_totalprice % 11 END AS min_adr,
       CASE WHEN o_custkey % 3 = 0 OR o_orderkey % 90 = 0 THEN 10 + o_totalprice % 50 END AS gap_up,
       o_orderkey % 50 = 0 AS trend_template
FROM orders
"""


def recipe_table(spark, sf) -> DataFrame:
    """A recipe of every order, its criteria set by the order's keys and price."""
    rest = lambda n: F.col("o_totalprice") % n
    every = lambda key, n: F.col(key) % n == 0
    return table(spark, sf, "orders").select(
        F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("recipe"),
        F.when(~every("o_orderkey", 10), 1700 + rest(500)).alias("min_price"),
        F.when(every("o_custkey", 5), 30 + rest(20)).alias("min_volume"),
        F.when(~every("o_orderkey", 9), 1.5 + rest(100) / 100).alias("min_relative_volume"),
        F.when(every("o_custkey", 7), rest(11)).alias("min_adr"),
        F.when(every("o_custkey", 3) | every("o_orderkey", 90), 10 + rest(50)).alias("gap_up"),
        every("o_orderkey", 50).alias("trend_template"))


@register("batch_scan_table", _batch_sql(f"""
    SELECT recipe, symbol, date, close, volume FROM s JOIN ({RECIPE_TABLE_SQL}) r ON
    (min_price IS NULL OR close >= min_price) AND (min_volume IS NULL OR volume >= min_volume)
    AND (min_relative_volume IS NULL OR rvol_20 >= min_relative_volume) AND (min_adr IS NULL OR adr_20 >= min_adr)
    AND (gap_up IS NULL OR open > prev_high * (1.0 + gap_up / 100.0)) AND (NOT trend_template OR ({TREND_COND}))"""))
def q_batch_scan_table(spark, sf):
    """R2 with the recipes as a table: one of every order."""
    return batch_scan_table(bars(spark, sf), recipe_table(spark, sf))


# ---------------------------------------------------------------------------
# T2 screens (P-BO, P-ID, P-NR, P-DS, P-VS, P-RO, P-BB, P-CB)
# ---------------------------------------------------------------------------

def prev_sql(agg: str, expr: str, n: int) -> str:
    f = f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({expr}) OVER {f} = {n} THEN {agg}({expr}) OVER {f} END"


IND_SQL.update({
    "prior_high_20": prev_sql("max", "high", 20),
    "prior_high_10": prev_sql("max", "high", 10),
    "prior_high_50": prev_sql("max", "high", 50),
    "range_min_7": roll_sql("min", "(high - low)", 7),
    "prev_low": f"lag(low) OVER {WS}",
    "volume_lag1": f"lag(volume) OVER {WS}",
    "volume_lag2": f"lag(volume, 2) OVER {WS}",
    "high_20": roll_sql("max", "high", 20),
    "avg_volume_50": roll_sql("avg", "volume", 50),
})


def history(screen, spark, sf) -> DataFrame:
    return scan(bars(spark, sf), [screen], history=True)


def trending_history(screen, spark, sf) -> DataFrame:
    return scan(trending_bars_from_lineitem(spark, sf), [screen], history=True)


@register("breakout_n", with_bars(
    "SELECT symbol, date, close, prior_high_20 FROM i WHERE close > prior_high_20", ind_cte("i", ["prior_high_20"])))
def q_breakout_n(spark, sf):
    return history(SC.breakout(20), spark, sf).select("symbol", "date", "close", "prior_high_20")


@register("inside_day", with_bars(
    "SELECT symbol, date, high, low, prev_high, prev_low FROM i WHERE high < prev_high AND low > prev_low",
    ind_cte("i", ["prev_high", "prev_low"])))
def q_inside_day(spark, sf):
    return history(SC.inside_day(), spark, sf).select("symbol", "date", "high", "low", "prev_high", "prev_low")


@register("nr7", with_bars(
    "SELECT symbol, date, range_min_7 FROM i WHERE high - low = range_min_7", ind_cte("i", ["range_min_7"])))
def q_nr7(spark, sf):
    return history(SC.nr7(), spark, sf).select("symbol", "date", "range_min_7")


@register("dist_sma", with_bars(
    "SELECT symbol, date, (round(((close - sma_20) / sma_20 * 100) * 10000) / 10000 + 0.0) AS dist_sma_20, "
    "(round(((close - sma_50) / sma_50 * 100) * 10000) / 10000 + 0.0) AS dist_sma_50 FROM i",
    ind_cte("i", ["sma_20", "sma_50"])))
def q_dist_sma(spark, sf):
    df = SC.distance_from_sma(bars(spark, sf), (20, 50))
    return r4(df.select("symbol", "date", "dist_sma_20", "dist_sma_50"), "dist_sma_20", "dist_sma_50")


@register("vol_squeeze", with_bars(
    "SELECT symbol, date, (round((adr_20) * 10000) / 10000 + 0.0) AS adr_20 FROM i WHERE "
    "(high - low = range_min_7 OR (high < prev_high AND low > prev_low)) AND adr_20 > 3 "
    "AND volume < volume_lag1 AND volume_lag1 < volume_lag2",
    ind_cte("i", ["range_min_7", "prev_high", "prev_low", "volume_lag1", "volume_lag2", "adr_20"])))
def q_vol_squeeze(spark, sf):
    return r4(history(SC.volatility_squeeze(), spark, sf).select("symbol", "date", "adr_20"), "adr_20")


def rsi_named_ctes(period: int, tag: str) -> list[str]:
    a = 1.0 / period
    return [
        f"g{tag} AS (SELECT symbol, date, coalesce({RSI_GAIN}, 0) AS x, "
        "row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i FROM bars)",
        f"l{tag} AS (SELECT symbol, date, coalesce({RSI_LOSS}, 0) AS x, "
        "row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i FROM bars)",
        *ewm_ctes(a, f"g{tag}", f"gg{tag}"), *ewm_ctes(a, f"l{tag}", f"ll{tag}"),
        f"rsi{tag} AS (SELECT g.symbol, g.date, CASE WHEN ll.y = 0 THEN CASE WHEN gg.y = 0 THEN 'NaN'::DOUBLE "
        f"ELSE 100.0 END ELSE 100.0 - 100.0 / (1.0 + gg.y / ll.y) END AS rsi "
        f"FROM g{tag} g JOIN gg{tag}_rec gg ON gg.symbol = g.symbol AND gg.i = g.i "
        f"JOIN ll{tag}_rec ll ON ll.symbol = g.symbol AND ll.i = g.i)",
    ]


@register("rsi_oversold", trending(
    "SELECT i.symbol, i.date, (round((sma_200) * 10000) / 10000 + 0.0) AS sma_200, "
    "(round((a.rsi) * 10000) / 10000 + 0.0) AS rsi_14, (round((b.rsi) * 10000) / 10000 + 0.0) AS rsi_2 "
    "FROM i JOIN rsi14 a USING (symbol, date) JOIN rsi2 b USING (symbol, date) "
    "WHERE close > sma_200 AND (a.rsi < 30 OR b.rsi < 10)",
    *rsi_named_ctes(14, "14"), *rsi_named_ctes(2, "2"), ind_cte("i", ["sma_200"]), recursive=True))
def q_rsi_oversold(spark, sf):
    df = trending_history(SC.rsi_oversold(), spark, sf).select("symbol", "date", "sma_200", "rsi_14", "rsi_2")
    return r4(df, "sma_200", "rsi_14", "rsi_2")


@register("bollinger_snapback", trending(
    "SELECT i.symbol, i.date, (round((sma_20) * 10000) / 10000 + 0.0) AS sma_20, "
    "(round((std_20) * 10000) / 10000 + 0.0) AS std_20, (round((a.rsi) * 10000) / 10000 + 0.0) AS rsi_14 "
    "FROM i JOIN rsi14 a USING (symbol, date) WHERE close < sma_20 - 2 * std_20 AND a.rsi < 30",
    *rsi_named_ctes(14, "14"), ind_cte("i", ["sma_20", "std_20"]), recursive=True))
def q_bollinger_snapback(spark, sf):
    df = trending_history(SC.bollinger_snapback(), spark, sf).select("symbol", "date", "sma_20", "std_20", "rsi_14")
    return r4(df, "sma_20", "std_20", "rsi_14")


def atr_named_ctes(period: int) -> list[str]:
    return [numbered(f"tr{period}", TR_SQL), *ewm_ctes(1.0 / period, f"tr{period}", f"atr{period}"),
            f"atr{period} AS (SELECT n.symbol, n.date, r.y AS atr FROM tr{period} n JOIN atr{period}_rec r "
            f"ON r.symbol = n.symbol AND r.i = n.i)"]


@register("consolidation_breakout", trending(
    "SELECT t.symbol, t.date FROM t JOIN atr5 a USING (symbol, date) JOIN atr20 b USING (symbol, date) "
    f"WHERE {TREND_COND} AND close >= 0.95 * high_20 AND a.atr < b.atr AND volume < avg_volume_50",
    *atr_named_ctes(5), *atr_named_ctes(20),
    ind_cte("t0", TREND_COLS + ["high_20", "avg_volume_50"], extra=f", {LATEST}"), TREND_CTE2, recursive=True))
def q_consolidation_breakout(spark, sf):
    return trending_history(SC.consolidation_breakout(), spark, sf).select("symbol", "date")


# ---------------------------------------------------------------------------
# T2 strategy tables (P-SIG, P-RS, P-REG, P-PM, P-SW)
# ---------------------------------------------------------------------------

BENCHMARK = "S1"


@register("signals_next_bar", with_bars(
    "SELECT symbol, signal_date, entry_date, entry, (round((stop) * 10000) / 10000 + 0.0) AS stop, size, "
    "(round((rvol_20) * 10000) / 10000 + 0.0) AS rvol_20, "
    "rank() OVER (PARTITION BY signal_date ORDER BY rvol_20 DESC NULLS LAST, symbol) AS rank FROM ("
    "SELECT symbol, lag(date) OVER w AS signal_date, date AS entry_date, open AS entry, "
    "lag(close) OVER w - 2.0 * lag(atr) OVER w AS stop, "
    "CAST(floor(1000.0 / (lag(close) OVER w - (lag(close) OVER w - 2.0 * lag(atr) OVER w))) AS BIGINT) AS size, "
    "lag(volume / avg_volume_20) OVER w AS rvol_20 "
    "FROM i JOIN atr14 USING (symbol, date) WINDOW w AS (PARTITION BY symbol ORDER BY date) "
    "QUALIFY lag(close > prior_high_20) OVER w "
    "UNION ALL SELECT symbol, date, NULL, NULL, close - 2.0 * atr, "
    "CAST(floor(1000.0 / (close - (close - 2.0 * atr))) AS BIGINT), volume / avg_volume_20 "
    "FROM i JOIN atr14 USING (symbol, date) WHERE rn = 1 AND close > prior_high_20)",
    *atr_named_ctes(14), ind_cte("i", ["prior_high_20", "avg_volume_20"], extra=f", {LATEST}"), recursive=True))
def q_signals_next_bar(spark, sf):
    df = ST.next_bar_signals(bars(spark, sf))
    return r4(df, "stop", "rvol_20")


@register("relative_strength", with_bars(
    "SELECT symbol, date, (round((ret_20) * 10000) / 10000 + 0.0) AS ret_20, "
    "(round((bench_ret_20) * 10000) / 10000 + 0.0) AS bench_ret_20, (round((rs) * 10000) / 10000 + 0.0) AS rs, "
    "CASE WHEN rs IS NOT NULL THEN (round((percent_rank() OVER (PARTITION BY date, rs IS NULL ORDER BY rs)) * 10000)"
    " / 10000 + 0.0) END AS rs_rank FROM ("
    "SELECT r.symbol, r.date, r.ret_20, b.ret_20 AS bench_ret_20, (1.0 + r.ret_20) / (1.0 + b.ret_20) AS rs "
    f"FROM r LEFT JOIN (SELECT date, ret_20 FROM r WHERE symbol = '{BENCHMARK}') b USING (date))",
    "r AS (SELECT * FROM (SELECT symbol, date, close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY date) - 1.0"
    " AS ret_20 FROM bars) WHERE ret_20 IS NOT NULL)"))
def q_relative_strength(spark, sf):
    df = ST.relative_strength(bars(spark, sf), BENCHMARK, 20)
    return r4(df, "ret_20", "bench_ret_20", "rs", "rs_rank")


HELD_SQL = f"bars AS (SELECT * FROM ({BARS_SQL}) WHERE symbol <> '{BENCHMARK}' OR (date - DATE '1970-01-01') % 5 <> 0)"


@register("relative_strength_asof", ORACLE["relative_strength"].replace(f"bars AS ({BARS_SQL})", HELD_SQL, 1).replace(
    "FROM r LEFT JOIN (SELECT date, ret_20 FROM r WHERE symbol = 'S1') b USING (date)",
    "FROM r ASOF LEFT JOIN (SELECT date, ret_20 FROM r WHERE symbol = 'S1') b ON r.date >= b.date"))
def q_relative_strength_asof(spark, sf):
    """The benchmark has no bar on every fifth day: its last return counts."""
    held = bars(spark, sf).where((F.col("symbol") != BENCHMARK) | (F.unix_date("date") % 5 != 0))
    df = ST.relative_strength(held, BENCHMARK, 20, as_of=True)
    return r4(df, "ret_20", "bench_ret_20", "rs", "rs_rank")


@register("regime", with_bars(
    "SELECT date, (round((pct) * 10000) / 10000 + 0.0) AS atr_percentile, regime, CASE regime WHEN 'trend_on' THEN 1.0 "
    "WHEN 'trend_caution' THEN 0.5 WHEN 'trend_off' THEN 0.0 END::DOUBLE AS gate FROM ("
    "SELECT date, pct, CASE WHEN sma_200 IS NULL OR pct IS NULL THEN 'unknown' WHEN close <= sma_200 THEN 'trend_off' "
    "WHEN pct > 0.8 THEN 'trend_caution' ELSE 'trend_on' END AS regime FROM (SELECT *, CASE WHEN len(year) = 252 THEN "
    "len(list_filter(year, lambda x: x <= vol)) / 252.0 END AS pct FROM (SELECT *, list(vol) OVER "
    "(ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS year FROM (SELECT i.*, atr / close AS vol "
    f"FROM i JOIN atr14 USING (symbol, date) WHERE symbol = '{BENCHMARK}'))))",
    *atr_named_ctes(14), ind_cte("i", ["sma_200"]), recursive=True))
def q_regime(spark, sf):
    return r4(ST.regime(bars(spark, sf), BENCHMARK), "atr_percentile")


TRADES_SQL = ("tr AS (SELECT 'breakout_20_h5' AS strategy, symbol, entry_date, date AS exit_date, "
              "close / entry - 1.0 AS ret FROM (SELECT *, lag(close > prior_high_20, 5) OVER w AS fired, "
              "lag(open, 4) OVER w AS entry, lag(date, 4) OVER w AS entry_date FROM i "
              "WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE fired)")


@register("atr_percentile", with_bars(
    "SELECT symbol, date, (round((CASE WHEN len(year) = 252 THEN len(list_filter(year, lambda x: x <= vol)) / 252.0 END) "
    "* 10000) / 10000 + 0.0) AS atr_percentile FROM (SELECT *, list(vol) OVER (PARTITION BY symbol ORDER BY date "
    "ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS year FROM (SELECT b.symbol, b.date, atr / close AS vol "
    "FROM bars b JOIN atr14 USING (symbol, date)))", *atr_named_ctes(14), recursive=True))
def q_atr_percentile(spark, sf):
    """P-REG's measure for every symbol."""
    return r4(ST.atr_percentile(bars(spark, sf)), "atr_percentile")


@register("perf_metrics", with_bars(
    "SELECT s.strategy, n_trades, (round((win_rate) * 10000) / 10000 + 0.0) AS win_rate, "
    "(round((expectancy) * 10000) / 10000 + 0.0) AS expectancy, "
    "(round((exp(total_lr) - 1.0) * 10000) / 10000 + 0.0) AS total_return, "
    "(round((exp(total_lr / greatest(date_diff('day', first_d, last_d) / 365.25, 1.0 / 365.25)) - 1.0) * 10000)"
    " / 10000 + 0.0) AS cagr, (round((max_drawdown) * 10000) / 10000 + 0.0) AS max_drawdown FROM "
    "(SELECT strategy, count(*) AS n_trades, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, "
    "avg(ret) AS expectancy FROM tr GROUP BY 1) s JOIN "
    "(SELECT strategy, min(dd) AS max_drawdown, sum(lr) AS total_lr, min(exit_date) AS first_d, "
    "max(exit_date) AS last_d FROM (SELECT *, exp(cum - greatest(0.0, max(cum) OVER w)) - 1.0 AS dd FROM "
    "(SELECT *, sum(lr) OVER w AS cum FROM (SELECT strategy, exit_date, sum(ln(1.0 + ret)) AS lr FROM tr "
    "GROUP BY 1, 2) WINDOW w AS (PARTITION BY strategy ORDER BY exit_date ROWS BETWEEN UNBOUNDED PRECEDING "
    "AND CURRENT ROW)) WINDOW w AS (PARTITION BY strategy ORDER BY exit_date ROWS BETWEEN UNBOUNDED PRECEDING "
    "AND CURRENT ROW)) GROUP BY 1) d USING (strategy)",
    ind_cte("i", ["prior_high_20"]), TRADES_SQL))
def q_perf_metrics(spark, sf):
    df = ST.performance(ST.forward_trades(bars(spark, sf), horizons=(5,), n=20))
    return r4(df, "win_rate", "expectancy", "total_return", "cagr", "max_drawdown")


@register("equity_metrics", with_bars(
    "SELECT strategy, count(*) AS n_points, (round((avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END)) "
    "* 10000) / 10000 + 0.0) AS win_rate, (round((avg(ret)) * 10000) / 10000 + 0.0) AS expectancy, "
    "(round((arg_max(equity, date) / arg_min(equity, date) - 1.0) * 10000) / 10000 + 0.0) AS total_return, "
    "(round((pow(arg_max(equity, date) / arg_min(equity, date), 1.0 / greatest(date_diff('day', min(date), max(date)) "
    "/ 365.25, 1.0 / 365.25)) - 1.0) * 10000) / 10000 + 0.0) AS cagr, "
    "(round((min(equity / top - 1.0)) * 10000) / 10000 + 0.0) AS max_drawdown FROM ("
    "SELECT symbol AS strategy, date, close AS equity, close / lag(close) OVER w - 1.0 AS ret, max(close) OVER "
    "(PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top "
    "FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)) GROUP BY 1"))
def q_equity_metrics(spark, sf):
    """P-PM over a table of equity curves: every symbol bought and held."""
    curves = bars(spark, sf).select(F.col("symbol").alias("strategy"), "date", F.col("close").alias("equity"))
    return r4(ST.equity_metrics(curves), "win_rate", "expectancy", "total_return", "cagr", "max_drawdown")


@register("walk_forward", with_bars(
    "SELECT fold, DATE '1992-01-01' + CAST(fold * 182 + 730 AS INTEGER) AS test_start, param, n_train, "
    "(round((train_ret) * 10000) / 10000 + 0.0) AS train_ret, n_test, (round((test_ret) * 10000) / 10000 + 0.0) AS test_ret, "
    "(round((test_hit_rate) * 10000) / 10000 + 0.0) AS test_hit_rate FROM ("
    "SELECT fold, param, count(*) FILTER (train) AS n_train, avg(fwd) FILTER (train) AS train_ret, "
    "count(*) FILTER (test) AS n_test, avg(fwd) FILTER (test) AS test_ret, "
    "avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END) FILTER (test) AS test_hit_rate FROM ("
    "SELECT f.fold, s.param, s.fwd, s.d < f.fold * 182 + 730 AND s.e < f.fold * 182 + 730 AS train, "
    "s.d >= f.fold * 182 + 730 AS test FROM sig s JOIN (SELECT unnest(range(200)) AS fold) f "
    "ON s.d >= f.fold * 182 AND s.d < f.fold * 182 + 912) GROUP BY 1, 2) WHERE n_train > 0 "
    "QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(train_ret, 9) DESC, param) = 1",
    ind_cte("i", ["prior_high_10", "prior_high_20", "prior_high_50"]),
    "sig AS (SELECT p.param, date_diff('day', DATE '1992-01-01', sig_date) AS d, date_diff('day', DATE '1992-01-01', date)"
    " AS e, fwd FROM (SELECT *, lag(close > prior_high_10, 5) OVER w AS s10, lag(close > prior_high_20, 5) OVER w AS s20, "
    "lag(close > prior_high_50, 5) OVER w AS s50, close / lag(close, 5) OVER w - 1.0 AS fwd, "
    "lag(date, 5) OVER w AS sig_date FROM i WINDOW w AS (PARTITION BY symbol ORDER BY date)) x "
    "JOIN (SELECT 10 AS param UNION ALL SELECT 20 UNION ALL SELECT 50) p "
    "ON (p.param = 10 AND s10) OR (p.param = 20 AND s20) OR (p.param = 50 AND s50))"))
def q_walk_forward(spark, sf):
    """P-SW by overlapping folds of two years and half a year."""
    return r4(ST.walk_forward(bars(spark, sf)), "train_ret", "test_ret", "test_hit_rate")


@register("param_sweep", with_bars(
    "SELECT param, split, count(*) AS n_signals, (round((avg(fwd)) * 10000) / 10000 + 0.0) AS avg_fwd_ret, "
    "(round((avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END)) * 10000) / 10000 + 0.0) AS hit_rate FROM ("
    "SELECT p.param, CASE WHEN sig_date < DATE '1999-01-01' THEN 'in_sample' ELSE 'out_of_sample' END AS split, "
    "fwd FROM (SELECT *, lag(close > prior_high_10, 5) OVER w AS s10, lag(close > prior_high_20, 5) OVER w AS s20, "
    "lag(close > prior_high_50, 5) OVER w AS s50, close / lag(close, 5) OVER w - 1.0 AS fwd, "
    "lag(date, 5) OVER w AS sig_date FROM i WINDOW w AS (PARTITION BY symbol ORDER BY date)) x "
    "JOIN (SELECT 10 AS param UNION ALL SELECT 20 UNION ALL SELECT 50) p "
    "ON (p.param = 10 AND s10) OR (p.param = 20 AND s20) OR (p.param = 50 AND s50)) GROUP BY 1, 2",
    ind_cte("i", ["prior_high_10", "prior_high_20", "prior_high_50"])))
def q_param_sweep(spark, sf):
    return r4(ST.param_sweep(bars(spark, sf), (10, 20, 50), 5, "1999-01-01"), "avg_fwd_ret", "hit_rate")


# ---------------------------------------------------------------------------
# Data quality (Q1-Q3)
# ---------------------------------------------------------------------------

@register("dq_stale", with_bars(
    "SELECT symbol, last_date, date_diff('day', last_date, (SELECT max(date) FROM bars)) AS days_behind FROM "
    "(SELECT symbol, max(date) AS last_date FROM bars GROUP BY 1) "
    "WHERE date_diff('day', last_date, (SELECT max(date) FROM bars)) > 3"))
def q_dq_stale(spark, sf):
    df = Q.stale_symbols(bars(spark, sf), 3)
    return df.withColumn("days_behind", F.col("days_behind").cast("bigint"))


@register("dq_duplicates",
          "SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem "
          "GROUP BY 1, 2 HAVING count(*) > 1")
def q_dq_duplicates(spark, sf):
    li = spark.read.parquet(f"{sf.rstrip('/')}/lineitem.parquet")
    trades = li.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
                       F.col("l_shipdate").cast("date").alias("date"))
    return Q.duplicate_bars(trades)


@register("dq_missing", with_bars(
    "SELECT s.symbol, m.date FROM (SELECT symbol, min(date) AS f, max(date) AS l FROM bars GROUP BY 1) s "
    "JOIN (SELECT DISTINCT date FROM bars) m ON m.date BETWEEN s.f AND s.l "
    "WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = s.symbol AND b.date = m.date)"))
def q_dq_missing(spark, sf):
    return Q.missing_bars(bars(spark, sf))


# ---------------------------------------------------------------------------
# Store round trips (S1, S3, S4, Q4), landing files (S7, R3), as-of, recipes, O3, X6
# ---------------------------------------------------------------------------

@register("store_roundtrip", with_bars(f"SELECT {BASE_SQL} FROM bars"))
def q_store_roundtrip(spark, sf):
    """Saved under lower-case names, read back."""
    path = scratch_folder(spark, "store")
    S.save_bars(bars(spark, sf).withColumn("symbol", F.lower("symbol")), path)
    return S.read_bars(spark, path)


@register("store_overwrite", with_bars(
    "SELECT symbol, date, open, high, low, close, CASE WHEN CAST(substr(symbol, 2) AS BIGINT) % 3 = 0 "
    "THEN volume + 1 ELSE volume END AS volume FROM bars "
    "WHERE CAST(substr(symbol, 2) AS BIGINT) % 3 <> 0 OR date >= DATE '1995-01-01'"))
def q_store_overwrite(spark, sf):
    """A second save replaces the whole history of the symbols in it, and no other's."""
    path, all_bars = scratch_folder(spark, "store"), bars(spark, sf)
    S.save_bars(all_bars, path, buckets=8)
    third = (F.substring("symbol", 2, 18).cast("bigint") % 3 == 0) & (F.col("date") >= F.to_date(F.lit("1995-01-01")))
    S.save_bars(all_bars.where(third).withColumn("volume", F.col("volume") + 1), path)
    return S.read_bars(spark, path)


@register("timeframe_roundtrip", f"SELECT 'tick' AS timeframe, symbol, ts, price AS open, price AS high, price AS low, "
          f"price AS close, size AS volume FROM ({TICKS_SQL}) UNION ALL SELECT '15min', * FROM ({ORACLE['resample_intraday']})")
def q_timeframe_roundtrip(spark, sf):
    """Intraday bars keep their time, and the timeframes of a store stay apart."""
    path, ticks = scratch_folder(spark, "store"), intraday_bars_from_events(spark, sf)
    S.save_bars(ticks, path, buckets=8, timeframe="tick")
    S.save_bars(R.resample_intraday(ticks, "15 minutes"), path, timeframe="15min")
    both = [S.read_timeframe(spark, path, t).withColumn("timeframe", F.lit(t)) for t in ("tick", "15min")]
    return both[0].unionByName(both[1])


def one_file_each(df: DataFrame, path: str, suffix: str, header: str | None = None) -> str:
    """Write the rows of every ``file``, which come together in their partition, as ``<file><suffix>``."""
    write_files(df, path, suffix, header)
    return path


PRICES = ("close", "low", "high", "open")


def landing_folder(spark, sf, path=None, where=None, note=("note",), text="x") -> str:
    """The bars as one CSV file per symbol with a quoted header, and a bad number in every tenth symbol.

    The columns ``note`` stand before ``volume``; the last of them holds ``text``."""
    path = path or scratch_folder(spark, "landing")
    named = bars(spark, sf).withColumn("file", F.col("symbol"))
    if where is not None:
        named = named.where(where)
    bad = (F.substring("symbol", 2, 18).cast("bigint") % 10 == 0) & (F.col("date") < F.to_date(F.lit("1992-03-01")))
    header = ",".join(f'"{c}"' for c in ("date", *PRICES, *note, "volume"))
    # the lines are made behind the exchange, which moves the bars alone
    together = named.repartition("file").sortWithinPartitions("file")
    lines = together.select("file", F.concat_ws(
        ",", F.concat(F.lit('"'), F.col("date").cast("string"), F.lit('"')),
        *[F.when(bad & F.lit(c == "low"), "n/a").otherwise(F.col(c).cast("string")) for c in PRICES],
        *[F.lit("x") for _ in note[1:]], F.lit(text), F.col("volume").cast("string")).alias("value"))
    return one_file_each(lines, path, ".csv", header)


BAD_SYMBOLS = "bad AS (SELECT DISTINCT symbol FROM bars WHERE CAST(substr(symbol, 2) AS BIGINT) % 10 = 0 " \
              "AND date < DATE '1992-03-01')"


@register("landing_bars", with_bars(
    f"SELECT {BASE_SQL} FROM bars WHERE symbol NOT IN (SELECT symbol FROM bad)", BAD_SYMBOLS))
def q_landing_bars(spark, sf):
    return IN.landing_bars(spark, landing_folder(spark, sf))[0]


@register("symbols_semi_store", ORACLE["symbols_semi"])
def q_symbols_semi_store(spark, sf):
    """S6 against a written store: only the requested symbols' buckets are read."""
    path = scratch_folder(spark, "store")
    S.save_bars(bars(spark, sf), path)
    return S.store_has(spark, path, requested(spark, sf))


@register("symbols_anti_store", ORACLE["symbols_anti"])
def q_symbols_anti_store(spark, sf):
    path = scratch_folder(spark, "store")
    S.save_bars(bars(spark, sf), path)
    return S.store_lacks(spark, path, requested(spark, sf))


@register("scan_bucketed_store", ORACLE["scan_combined"])
def q_scan_bucketed_store(spark, sf):
    """R0 over a table that Spark buckets by symbol: no exchange of the bars."""
    name = f"bars_{uuid.uuid4().hex}"
    S.save_bucketed(bars(spark, sf), name, scratch_folder(spark, name), buckets=8)
    return r4(scan(S.read_bucketed(spark, name), COMBINED), "avg_volume_20", "rvol_20", "adr_20")


@register("landing_multiline", ORACLE["landing_bars"])
def q_landing_multiline(spark, sf):
    """Eighty further columns before the volume, the last with line ends, commas and quotes inside quotes."""
    note = tuple(f"n{i}" for i in range(80))
    return IN.landing_bars(spark, landing_folder(spark, sf, note=note, text='"one, ""two""\n\nthree\n4"'))[0]


@register("sync_status", with_bars(
    "SELECT symbol, symbol NOT IN (SELECT symbol FROM bad) AS ok, CASE WHEN symbol IN (SELECT symbol FROM bad) "
    "THEN 'Failed to fetch or empty data' WHEN dollar_volume >= 1500000 THEN 'Synced' ELSE "
    "'Synced (below threshold: $' || format('{:,}', CAST(round_even(dollar_volume, 0) AS BIGINT)) || ')' END AS message, "
    f"CASE WHEN symbol IN (SELECT symbol FROM bad) THEN 0.0 ELSE {DV_OUT.removesuffix(' AS dollar_volume')} END "
    "AS dollar_volume FROM dv", MAXD, DV_SQL, BAD_SYMBOLS))
def q_sync_status(spark, sf):
    return dv2(IN.sync(spark, landing_folder(spark, sf), scratch_folder(spark, "store"), LIQ_THRESHOLD))


# ---------------------------------------------------------------------------
# Streaming resample
# ---------------------------------------------------------------------------

ARRIVALS = 4

STREAM_SQL = """
WITH r AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
t AS (SELECT 'U' || user_id AS symbol, ts, value AS price, hi FROM events, r
      WHERE NOT (event_id % 97 = 0 AND epoch_us(ts) < (lo + hi) // 2)),
b AS (SELECT symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, arg_min(price, ts) AS open, max(price) AS high,
             min(price) AS low, arg_max(price, ts) AS close, count(*) AS volume, any_value(hi) AS hi
      FROM t GROUP BY 1, 2)
SELECT symbol, ts, open, high, low, close, volume FROM b
WHERE epoch_us(ts + INTERVAL 15 MINUTE) <= hi - 600000000
"""


@register("stream_resample", STREAM_SQL)
def q_stream_resample(spark, sf):
    """Ticks land in four deliveries by arrival, and a streaming job runs after each.

    Every eleventh tick arrives seven minutes after its time, which the watermark of ten
    minutes covers, though it may come with the next delivery; every 97th of the first half
    comes half the whole range late, and is discarded."""
    ev = table(spark, sf, "events").withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    lo, hi = ev.agg(F.min("_us"), F.max("_us")).first()
    path, store = scratch_folder(spark, "ticks"), scratch_folder(spark, "stream-store")
    width = (hi - lo) // ARRIVALS + 1
    late = F.when((F.col("event_id") % 97 == 0) & (F.col("_us") < (lo + hi) // 2), 2 * width).when(
        F.col("event_id") % 11 == 0, 7 * 60 * 1_000_000).otherwise(0)
    arrival = F.least(F.floor((F.col("_us") + late - lo) / width), F.lit(ARRIVALS - 1))
    ticks = ev.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), "ts",
                      F.col("value").alias("price"), F.lit(1).cast("bigint").alias("size"), arrival.alias("_arrival"))
    for k in range(ARRIVALS):
        ticks.where(F.col("_arrival") == k).drop("_arrival").write.parquet(f"{path}/delivery={k}")
        run_to_store(spark, f"{path}/*", store, checkpoint=f"{store}-checkpoint")
    return read_stream_store(spark, store).drop("bucket_end")


SYNC_SQL = ORACLE["sync_status"]


@register("sync_increment", f"SELECT CASE WHEN CAST(substr(symbol, 2) AS BIGINT) % 3 = 0 THEN 2 ELSE 1 END AS call, s.* "
          f"FROM ({SYNC_SQL}) s")
def q_sync_increment(spark, sf):
    """Two deliveries into one landing folder; each call reports the files that came since the one before."""
    landing, store = scratch_folder(spark, "landing"), scratch_folder(spark, "store")
    third = F.substring("symbol", 2, 18).cast("bigint") % 3 == 0
    calls = []
    for call, part in ((1, ~third), (2, third)):
        landing_folder(spark, sf, landing, part)
        status = IN.sync_increment(spark, landing, store, LIQ_THRESHOLD)
        calls.append(dv2(status).withColumn("call", F.lit(call)))
    return calls[0].unionByName(calls[1])


@register("symbol_files", with_bars(f"SELECT {BASE_SQL} FROM bars"))
def q_symbol_files(spark, sf):
    """One Parquet file a symbol, the symbol read off its name."""
    files = bars(spark, sf).withColumnRenamed("symbol", "file").repartition("file").sortWithinPartitions("file")
    return S.read_symbol_files(spark, one_file_each(files, scratch_folder(spark, "symbol-files"), ".parquet"))


@register("universe_list", with_bars(
    "SELECT symbol, count(*) AS n FROM (SELECT DISTINCT symbol, unnest(range(1 + CAST(substr(symbol, 2) AS BIGINT) % 2)) "
    "FROM bars WHERE CAST(substr(symbol, 2) AS BIGINT) % 4 <> 0) GROUP BY 1"))
def q_universe_list(spark, sf):
    """Symbols in mixed case with white space around them, between blank and comment lines; every odd one twice."""
    path = scratch_folder(spark, "universe")
    key = F.substring("symbol", 2, 18).cast("bigint")
    line = F.when(key % 4 == 0, F.concat(F.lit(" # "), "symbol")).otherwise(
        F.concat(F.lit("\u2003\t "), F.lower("symbol"), F.lit("\u00a0")))
    copies = F.explode(F.sequence(F.lit(0), key % 2))
    lines = bars(spark, sf).select("symbol").distinct().select(line.alias("value"), copies.alias("_copy")).drop("_copy")
    lines.unionByName(spark.range(3).select(F.lit(" \t").alias("value"))).write.text(path)
    return IN.read_universe(spark, path).groupBy("symbol").agg(F.count("*").alias("n"))


@register("scan_as_of", with_bars(
    f"SELECT {BASE_SQL}, (round((avg_volume_20) * 10000) / 10000 + 0.0) AS avg_volume_20, "
    "(round((rvol_20) * 10000) / 10000 + 0.0) AS rvol_20 "
    "FROM (SELECT *, volume / avg_volume_20 AS rvol_20 FROM i) WHERE rn = 1 AND rvol_20 >= 1.2",
    ind_cte("i", ["avg_volume_20"], src="(SELECT * FROM bars WHERE date <= DATE '1996-06-30')", extra=f", {LATEST}")))
def q_scan_as_of(spark, sf):
    """The scan as it would have run on a past date."""
    return r4(scan(bars(spark, sf), [P.min_rvol(1.2)], as_of="1996-06-30"), "avg_volume_20", "rvol_20")


@register("recipe_run", ORACLE["scan_report"])
def q_recipe_run(spark, sf):
    """A recipe map -> spec -> scan -> sort -> report."""
    recipe = {"min_price": 1500.0, "min_relative_volume": 1.0, "trend_template": False, "sort": "rvol_20"}
    return run_spec(bars(spark, sf), ScanSpec.from_map(recipe))


@register("chart_sorted", with_bars(
    "SELECT *, row_number() OVER (ORDER BY symbol, time) AS place FROM ("
    "SELECT symbol, CAST(date_trunc('month', date) AS TIMESTAMP) AS time, arg_max(close, date) AS close "
    "FROM bars JOIN mx USING (symbol) WHERE date >= CAST(m - INTERVAL 365 DAY AS DATE) GROUP BY 1, 2)", MAXD))
def q_chart_sorted(spark, sf):
    """O3: chart rows in (symbol, time) order; ``place`` is read off the sorted partitions."""
    rows = R.chart_bars(bars(spark, sf), resample="1mo", period="1y", sort=True).select("symbol", "time", "close")
    rows = scratch_table(rows.select("*", F.monotonically_increasing_id().alias("_at")), "chart-sorted")
    parts = rows.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    first = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    return rows.withColumn("_part", F.shiftright("_at", 33)).join(first, "_part").select(
        "symbol", "time", "close", (F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("place"))


@register("period_column", with_bars(
    "SELECT symbol, period, count(*) AS n FROM (SELECT bars.*, period, m, CASE substr(period, -1) WHEN 'd' THEN 1 "
    "WHEN 'w' THEN 7 WHEN 'o' THEN 30 ELSE 365 END * CAST(regexp_extract(period, '[0-9]+') AS INTEGER) AS days "
    "FROM bars JOIN mx USING (symbol) JOIN p USING (symbol)) WHERE date >= CAST(m - to_days(CAST(days AS INTEGER)) AS DATE) "
    "GROUP BY 1, 2", MAXD,
    "p AS (SELECT DISTINCT symbol, CASE CAST(substr(symbol, 2) AS BIGINT) % 4 WHEN 0 THEN '90d' WHEN 1 THEN '10w' "
    "WHEN 2 THEN '6mo' ELSE '2y' END AS period FROM bars)"))
def q_period_column(spark, sf):
    """X6 as a column: every symbol with a period of its own."""
    k = F.substring("symbol", 2, 18).cast("bigint") % 4
    period = F.when(k == 0, "90d").when(k == 1, "10w").when(k == 2, "6mo").otherwise("2y")
    b = bars(spark, sf)
    b = b.join(R.symbol_max_dates(b), "symbol").withColumn("period", period)
    kept = b.where(F.col("date") >= F.date_sub(F.col("_max_date"), period_days_col(F.col("period")).cast("int")))
    return kept.groupBy("symbol", "period").agg(F.count("*").alias("n"))
