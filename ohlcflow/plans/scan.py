"""The end-to-end scan, result sort (O2), report projection (P2), top-k.

Shape: bars -> indicators -> latest bar per symbol -> AND of predicates.
Predicates are applied only after the latest row is chosen, so ``close >= x``
never changes which bar is the latest.

Plans:

* ``snapshot`` (default): frame only the tail of each history (last chunk
  plus the rows the longest lookback needs).  Rows older than that are
  dropped before the shuffle.  When every indicator has a latest-row form,
  the values on the latest bar are conditional aggregates over that tail
  (``indicators.snapshot_with``); EWM-based ones use windows on the tail.
* ``rolling``: indicators on every bar, then the latest row.  Same result;
  used for history screens and as a cross-check.
* ``history=True`` (R5): predicates on every bar, not only the latest.
* ``as_of``: the scan as it would have run on that date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_to
from ..operators import indicators as I
from ..operators.latest import latest_bars
from ..operators.series import Framed
from . import predicates as P
from .spec import ScanSpec

DESCENDING_SORTS = ("close", "volume", "rvol_20", "adr_20")
REPORT_COLUMNS = ("symbol", "date", "close", "volume", "rvol_20", "adr_20", "sma_50", "sma_200")


def _preds(criteria) -> list:
    if isinstance(criteria, ScanSpec):
        return criteria.predicates()
    if isinstance(criteria, P.Predicate):
        return [criteria]
    return list(criteria or [])


def scan(bars: DataFrame, criteria=None, *, plan: str = "snapshot", as_of=None,
         history: bool = False, width: int | None = None) -> DataFrame:
    preds = _preds(criteria)
    if as_of is not None:
        bars = bars.where(F.col("date") <= F.lit(as_of))
    inds = P.required_indicators(preds)
    cond = P.all_of(preds).condition
    if not inds and not history:
        return latest_bars(bars).where(cond)
    latest_only = (plan == "snapshot") and not history
    if latest_only:
        snap = I.snapshot_with(bars, inds, width=width)
        if snap is not None:
            return snap.where(cond)
    fr = I.frame_with(bars, inds, latest=latest_only, width=width)
    df = fr.df
    if not history:
        df = df.where(Framed.is_latest())
    return fr.finish(df).where(cond)


def scan_store(spark, path: str, criteria=None, *, plan: str = "snapshot", as_of=None,
               history: bool = False, timeframe: str | None = None) -> DataFrame:
    """``scan`` over a bar store; a latest-bar scan reads the store's tail table when it has one."""
    from ..sources.store import read_bars, read_timeframe, snapshot_bars
    preds = _preds(criteria)
    if plan == "snapshot" and not history and as_of is None:
        lookback = max([i.lookback for i in I.dedupe(P.required_indicators(preds))] + [1])
        bars = snapshot_bars(spark, path, lookback, timeframe)
    else:
        bars = read_timeframe(spark, path, timeframe) if timeframe is not None else read_bars(spark, path)
    return scan(bars, preds, plan=plan, as_of=as_of, history=history)


def sort_results(df: DataFrame, by: str = "symbol") -> DataFrame:
    """O2: sort by ``by`` if present (else unsorted); descending for the
    activity columns, NULLs first in both directions, symbol breaks ties."""
    if by not in df.columns:
        return df
    c = F.col(by)
    key = c.desc_nulls_first() if by in DESCENDING_SORTS else c.asc_nulls_first()
    ties = [F.col("symbol").asc()] if by != "symbol" and "symbol" in df.columns else []
    return df.orderBy(key, *ties)


def report(df: DataFrame) -> DataFrame:
    """Symbol, date, close, volume, rvol_20, adr_20, sma_50, sma_200.

    Indicator columns that are absent, NULL or exactly 0 become NULL; values
    are rounded to 2 decimals (the zero test is on the raw value)."""
    cols = [F.col("symbol"), F.col("date"), round_to(F.col("close"), 2).alias("close"), F.col("volume")]
    for c in ("rvol_20", "adr_20", "sma_50", "sma_200"):
        if c in df.columns:
            raw = F.col(c)
            cols.append(F.when(raw.isNull() | (raw == 0), F.lit(None).cast("double"))
                        .otherwise(round_to(raw, 2)).alias(c))
        else:
            cols.append(F.lit(None).cast("double").alias(c))
    return df.select(*cols)


def top_k(df: DataFrame, by: str, k: int) -> DataFrame:
    """O2 + O4: the first ``k`` rows in result order (planned as TakeOrderedAndProject)."""
    return sort_results(df, by).limit(k)


def run_spec(bars: DataFrame, spec: ScanSpec, *, plan: str = "snapshot") -> DataFrame:
    """R1 end to end: criteria -> scan -> sort -> report."""
    return sort_results(report(scan(bars, spec, plan=plan)), spec.sort)


def trend_scorecard(bars: DataFrame, *, plan: str = "snapshot") -> DataFrame:
    """Latest bar of each symbol with the six trend-template checks as booleans."""
    df = I.snapshot_with(bars, I.trend_suite()) if plan == "snapshot" else None
    if df is None:
        fr = I.frame_with(bars, I.trend_suite(), latest=(plan == "snapshot"))
        df = fr.finish(fr.df.where(Framed.is_latest()))
    checks = [f().alias(name) for name, f in P.TREND_CHECKS.items()]
    passed = P.trend_template().condition
    return df.select("symbol", "date", *checks, F.coalesce(passed, F.lit(False)).alias("passes"))
