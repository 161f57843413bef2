"""Indicator catalogue (per symbol, ordered by date, row-counted).

Each indicator is a small declarative object: output columns, the number of
preceding rows it needs (``lookback``) and a function adding its columns to a
framed DataFrame.  ``add_indicators`` frames the bars once for the largest
lookback, applies every indicator (de-duplicated by name) and returns the
owned rows, so any mix of indicators costs one shuffle of the bars.

Column names follow the screener's conventions: ``sma_{p}``, ``ema_{p}``,
``rsi_{p}``, ``atr_{p}``, ``adr_{p}``, ``avg_volume_{p}``, ``rvol_{p}``,
``high_{p}``, ``low_{p}``, ``prev_high``, ``sma_200_1m_ago``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_table
from .series import IDX, OWN, PART, TOTAL, Framed, ewm, ewm_lookback, ewm_order, frame, lag, roll, rolling

Apply = Callable[[Framed, DataFrame], DataFrame]


# Latest-row form: given ``back`` (rows before the latest bar: 0 is the latest
# bar, 1 the one before ...), the aggregate Columns that give the indicator's
# value on the latest bar.  See ``snapshot_with``.
Latest = Callable[[F.Column], dict]


@dataclass(frozen=True)
class Indicator:
    name: str
    lookback: int
    apply: Apply = field(compare=False, repr=False)
    outputs: tuple[str, ...] = ()
    latest: Latest | None = field(default=None, compare=False, repr=False)
    # columns whose previous-row value the latest form reads as ``_prev_<col>``
    latest_prev: tuple[str, ...] = ()
    # column whose long standstills the framing must tell (see ``frame``)
    flat: str | None = None

    @property
    def columns(self) -> tuple[str, ...]:
        return self.outputs or (self.name,)


# ---------------------------------------------------------------------------
# Column-level building blocks
# ---------------------------------------------------------------------------

def range_pct() -> F.Column:
    """Daily range in percent of the low; NULL when low is 0 (no infinities)."""
    return F.try_divide(F.col("high") - F.col("low"), F.col("low")) * 100.0


def true_range(fr: Framed, order=None) -> F.Column:
    pc = F.lag("close", 1).over(order) if order is not None else lag(fr, "close", 1)
    # greatest() skips NULLs, so the first row falls back to high - low
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def rsi_from(gain, loss) -> F.Column:
    """100 - 100/(1 + g/l) with the IEEE limits spelled out (no division by zero)."""
    g = gain if isinstance(gain, F.Column) else F.col(gain)
    lo = loss if isinstance(loss, F.Column) else F.col(loss)
    return (F.when(lo == 0, F.when(g == 0, F.lit(float("nan"))).otherwise(F.lit(100.0)))
             .otherwise(100.0 - 100.0 / (1.0 + g / lo)))


def last_rows(back: F.Column, n: int, x, agg) -> F.Column:
    """``agg`` of ``x`` over the ``n`` rows ending at ``back == 0``; NULL unless all ``n`` are non-null."""
    v = F.when((back >= 0) & (back < n), x if isinstance(x, F.Column) else F.col(x))
    return F.when(F.count(v) == n, agg(v))


def ewm_at_latest(back: F.Column, x: F.Column, alpha: float) -> F.Column:
    """The EWM (y0 = x0, yt = a xt + (1-a) y(t-1)) on the latest row, as one sum.

    Unrolled, y_T = sum over t >= 1 of a (1-a)^(T-t) x_t, plus (1-a)^T x_0.
    Rows more than ``ewm_lookback`` back weigh < 1e-32 and are left out, as
    in the window form."""
    if alpha >= 1.0:
        return row_at(back, 0, x)
    w = F.when(F.col(IDX) == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    inside = (back >= 0) & (back < ewm_lookback(alpha))
    value = F.sum(F.when(inside, w * x * F.pow(F.lit(1.0 - alpha), back)))
    # a NULL input has no defined weight (as in the window form)
    return F.when(F.count_if(inside & x.isNull()) == 0, value)


def previous_close_delta() -> F.Column:
    return F.col("close") - F.col("_prev_close")


def row_at(back: F.Column, k: int, x) -> F.Column:
    """The value of ``x`` ``k`` rows before ``back == 0`` (NULL if there is no such row)."""
    return F.max(F.when(back == k, x if isinstance(x, F.Column) else F.col(x)))


# ---------------------------------------------------------------------------
# Indicator constructors
# ---------------------------------------------------------------------------

def sma(period: int, col: str = "close", name: str | None = None) -> Indicator:
    out = name or f"sma_{period}"
    return Indicator(out, period - 1, lambda fr, df: rolling(fr, df, "avg", col, period, out),
                     latest=lambda back: {out: last_rows(back, period, F.col(col).cast("double"), F.avg)})


def ema(period: int, col: str = "close", name: str | None = None) -> Indicator:
    out = name or f"ema_{period}"
    alpha = 2.0 / (period + 1.0)

    def apply(fr: Framed, df: DataFrame) -> DataFrame:
        src = f"{out}__x"
        df = df.withColumn(src, F.col(col).cast("double"))
        return ewm(fr, df, src, alpha, out).drop(src)
    return Indicator(out, ewm_lookback(alpha), apply,
                     latest=lambda back: {out: ewm_at_latest(back, F.col(col).cast("double"), alpha)})


def rsi(period: int = 14, col: str = "close", name: str | None = None) -> Indicator:
    out = name or f"rsi_{period}"
    alpha = 1.0 / period

    def apply(fr: Framed, df: DataFrame) -> DataFrame:
        g, lo, ag, al = f"{out}__g", f"{out}__l", f"{out}__ag", f"{out}__al"
        df, order = ewm_order(fr, df, alpha)
        delta = F.col(col) - F.lag(col, 1).over(order)
        df = (df.withColumn(g, F.when(delta > 0, delta).otherwise(F.lit(0.0)))
                .withColumn(lo, F.when(delta < 0, -delta).otherwise(F.lit(0.0))))
        df = ewm(fr, df, g, alpha, ag)
        df = ewm(fr, df, lo, alpha, al)
        df = df.withColumn(out, rsi_from(ag, al)).drop(g, lo, ag, al)
        return stand_still(fr, df, out, order)

    def latest(back: F.Column) -> dict:
        delta = F.col(col) - F.col(f"_prev_{col}")
        gain = F.when(delta > 0, delta).otherwise(F.lit(0.0))
        loss = F.when(delta < 0, -delta).otherwise(F.lit(0.0))
        # without a change the value stays, so it is taken at the last change (``_still`` rows back)
        at = back - F.col(f"_still_{col}")
        return {out: rsi_from(ewm_at_latest(at, gain, alpha), ewm_at_latest(at, loss, alpha))}
    return Indicator(out, ewm_lookback(alpha) + 1, apply, (), latest, (col,), col)


def stand_still(fr: Framed, df: DataFrame, out: str, order) -> DataFrame:
    """Carry ``out`` over rows where it is NaN because nothing has changed for so long that
    both averages are 0.  On a zero change both decay alike, so their ratio, and with it
    the RSI, is that of the last change.  Inside a partition that is the last number
    before; for symbols that stand still over a whole halo, the last numbers of the
    partitions before come from a small written table."""
    number = F.when(~F.isnan(out), F.col(out))
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(f"{out}__last", F.last(number, ignorenulls=True).over(before))
    known = F.coalesce(F.col(f"{out}__last"), F.col(out))
    if fr.flat is not None:
        own = df.join(fr.flat, list(fr.keys), "left_semi").where(OWN)
        ends = own.groupBy(*fr.keys, PART).agg(F.max_by(number, F.when(~F.isnan(out), F.col(IDX))).alias("_end"))
        w = Window.partitionBy(*fr.keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        ends = scratch_table(ends.withColumn(f"{out}__carry", F.last("_end", ignorenulls=True).over(w)).drop("_end"),
                             "series-still")
        df = df.join(ends, [*fr.keys, PART], "left")
        known = F.coalesce(F.col(f"{out}__last"), F.col(f"{out}__carry"), F.col(out))
    return df.withColumn(out, F.when(F.isnan(out), known).otherwise(F.col(out))).drop(f"{out}__last", f"{out}__carry")


def atr(period: int = 14, name: str | None = None) -> Indicator:
    out = name or f"atr_{period}"
    alpha = 1.0 / period

    def apply(fr: Framed, df: DataFrame) -> DataFrame:
        tr = f"{out}__tr"
        df, order = ewm_order(fr, df, alpha)
        df = df.withColumn(tr, true_range(fr, order))
        return ewm(fr, df, tr, alpha, out).drop(tr)

    def latest(back: F.Column) -> dict:
        pc = F.col("_prev_close")
        tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))
        return {out: ewm_at_latest(back, tr, alpha)}
    return Indicator(out, ewm_lookback(alpha) + 1, apply, (), latest, ("close",))


def adr(period: int = 20, name: str | None = None) -> Indicator:
    out = name or f"adr_{period}"
    return Indicator(out, period - 1, lambda fr, df: rolling(fr, df, "avg", range_pct(), period, out),
                     latest=lambda back: {out: last_rows(back, period, range_pct(), F.avg)})


def rvol(period: int = 20) -> Indicator:
    avg_name, out = f"avg_volume_{period}", f"rvol_{period}"

    def apply(fr: Framed, df: DataFrame) -> DataFrame:
        return (rolling(fr, df, "avg", "volume", period, avg_name)
                  .withColumn(out, F.try_divide(F.col("volume").cast("double"), F.col(avg_name))))
    def latest(back: F.Column) -> dict:
        avg = last_rows(back, period, F.col("volume").cast("double"), F.avg)
        return {avg_name: avg, out: F.try_divide(row_at(back, 0, F.col("volume").cast("double")), avg)}
    return Indicator(out, period - 1, apply, (avg_name, out), latest)


def extrema(period: int = 252) -> Indicator:
    hi, lo = f"high_{period}", f"low_{period}"

    def apply(fr: Framed, df: DataFrame) -> DataFrame:
        return rolling(fr, rolling(fr, df, "max", "high", period, hi), "min", "low", period, lo)
    return Indicator(f"extrema_{period}", period - 1, apply, (hi, lo),
                     lambda back: {hi: last_rows(back, period, "high", F.max),
                                   lo: last_rows(back, period, "low", F.min)})


def rolling_min(period: int, col: str, name: str) -> Indicator:
    return Indicator(name, period - 1, lambda fr, df: rolling(fr, df, "min", col, period, name),
                     latest=lambda back: {name: last_rows(back, period, col, F.min)})


def rolling_max(period: int, col: str, name: str) -> Indicator:
    return Indicator(name, period - 1, lambda fr, df: rolling(fr, df, "max", col, period, name),
                     latest=lambda back: {name: last_rows(back, period, col, F.max)})


def shifted(col: str, k: int = 1, name: str | None = None) -> Indicator:
    out = name or f"{col}_lag{k}"
    return Indicator(out, k, lambda fr, df: df.withColumn(out, lag(fr, col, k)),
                     latest=lambda back: {out: row_at(back, k, col)})


def prev_high() -> Indicator:
    return shifted("high", 1, "prev_high")


def diff(col: str = "close", name: str | None = None) -> Indicator:
    out = name or f"{col}_diff"
    return Indicator(out, 1, lambda fr, df: df.withColumn(out, F.col(col) - lag(fr, col, 1)),
                     latest=lambda back: {out: row_at(back, 0, col) - row_at(back, 1, col)})


def lagged(base: Indicator, k: int, name: str) -> Indicator:
    """A window value shifted by ``k`` rows (window over window, two stages).

    ``base`` must write a column of its own (give it a private name) so it
    cannot collide with the same indicator requested directly."""
    src = base.columns[0]

    def apply(fr: Framed, df: DataFrame) -> DataFrame:
        df = base.apply(fr, df)
        return df.withColumn(name, lag(fr, src, k, base.lookback)).drop(*base.columns)
    latest = None
    if base.latest is not None:
        # the base's latest form, evaluated k rows earlier
        def latest(back: F.Column) -> dict:
            return {name: base.latest(back - k)[src]}
    return Indicator(name, base.lookback + k, apply, (), latest, base.latest_prev)


def sma_200_1m_ago() -> Indicator:
    return lagged(sma(200, name="sma_200_1m_ago__base"), 20, "sma_200_1m_ago")


def rolling_stddev(period: int, col: str = "close", name: str | None = None) -> Indicator:
    out = name or f"std_{period}"
    return Indicator(out, period - 1,
                     lambda fr, df: df.withColumn(out, roll(fr, F.stddev_pop, col, period)),
                     latest=lambda back: {out: last_rows(back, period, F.col(col).cast("double"), F.stddev_pop)})


def common_suite() -> list[Indicator]:
    """sma_50, sma_200, rsi_14."""
    return [sma(50), sma(200), rsi(14)]


def trend_suite() -> list[Indicator]:
    return [sma(50), sma(150), sma(200), extrema(252), sma_200_1m_ago()]


# ---------------------------------------------------------------------------
# Evaluation
# ---------------------------------------------------------------------------

def dedupe(indicators) -> list[Indicator]:
    seen: dict[str, Indicator] = {}
    for ind in indicators:
        seen.setdefault(ind.name, ind)
    return list(seen.values())


def frame_with(bars: DataFrame, indicators, *, keys=("symbol",), order="date", latest=False,
               width: int | None = None, span: int | None = None, extra_lookback: int = 0) -> Framed:
    """Frame ``bars`` for the given indicators and add their columns (helpers kept).

    ``extra_lookback`` is how many rows further back the caller reads those columns."""
    inds = dedupe(indicators)
    lookback = max([i.lookback for i in inds] + [1]) + extra_lookback
    flat = next((i.flat for i in inds if i.flat), None)
    fr = frame(bars, lookback, keys=tuple(keys), order=order, latest=latest, width=width, span=span, flat=flat)
    df = fr.df
    for ind in inds:
        df = ind.apply(fr, df)
    return fr.with_df(df)


def snapshot_with(bars: DataFrame, indicators, *, keys=("symbol",), order="date",
                  width: int | None = None) -> DataFrame | None:
    """The latest bar of each symbol with the indicators' values on it, as one aggregate.

    The snapshot framing already holds, per symbol, only the rows the longest
    lookback needs, in one partition.  Instead of evaluating windows on every
    one of those rows and keeping the last, each indicator's latest-row form
    is a conditional aggregate over them (``avg(close) over the last 50 rows``
    becomes ``avg(close) FILTER (back < 50)``), and the bar columns are taken
    with ``max_by(c, row index)``.  The aggregate runs in the framing's
    partitions (no further exchange) inside whole-stage codegen; EWMs are a
    decay-weighted sum (``ewm_at_latest``), RSI and ATR read the previous
    close from one ``lag``.  Returns None when an indicator has no latest
    form; callers then use the window plan, which gives the same values."""
    inds = dedupe(indicators)
    if any(i.latest is None for i in inds):
        return None
    lookback = max([i.lookback for i in inds] + [1])
    flats = sorted({i.flat for i in inds if i.flat})
    fr = frame(bars, lookback, keys=tuple(keys), order=order, latest=True, width=width, flat=next(iter(flats), None))
    rows = fr.df
    prev = sorted({c for i in inds for c in i.latest_prev})
    if prev:
        # one lag per column, in the row-index window operator (same partition and order)
        rows = rows.withColumns({f"_prev_{c}": lag(fr, c, 1) for c in prev})
    if flats:
        whole = Window.partitionBy(*keys, PART)
        rows = rows.withColumns({f"_still_{c}": F.coalesce(F.col(TOTAL) - 1 - F.max(F.when(
            F.col(c) != F.col(f"_prev_{c}"), F.col(IDX))).over(whole), F.lit(0)) for c in flats})
    back = F.col(TOTAL) - 1 - F.col(IDX)
    columns = [c for c in bars.columns if c not in keys]
    aggs = [F.max_by(c, IDX).alias(c) for c in columns]
    seen = set(columns)
    for ind in inds:
        for name, col in ind.latest(back).items():
            if name not in seen:
                seen.add(name)
                aggs.append(col.alias(name))
    return rows.groupBy(*keys, PART).agg(*aggs).drop(PART)


def add_indicators(bars: DataFrame, indicators, **kw) -> DataFrame:
    """Bars with indicator columns, every input row exactly once."""
    fr = frame_with(bars, indicators, **kw)
    return fr.finish()
