"""T2 strategy tables: next-bar signals, relative strength, market regime,
performance measures and parameter sweeps.  Everything looks backwards only
(a trade opened on bar t+1 is emitted on bar t+1 from the previous bar's
signal), so every step runs on the skew-safe framed series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_table
from . import indicators as I
from .asof import asof_join
from .screens import prior_high
from .series import CHUNK, Framed, chunk_column, lag, sliding_share

# (ours) defaults
STOP_ATR_MULT = 2.0
RISK_BUDGET = 1000.0
ATR_YEAR = 252
ATR_HIGH = 0.8


def next_bar_signals(bars: DataFrame, n: int = 20, atr_period: int = 14,
                     k: float = STOP_ATR_MULT, risk: float = RISK_BUDGET) -> DataFrame:
    """P-SIG: a 20-row breakout on bar t is entered at the open of bar t+1.

    stop = close(t) - k * atr(t); size = floor(risk / (close(t) - stop));
    ``rank`` orders the signals of one day by relative volume (ties: symbol).  A signal
    of a symbol's newest bar is there too, with NULL entry_date and entry: its entry is
    the next session's open."""
    inds = [prior_high(n), I.atr(atr_period), I.rvol(20)]
    fr = I.frame_with(bars, inds, extra_lookback=1)
    depth = fr.lookback - 1
    sig = {"signal_date": "date", "close": "close", "atr": f"atr_{atr_period}", "rvol_20": "rvol_20"}
    df = fr.df.withColumn("_sig", F.col("close") > F.col(f"prior_high_{n}"))
    df = df.withColumns({"_prev_sig": lag(fr, "_sig", 1, depth),
                         **{f"_sig_{a}": lag(fr, c, 1, depth) for a, c in sig.items()}})
    # both events of a bar in one pass: the entry of the bar before, the signal of the newest bar
    entered = F.struct(F.col("date").alias("entry_date"), F.col("open").alias("entry"),
                       *[F.col(f"_sig_{a}").alias(a) for a in sig])
    newest = F.struct(F.lit(None).cast(df.schema["date"].dataType).alias("entry_date"),
                      F.lit(None).cast(df.schema["open"].dataType).alias("entry"),
                      *[F.col(c).alias(a) for a, c in sig.items()])
    events = F.array_compact(F.array(F.when(F.col("_prev_sig"), entered),
                                     F.when(F.col("_sig") & Framed.is_latest(), newest)))
    out = fr.finish(df.withColumn("_events", events).where(F.size("_events") > 0))
    out = out.select("symbol", F.inline("_events"))
    stop = F.col("close") - F.lit(k) * F.col("atr")
    per_share = F.col("close") - stop
    out = out.select(
        "symbol", "signal_date", "entry_date", "entry", stop.alias("stop"),
        F.floor(F.try_divide(F.lit(risk), per_share)).cast("bigint").alias("size"),
        "rvol_20")
    w = Window.partitionBy("signal_date").orderBy(F.col("rvol_20").desc_nulls_last(), "symbol")
    return out.withColumn("rank", F.rank().over(w))


def relative_strength(bars: DataFrame, benchmark: str, k: int = 20, as_of: bool = False) -> DataFrame:
    """P-RS: (1 + k-row return) / (1 + benchmark's k-row return), percent-ranked per date.

    On a date without a benchmark return the row stays, with NULL rs and rank; with ``as_of``
    it takes the benchmark's last return before that date."""
    ret = I.Indicator(f"ret_{k}", k, lambda fr, df: df.withColumn(
        f"ret_{k}", F.try_divide(F.col("close"), lag(fr, "close", k)) - 1.0))
    df = I.add_indicators(bars, [ret]).where(F.col(f"ret_{k}").isNotNull())
    bench = (df.where(F.col("symbol") == benchmark)
               .select("date", F.col(f"ret_{k}").alias(f"bench_ret_{k}")))
    df = asof_join(df, bench, [f"bench_ret_{k}"]) if as_of else df.join(bench, "date", "left")
    out = df.select("symbol", "date", f"ret_{k}", f"bench_ret_{k}",
                    F.try_divide(1.0 + F.col(f"ret_{k}"), 1.0 + F.col(f"bench_ret_{k}")).alias("rs"))
    w = Window.partitionBy("date", F.col("rs").isNull()).orderBy("rs")
    return out.withColumn("rs_rank", F.when(F.col("rs").isNotNull(), F.percent_rank().over(w)))


def _volatility(bars: DataFrame, indicators) -> tuple[Framed, DataFrame]:
    """Framed bars with the indicators and ``atr_percentile``."""
    fr = I.frame_with(bars, [*indicators, I.atr(14)], extra_lookback=ATR_YEAR - 1)
    df = fr.df.withColumn("_vol", F.try_divide(F.col("atr_14"), F.col("close")))
    return fr, sliding_share(fr, df, "_vol", ATR_YEAR, "atr_percentile")


def atr_percentile(bars: DataFrame) -> DataFrame:
    """P-REG's volatility measure for every symbol and date: the share of the symbol's last ``ATR_YEAR``
    rows whose atr_14 / close is at most that row's; NULL during warm-up."""
    fr, df = _volatility(bars, [])
    return fr.finish(df).select("symbol", "date", "atr_percentile")


def regime(bars: DataFrame, benchmark: str) -> DataFrame:
    """P-REG: the benchmark's regime per date, and the policy it stands for.

    Above the 200-row average: ``trend_on`` (gate 1.0), or
    ``trend_caution`` (gate 0.5) while ``atr_percentile`` is above ``ATR_HIGH``; below it
    ``trend_off`` (gate 0.0, no new entries); ``unknown`` (no gate) during warm-up
    *(cut-offs and gates: ours)*."""
    fr, df = _volatility(bars.where(F.col("symbol") == benchmark), [I.sma(200)])
    df = fr.finish(df)
    state = (F.when(F.col("sma_200").isNull() | F.col("atr_percentile").isNull(), "unknown")
              .when(F.col("close") <= F.col("sma_200"), "trend_off")
              .when(F.col("atr_percentile") > ATR_HIGH, "trend_caution").otherwise("trend_on"))
    gate = F.when(F.col("regime") == "trend_on", 1.0).when(F.col("regime") == "trend_caution", 0.5).when(
        F.col("regime") == "trend_off", 0.0)
    return df.select("date", "atr_percentile", state.alias("regime")).withColumn("gate", gate)


def forward_trades(bars: DataFrame, horizons=(5,), n: int = 20) -> DataFrame:
    """Trades of the breakout signal: entry at open of t+1, exit at close of t+1+h-1.

    Emitted on the exit bar, so only past rows are read."""
    fr = I.frame_with(bars, [prior_high(n)], extra_lookback=max(horizons))
    df = fr.df.withColumn("_sig", F.col("close") > F.col(f"prior_high_{n}"))
    # every horizon is a column of the one framed pass; fired ones are exploded
    for h in horizons:
        df = df.withColumns({f"_fired_{h}": lag(fr, "_sig", h, n),
                             f"_entry_{h}": lag(fr, "open", h - 1) if h > 1 else F.col("open"),
                             f"_date_{h}": lag(fr, "date", h - 1) if h > 1 else F.col("date")})
    trades = F.array_compact(F.array(*[F.when(F.col(f"_fired_{h}"), F.struct(
        F.lit(f"breakout_{n}_h{h}").alias("strategy"), F.col(f"_date_{h}").alias("entry_date"),
        (F.try_divide(F.col("close"), F.col(f"_entry_{h}")) - 1.0).alias("ret"))) for h in horizons]))
    d = fr.finish(df.withColumn("_trades", trades).where(F.size("_trades") > 0))
    return d.select("symbol", F.col("date").alias("exit_date"), F.inline("_trades")).select(
        "strategy", "symbol", "entry_date", "exit_date", "ret")


def performance(trades: DataFrame) -> DataFrame:
    """P-PM per strategy: trades, win rate, expectancy, total and annual growth, max drawdown.

    Trades are pre-aggregated per (strategy, exit date) (counts, wins, sum of
    returns, sum of log growth), so the equity curve's running-maximum window
    holds one row per calendar day, not per trade, and the per-strategy
    figures are sums of those daily parts: one aggregation chain, no join."""
    ret = F.col("ret")
    daily = (trades.groupBy("strategy", "exit_date")
                   .agg(F.sum(F.log1p(ret)).alias("_lr"), F.count(F.lit(1)).alias("_n"),
                        F.sum(F.when(ret > 0, 1.0).otherwise(0.0)).alias("_wins"),
                        F.sum(ret).alias("_sret"), F.count(ret).alias("_nret")))
    w = Window.partitionBy("strategy").orderBy("exit_date")
    curve = (daily.withColumn("_cum", F.sum("_lr").over(w.rowsBetween(Window.unboundedPreceding, 0)))
                  .withColumn("_peak", F.greatest(F.lit(0.0), F.max("_cum").over(
                      w.rowsBetween(Window.unboundedPreceding, 0))))
                  .withColumn("_dd", F.exp(F.col("_cum") - F.col("_peak")) - 1.0))
    per = curve.groupBy("strategy").agg(
        F.sum("_n").alias("n_trades"), F.sum("_wins").alias("_wins"),
        F.sum("_sret").alias("_sret"), F.sum("_nret").alias("_nret"),
        F.min("_dd").alias("max_drawdown"), F.sum("_lr").alias("_total_lr"),
        F.min("exit_date").alias("_first"), F.max("exit_date").alias("_last"))
    years = F.greatest(F.datediff("_last", "_first") / 365.25, F.lit(1.0 / 365.25))
    return per.select("strategy", "n_trades",
                      F.try_divide(F.col("_wins"), F.col("n_trades").cast("double")).alias("win_rate"),
                      F.try_divide(F.col("_sret"), F.col("_nret").cast("double")).alias("expectancy"),
                      (F.exp("_total_lr") - 1.0).alias("total_return"),
                      (F.exp(F.col("_total_lr") / years) - 1.0).alias("cagr"),
                      "max_drawdown")


#: Chunks that one level of ``equity_metrics`` combines.
FAN_IN = 64


def equity_metrics(equity: DataFrame) -> DataFrame:
    """P-PM over equity curves (strategy, date, equity): points, win rate and expectancy of the day's
    return, total and annual growth, max drawdown.

    A stretch of a curve is summed up by its first and last value, its top and low, its
    deepest fall and its returns; two neighbouring stretches make one of the same form, with
    the fall from the first one's top to the second one's low and the return across the seam.
    That is associative, so time chunks are summed up one by one, then ``FAN_IN`` of them at a
    time until one is left: no window holds a whole curve.  NULL values are left out; points of
    one day are ordered by value; where the top is not positive there is no fall."""
    rows = equity.where(F.col("equity").isNotNull() & F.col("date").isNotNull())
    rows = rows.select("strategy", "date", "equity", chunk_column(equity, "date").alias(CHUNK))
    here = Window.partitionBy("strategy", CHUNK).orderBy("date", "equity")
    fall = lambda low, top: F.when(top > 0, low / top - 1.0)
    step = lambda now, before: F.when(before != 0, now / before - 1.0)
    rows = rows.withColumns({
        "_top": F.max("equity").over(here.rowsBetween(Window.unboundedPreceding, 0)),
        "_ret": step(F.col("equity"), F.lag("equity").over(here))})
    at = F.struct("date", "equity")
    parts = rows.groupBy("strategy", CHUNK).agg(
        F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), F.max("equity").alias("top"),
        F.min("equity").alias("low"), F.min(fall(F.col("equity"), F.col("_top"))).alias("fall"),
        F.sum((F.col("_ret") > 0).cast("long")).alias("ups"), F.sum("_ret").alias("sum_ret"),
        F.count("_ret").alias("n_ret"))
    parts = scratch_table(parts, "equity-parts")
    lo, hi = parts.agg(F.min(CHUNK), F.max(CHUNK)).first()
    while lo is not None and lo != hi:
        lo, hi = lo // FAN_IN, hi // FAN_IN
        here = Window.partitionBy("strategy", "_group").orderBy(CHUNK)
        parts = parts.withColumn("_group", F.floor(F.col(CHUNK) / FAN_IN)).withColumns({
            "_before": F.max("top").over(here.rowsBetween(Window.unboundedPreceding, -1)),
            "_seam": step(F.col("first.equity"), F.lag("last.equity").over(here))})
        parts = parts.groupBy("strategy", F.col("_group").alias(CHUNK)).agg(
            F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("top").alias("top"),
            F.min("low").alias("low"), F.min(F.least("fall", fall(F.col("low"), F.col("_before")))).alias("fall"),
            (F.coalesce(F.sum("ups"), F.lit(0)) + F.count_if(F.col("_seam") > 0)).alias("ups"),
            F.sum(F.coalesce("sum_ret", F.lit(0.0)) + F.coalesce("_seam", F.lit(0.0))).alias("sum_ret"),
            (F.sum("n_ret") + F.count("_seam")).alias("n_ret"))
    growth = F.when(F.col("first.equity") > 0, F.col("last.equity") / F.col("first.equity"))
    years = F.greatest(F.datediff("last.date", "first.date") / 365.25, F.lit(1.0 / 365.25))
    return parts.select(
        "strategy", F.col("n").alias("n_points"),
        F.try_divide(F.coalesce("ups", F.lit(0)).cast("double"), F.col("n_ret")).alias("win_rate"),
        F.try_divide(F.col("sum_ret"), F.col("n_ret").cast("double")).alias("expectancy"),
        (growth - 1.0).alias("total_return"), (F.pow(growth, 1.0 / years) - 1.0).alias("cagr"),
        F.col("fall").alias("max_drawdown"))


def _sweep(bars: DataFrame, lengths, horizon: int) -> DataFrame:
    """Fired breakouts of every length: ``param``, ``symbol``, ``_sig_date``, ``_exit_date`` and ``fwd_ret``.

    Every parameter is a column of the same framed pass; only fired signals
    are exploded into rows (no product of grid and bars is materialized)."""
    fr = I.frame_with(bars, [prior_high(n) for n in lengths], extra_lookback=horizon)
    df = fr.df
    for n in lengths:
        df = df.withColumn(f"_sig_{n}", F.col("close") > F.col(f"prior_high_{n}"))
    fired = [F.when(lag(fr, f"_sig_{n}", horizon, n), F.lit(n)) for n in lengths]
    df = (df.withColumn("_fired", F.array_compact(F.array(*fired)))
            .withColumn("_base", lag(fr, "close", horizon))
            .withColumn("_sig_date", lag(fr, "date", horizon)))
    d = fr.finish(df.where(F.size("_fired") > 0))
    return d.select(F.explode("_fired").alias("param"), "symbol", "_sig_date", F.col("date").alias("_exit_date"),
                    (F.try_divide(F.col("close"), F.col("_base")) - 1.0).alias("fwd_ret"))


def param_sweep(bars: DataFrame, lengths=(10, 20, 50), horizon: int = 5, split_date: str = "1999-01-01") -> DataFrame:
    """P-SW: breakout length grid x bars -> forward returns per (param, split)."""
    d = _sweep(bars, lengths, horizon)
    split = F.when(F.col("_sig_date") < F.to_date(F.lit(split_date)), "in_sample").otherwise("out_of_sample")
    return (d.withColumn("split", split)
             .groupBy("param", "split")
             .agg(F.count(F.lit(1)).alias("n_signals"), F.avg("fwd_ret").alias("avg_fwd_ret"),
                  F.avg(F.when(F.col("fwd_ret") > 0, 1.0).otherwise(0.0)).alias("hit_rate")))


def walk_forward(bars: DataFrame, lengths=(10, 20, 50), horizon: int = 5, *, start: str = "1992-01-01",
                 train_days: int = 730, test_days: int = 182, step_days: int = 182) -> DataFrame:
    """P-SW by folds: choose the parameter on each fold's first part, report it on the second.

    Fold f begins ``f * step_days`` after ``start``; folds overlap, and a signal fans out to the
    folds that hold its day by arithmetic on the day.  A signal counts for training only if its
    exit is known before the test part begins.  The parameter with the largest mean training
    return wins (to nine digits; ties: the smaller parameter); folds without a training signal
    are left out, and a winner without a test signal reports none."""
    day = F.datediff("_sig_date", F.to_date(F.lit(start)))
    exit_day = F.datediff("_exit_date", F.to_date(F.lit(start)))
    whole = train_days + test_days
    d = _sweep(bars, lengths, horizon).withColumns({"_day": day, "_exit": exit_day}).where("_day >= 0")
    first = F.greatest(F.lit(0), F.floor((F.col("_day") - whole) / step_days) + 1)
    d = d.withColumn("fold", F.explode(F.sequence(first, F.floor(F.col("_day") / step_days))))
    begin = F.col("fold") * step_days
    train = (F.col("_day") - begin < train_days) & (F.col("_exit") - begin < train_days)
    test = F.col("_day") - begin >= train_days
    part = lambda c: F.when(c, F.col("fwd_ret"))
    stats = d.groupBy("fold", "param").agg(
        F.count(part(train)).alias("n_train"), F.avg(part(train)).alias("train_ret"),
        F.count(part(test)).alias("n_test"), F.avg(part(test)).alias("test_ret"),
        F.avg(F.when(part(test) > 0, 1.0).when(part(test).isNotNull(), 0.0)).alias("test_hit_rate"))
    best = F.struct(F.round("train_ret", 9).alias("ret"), (-F.col("param")).alias("param"))
    row = F.struct("param", "n_train", "train_ret", "n_test", "test_ret", "test_hit_rate")
    won = stats.where(F.col("n_train") > 0).groupBy("fold").agg(F.max_by(row, best).alias("_row"))
    return won.select("fold", F.date_add(F.to_date(F.lit(start)), (F.col("fold") * step_days + train_days).cast("int"))
                      .alias("test_start"), "_row.*")


__all__ = ["next_bar_signals", "relative_strength", "regime", "forward_trades", "performance", "equity_metrics",
           "param_sweep", "walk_forward", "atr_percentile", "Framed"]
