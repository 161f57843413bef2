"""Skew-safe framing of per-symbol series for row-counted windows.

Indicators are defined over *rows* of one symbol ordered by date (rolling
means over N rows, shifts by N rows, exponential smoothing).  The obvious
plan, ``Window.partitionBy("symbol")``, puts every row of a symbol into one
task; if one symbol held a third of the data that task would hold a third of
the data.  This module bounds the group size instead:

1. Each row gets a time *chunk* (``floor(date / width)``).  A small table of
   row counts per (symbol, chunk) is aggregated (map-side partial
   aggregation, so a hot symbol is reduced inside each map task), then turned
   into cumulative row offsets with a window over that small table.  It is
   written to the checkpoint folder, which cuts lineage and lets the planner
   broadcast it on its measured file size (shuffle join beyond the limit).
2. Chunks are grouped into *partitions* of about ``span`` rows
   (``floor(start / span)``).  Every partition also receives, as read-only
   halo, the chunks holding the ``lookback`` rows just before it, so every
   window with at most ``lookback`` preceding rows is exact inside the
   partition.  Rows are shuffled once on (symbol, partition), into one task for
   about every ``ROWS_PER_TASK`` of them, so a task's sorts do not grow with the input.
3. Inside a partition the global row index ``_i`` is the partition's first
   offset plus ``row_number``; indicator code uses it for warm-up and EWM
   alignment.  ``finish`` keeps only owned rows, so every input row comes out
   exactly once.

``latest=True`` builds a single partition per symbol holding only the last
chunk plus its halo: the snapshot plan reads the tail of each history, not
the whole history.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import once, scratch_table

CHUNK = "_chunk"
START = "_start"
END = "_end"
TOTAL = "_total"
PART = "_part"
OWN = "_own"
IDX = "_i"
_P_LO = "_p_lo"
_P_HI = "_p_hi"
HELPERS = (CHUNK, START, END, TOTAL, PART, OWN, IDX, _P_LO, _P_HI)
# shared intermediate columns of rolling windows and EWMs; dropped by ``finish``
TABLE_PREFIX = "_t_"

DEFAULT_DATE_WIDTH_DAYS = 64
DEFAULT_TS_WIDTH_SECONDS = 3600
MIN_SPAN_ROWS = 4096
#: Framed rows that one task windows over: its sorts hold some 2 KB of each.
ROWS_PER_TASK = 1 << 18


def chunk_column(df: DataFrame, order: str, width: int | None = None) -> Column:
    """Integer time chunk of the ordering column (dates: days, timestamps: seconds)."""
    dtype = df.schema[order].dataType
    c = F.col(order)
    if isinstance(dtype, T.DateType):
        return F.floor(F.unix_date(c) / (width or DEFAULT_DATE_WIDTH_DAYS))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        w = (width or DEFAULT_TS_WIDTH_SECONDS) * 1_000_000
        return F.floor(F.unix_micros(c.cast("timestamp")) / w)
    return F.floor(c / (width or 1))


def chunk_start(df: DataFrame, order: str, chunk: int, width: int | None = None) -> Column:
    """The first ordering value of ``chunk`` (inverse of ``chunk_column``), as a foldable Column."""
    dtype = df.schema[order].dataType
    if isinstance(dtype, T.DateType):
        return F.date_from_unix_date(F.lit(chunk * (width or DEFAULT_DATE_WIDTH_DAYS)))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        w = (width or DEFAULT_TS_WIDTH_SECONDS) * 1_000_000
        return F.timestamp_micros(F.lit(chunk * w)).cast(dtype)
    return F.lit(chunk * (width or 1))


@dataclass(frozen=True)
class Framed:
    """A framed series: ``df`` carries the helper columns listed in ``HELPERS``."""

    df: DataFrame
    keys: tuple[str, ...]
    order: str
    lookback: int
    # symbols (one row each) whose ``flat`` column is constant over a whole halo, or None
    flat: DataFrame | None = None

    @cached_property
    def window(self) -> Window:
        # built once: every indicator column reuses this spec
        return Window.partitionBy(*self.keys, PART).orderBy(self.order)

    def rows(self, n: int) -> Window:
        """Frame of the current row and the ``n - 1`` rows before it."""
        return self.window.rowsBetween(-(n - 1), 0)

    @cached_property
    def running(self) -> Window:
        return self.window.rowsBetween(Window.unboundedPreceding, 0)

    def sub_window(self, sub_col: str) -> Window:
        return (Window.partitionBy(*self.keys, PART, sub_col).orderBy(self.order)
                .rowsBetween(Window.unboundedPreceding, 0))

    def with_df(self, df: DataFrame) -> "Framed":
        return Framed(df, self.keys, self.order, self.lookback, self.flat)

    @staticmethod
    def is_latest() -> Column:
        return F.col(IDX) == F.col(TOTAL) - 1

    def finish(self, df: DataFrame | None = None) -> DataFrame:
        out = (df if df is not None else self.df).where(F.col(OWN))
        return out.drop(*[c for c in out.columns if c in HELPERS or c.startswith(TABLE_PREFIX)])


def frame(df: DataFrame, lookback: int, *, keys: tuple[str, ...] = ("symbol",),
          order: str = "date", width: int | None = None, span: int | None = None,
          latest: bool = False, materialize: bool | None = None, flat: str | None = None) -> Framed:
    """Frame ``df`` so that windows with up to ``lookback`` preceding rows are exact.

    With ``flat`` (a column) the chunk statistics also tell where that column stands
    still for a whole lookback: a ``latest`` frame then reaches back to ``lookback`` rows
    before its last change, another frame lists the symbols concerned (``Framed.flat``).

    The input is read twice (chunk statistics, then the rows).  If it is
    itself the result of a shuffle (bars aggregated from trades, say) it is
    written once to the checkpoint folder first (``materialize=None`` decides
    from the plan) instead of being recomputed."""
    keys = tuple(keys)
    h = max(int(lookback), 0)
    df = scratch_table(df, "series-input") if materialize else df if materialize is False else once(df, "series-input")
    base = df.withColumn(CHUNK, chunk_column(df, order, width))

    still = [] if flat is None else [F.min(flat).alias("_low"), F.max(flat).alias("_high"),
                                     F.count(flat).alias("_known")]
    counts = base.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"), *still)
    wk = Window.partitionBy(*keys).orderBy(CHUNK)
    stats = (counts
             .withColumn(END, F.sum("_n").over(wk.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn(START, F.col(END) - F.col("_n"))
             .withColumn(TOTAL, F.sum("_n").over(Window.partitionBy(*keys))))
    moved = F.lit(True)
    if flat is not None:
        # a chunk in which the column changes, or whose value is not that of the chunk before
        moved = ~(F.col("_low").eqNullSafe(F.col("_high")) & (F.col("_known") == F.col("_n"))
                  & F.col("_low").eqNullSafe(F.lag("_high").over(wk)))
        stats = stats.withColumn("_moved", moved)
        moved = F.col("_moved")
    if latest:
        last_start = F.max(START).over(Window.partitionBy(*keys))
        last_moved = F.max(F.when(moved, F.col(START))).over(Window.partitionBy(*keys))
        stats = (stats.withColumn("_last_start", last_start)
                 .withColumn("_reach", F.least(last_start, F.coalesce(last_moved, last_start)))
                 .where(F.col(END) + F.lit(h) > F.col("_reach"))
                 .select(*keys, CHUNK, START, TOTAL,
                         F.lit(0).cast("long").alias(_P_LO), F.lit(0).cast("long").alias(_P_HI),
                         (F.col(START) == F.col("_last_start")).alias("_own_chunk")))
    else:
        s = int(span or max(8 * h, MIN_SPAN_ROWS))
        if flat is not None:
            # rows since the start of the last chunk that moved; a long stretch may cross a partition
            since = F.max(F.when(moved, F.col(END))).over(wk.rowsBetween(Window.unboundedPreceding, 0))
            stats = stats.withColumn("_stretch", F.col(END) - since)
        p = F.floor(F.col(START) / s)
        p_hi = F.greatest(p, F.floor((F.col(END) - 1 + F.lit(h)) / s))
        stats = stats.select(*keys, CHUNK, START, TOTAL, p.cast("long").alias(_P_LO),
                             p_hi.cast("long").alias(_P_HI), F.lit(True).alias("_own_chunk"),
                             (F.col("_n") * (p_hi - p + 1)).alias("_framed"),
                             *([] if flat is None else ["_stretch"]))
    stats = scratch_table(stats, "series-chunks")
    flat_keys, tasks = None, 1
    if not latest:
        # a number of tasks in proportion to the rows, whatever the session's number of shuffle partitions
        tasks = -(-(stats.agg(F.sum("_framed")).first()[0] or 0) // ROWS_PER_TASK)
        stats = stats.drop("_framed")
    if flat is not None and not latest:
        # a stretch may span chunks only in part: half a lookback of whole chunks is the least sign of one
        long = stats.where(F.col("_stretch") * 2 >= h).select(*keys).distinct()
        stats = stats.drop("_stretch")
        if not long.isEmpty():
            flat_keys = long
    if latest:
        # No kept chunk starts before the earliest kept chunk, so this bound
        # drops no needed row.  It folds to a literal of the ordering column's
        # type, reaches the Parquet scan as a pushed filter and skips the row
        # groups of old history (the store writes rows in date order).
        first = stats.agg(F.min(CHUNK)).first()[0]
        if first is not None:
            base = base.where(F.col(order) >= chunk_start(df, order, int(first), width))

    joined = base.join(stats, [*keys, CHUNK], "inner")
    if latest:
        joined = joined.withColumn(PART, F.col(_P_LO)).withColumn(OWN, F.col("_own_chunk"))
    else:
        joined = (joined.withColumn(PART, F.explode(F.sequence(F.col(_P_LO), F.col(_P_HI))))
                  .withColumn(OWN, F.col(PART) == F.col(_P_LO)))
    joined = joined.drop("_own_chunk")
    if tasks > 1:
        joined = joined.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), *keys, PART)
    # partitions hold contiguous chunks, so the first row's offset is the partition's;
    # first() and row_number() share one window spec -> one sort, one Window operator
    wo = Window.partitionBy(*keys, PART).orderBy(order)
    joined = joined.withColumn(IDX, F.first(START).over(wo) + F.row_number().over(wo) - 1)
    return Framed(joined, keys, order, h, flat_keys)


# ---------------------------------------------------------------------------
# Window building blocks used by the indicator catalogue
# ---------------------------------------------------------------------------

def roll(fr: Framed, agg, col: Column | str, n: int) -> Column:
    """``agg`` over the last ``n`` rows; NULL until ``n`` non-null values exist."""
    c = F.col(col) if isinstance(col, str) else col
    w = fr.rows(n)
    return F.when(F.count(c).over(w) == n, agg(c).over(w))


def lag(fr: Framed, col: Column | str, k: int = 1, depth: int = 0) -> Column:
    """``col`` ``k`` rows earlier; ``depth`` is the number of rows ``col`` itself looks back.

    A partition holds ``fr.lookback`` rows before its first own row, so a deeper
    value would silently be NULL there: it is refused instead."""
    if k + depth > fr.lookback:
        raise ValueError(f"a lag of {k} over {depth} rows needs more than the {fr.lookback} framed rows")
    return F.lag(col, k).over(fr.window)


EWM_EPS = 1e-16


def ewm_block(alpha: float) -> int:
    """Rows after which older terms weigh less than ``EWM_EPS`` (relative)."""
    if alpha >= 1.0:
        return 1
    return int(math.ceil(math.log(EWM_EPS) / math.log(1.0 - alpha)))


def ewm_lookback(alpha: float) -> int:
    return 2 * ewm_block(alpha)


def ewm_order(fr: Framed, df: DataFrame, alpha: float) -> tuple[DataFrame, Window]:
    """Add the block number / position columns of ``alpha``'s block size (shared by
    every EWM with that size) and return the framed window ordered by (block, date).

    That order is the date order, but it is also the order the block-local
    sums need, so lags taken over it (RSI's and ATR's previous close) ride
    on the same sort instead of forcing a re-sort to date order."""
    b = ewm_block(alpha)
    sub, j = f"{TABLE_PREFIX}ewsub{b}", f"{TABLE_PREFIX}ewj{b}"
    if sub not in df.columns:
        df = (df.withColumn(sub, F.floor(F.col(IDX) / b))
                .withColumn(j, F.col(IDX) - F.col(sub) * b))
    return df, Window.partitionBy(*fr.keys, PART).orderBy(sub, fr.order)


def ewm(fr: Framed, df: DataFrame, x: str, alpha: float, out: str) -> DataFrame:
    """Non-adjusted exponential smoothing: y0 = x0, yt = a*xt + (1-a)*y(t-1).

    Rows are cut into blocks of ``B`` rows on the global index.  Inside a block
    a running sum of ``w*x*d^-j`` rescaled by ``d^j`` gives the block-local
    value; the previous block's last local value (the block-carry) is added
    with weight ``d^(j+1)``.  Terms older than one block weigh < 1e-16, so the
    result equals the full recursion to double precision while every sum
    stays bounded.  Needs ``2B`` rows of lookback (``ewm_lookback``).

    A NULL input has no defined weight: results are NULL from it on, until it
    lies behind the block before the current one and weighs nothing.
    """
    if alpha >= 1.0:
        return df.withColumn(out, F.col(x).cast("double"))
    d = 1.0 - alpha
    b = ewm_block(alpha)
    df, order = ewm_order(fr, df, alpha)
    sub, j, part = f"{TABLE_PREFIX}ewsub{b}", f"{TABLE_PREFIX}ewj{b}", f"{out}__part"
    w = F.when(F.col(IDX) == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    local = F.pow(F.lit(d), F.col(j)) * F.sum(w * F.col(x) * F.pow(F.lit(d), -F.col(j))).over(fr.sub_window(sub))
    whole = F.count_if(F.col(x).isNull()).over(fr.sub_window(sub)) == 0
    df = df.withColumn(part, F.struct(local.alias("y"), whole.alias("whole")))
    # ordered by (block, date): the same sort as the block-local sums above
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    carry = F.last(F.when(F.col(j) == b - 1, F.col(part)), ignorenulls=True).over(before)
    df = df.withColumn(f"{part}_carry", carry)
    value = F.col(f"{part}.y") + F.pow(F.lit(d), F.col(j) + 1) * F.coalesce(F.col(f"{part}_carry.y"), F.lit(0.0))
    valid = F.col(f"{part}.whole") & F.coalesce(F.col(f"{part}_carry.whole"), F.lit(True))
    return df.withColumn(out, F.when(valid, value)).drop(part, f"{part}_carry")


# Spark evaluates a sliding ROWS frame by re-aggregating the whole frame for
# every row (O(rows x width)).  Wide frames (sum / avg / max / min over n rows)
# are cut into blocks instead: a native frame over the last b rows (S_b) is
# read back at offsets 0, b, 2b, ... by lag(), and the n mod b rows left over
# are one more short native frame.  Measured on local[8]: one window frame
# (a lag included) costs about as much per row as ten aggregate updates, so
# a row costs about 10 n/b + b + (n mod b) update-equivalents, least near
# b = sqrt(10 n); for the trend template (windows of 50..252 rows, sf0.1,
# interleaved runs) that is 1.3 s instead of 2.8 s over every bar.  The parts
# are disjoint, so sums are plain sums of partial sums: no running-sum
# subtraction (no cancellation), and NaN or infinities outside the window
# cannot leak in.  S_b and the running non-null count are shared by all
# windows over the same input (one b = 48 for widths up to ~300 rows, so
# sma_50 / sma_150 / sma_200 share one S_b) and are dropped by ``Framed.finish``.
NATIVE_FRAME_MAX_ROWS = 32
MIN_BLOCK_ROWS = 48
BLOCK_STEP = 16
_NATIVE = {"avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min}


def block_rows(n: int) -> int:
    """b ~ sqrt(10 n), in steps of ``BLOCK_STEP`` so that nearby widths share a block."""
    return max(MIN_BLOCK_ROWS, BLOCK_STEP * round(math.sqrt(10 * n) / BLOCK_STEP))


def rolling(fr: Framed, df: DataFrame, agg: str, col: Column | str, n: int, out: str,
            skip: int = 0) -> DataFrame:
    """Add ``out`` = ``agg`` over the ``n`` rows ending ``skip`` rows before the current one.

    NULL until all ``n`` rows hold a non-null value (the ``roll`` rule)."""
    if agg not in _NATIVE:
        raise ValueError(f"unsupported rolling aggregate {agg!r}")
    c = F.col(col) if isinstance(col, str) else col
    if n <= NATIVE_FRAME_MAX_ROWS:
        w = fr.window.rowsBetween(-(n - 1) - skip, -skip)
        return df.withColumn(out, F.when(F.count(c).over(w) == n, _NATIVE[agg](c).over(w)))
    part_agg = "sum" if agg in ("avg", "sum") else agg
    x = c.cast("double") if part_agg == "sum" else c
    fn = _NATIVE[part_agg]
    # shared parts are named after the input column (after ``out`` for expressions)
    src = col if isinstance(col, str) else out
    b = block_rows(n)
    block, cnt = f"{TABLE_PREFIX}{part_agg}{b}_{src}", f"{TABLE_PREFIX}n_{src}"
    q, r = divmod(n, b)
    rest = f"{out}__rest"
    parts = {}
    if block not in df.columns:
        parts[block] = fn(x).over(fr.window.rowsBetween(-(b - 1), 0))
    if cnt not in df.columns:
        parts[cnt] = F.count(x).over(fr.running)
    if r:
        parts[rest] = fn(x).over(fr.window.rowsBetween(-(n - 1) - skip, -(q * b) - skip))
    df = df.withColumns(parts)

    def at(name: str, offset: int) -> Column:
        # the running count is read one row before the frame (0 where that is no row)
        return F.col(name) if offset == 0 else F.lag(name, offset).over(fr.window)

    terms = [at(block, skip + j * b) for j in range(q)] + ([F.col(rest)] if r else [])
    if part_agg == "sum":
        value = terms[0]
        for t in terms[1:]:
            value = value + t
        if agg == "avg":
            value = value / F.lit(float(n))
    else:
        value = (F.greatest if agg == "max" else F.least)(*terms)
    full = (at(cnt, skip) - F.coalesce(at(cnt, skip + n), F.lit(0))) == n
    return df.withColumn(out, F.when(full, value)).drop(rest)


#: Rows of a sub-block of ``sliding_share``.
SUB_BLOCK = 16


def sliding_share(fr: Framed, df: DataFrame, col: str, n: int, out: str) -> DataFrame:
    """Add ``out``: the share of the last ``n`` rows (this one included) whose ``col`` is at most this row's.

    A sliding rank without an array a row.  Rows are cut into blocks of ``n``, so the window of
    a row is the beginning of its own block and the rest of the block before.  Two
    neighbouring blocks are sorted together by value, once paired (0, 1), (2, 3) ... and once
    (1, 2), (3, 4) ...; running counts by sub-block of ``SUB_BLOCK`` rows then tell every row how
    many smaller values each sub-block of either block holds.  Whole sub-blocks inside the
    window are added up, and of the two that the window cuts the rows are compared one by one.
    A row costs two sorts and some ``3 n / SUB_BLOCK + 2 SUB_BLOCK`` updates.  NULL until all ``n`` rows
    hold a value."""
    p = f"{TABLE_PREFIX}{out}_"
    x = F.col(col)
    subs = range(-(-n // SUB_BLOCK))
    block, pos, sub = F.col(f"{p}block"), F.col(f"{p}pos"), F.col(f"{p}sub")
    df = df.withColumn(f"{p}block", F.floor(F.col(IDX) / n)).withColumn(f"{p}pos", (F.col(IDX) - block * n).cast("int"))
    df = df.withColumn(f"{p}sub", F.floor(pos / SUB_BLOCK).cast("int"))
    counts, pairs = {}, {}
    for shift in (0, 1):
        pairs[f"{p}pair{shift}"] = F.floor((block + shift) / 2)
    df = df.withColumns(pairs)
    for shift in (0, 1):
        w = Window.partitionBy(*fr.keys, PART, f"{p}pair{shift}").orderBy(col)  # a range: equal values count
        late = (block + shift) % 2 == 1
        for t in subs:
            counts[f"{p}a{shift}_{t}"] = F.count(F.when(~late & (sub == t), x)).over(w)
            if not shift:
                counts[f"{p}b_{t}"] = F.count(F.when(late & (sub == t), x)).over(w)
    counted = df.withColumns(counts)
    odd = block % 2 == 1

    def total(names, inside) -> Column:
        terms = [F.when(inside(t), F.col(f"{p}{names}_{t}")).otherwise(0) for t in subs]
        return functools.reduce(lambda a, b: a + b, terms)

    own = F.when(odd, total("b", lambda t: sub > t)).otherwise(total("a0", lambda t: sub > t))
    before = F.when(odd, total("a0", lambda t: sub < t)).otherwise(total("a1", lambda t: sub < t))
    counted = counted.withColumn(f"{p}whole", own + before).drop(*counts, *pairs)
    rest = pos % SUB_BLOCK
    below = lambda k, inside: F.when(inside & (F.lag(col, k).over(fr.window) <= x), 1).otherwise(0)
    cut = [below(k, rest >= k) for k in range(1, SUB_BLOCK)]
    cut += [below(n - d, (rest + d < SUB_BLOCK) & (pos + d < n)) for d in range(1, min(SUB_BLOCK, n))]
    known = F.count(col).over(fr.running)
    counted = counted.withColumn(f"{p}known", known).withColumn(
        f"{p}cut", functools.reduce(lambda a, b: a + b, cut, F.lit(1)))
    full = F.col(f"{p}known") - F.coalesce(F.lag(f"{p}known", n).over(fr.window), F.lit(0)) == n
    share = (F.col(f"{p}whole") + F.col(f"{p}cut")) / F.lit(float(n))
    return counted.withColumn(out, F.when(full, share))
