"""As-of join: to every left row the last right row at or before its time, without a range join.

The distinct (key, time) pairs of the left side and the right rows are laid into one series
per key and cut into time chunks.  Inside a chunk the last known right value is a running
``last``; what a chunk begins with is carried from one row per (key, chunk), a small written
table.  So no task holds more than a chunk of a key, however long its history, and the left
rows themselves are only equi-joined on (key, time).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_table
from .series import CHUNK, chunk_column


def asof_join(left: DataFrame, right: DataFrame, columns: list[str], *, on: str = "date", by: tuple[str, ...] = (),
              width: int | None = None) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` (of equal ``by``) whose ``on`` is not later.

    Of several right rows at one time the greatest by ``columns`` counts.  Without an earlier
    right row, and for a NULL time or key, the columns are NULL; a value that is NULL in the
    right row stays NULL (it does not reach further back)."""
    keys = [F.col(c) for c in by] or [F.lit(0)]
    names = [f"_by{i}" for i in range(len(keys))]
    own = [k.alias(n) for k, n in zip(keys, names, strict=True)]
    asked = left.select(*own, F.col(on).alias("_on")).distinct().where(F.col("_on").isNotNull())
    known = right.where(F.col(on).isNotNull()).groupBy(*own, F.col(on).alias("_on")).agg(
        F.max(F.struct(*columns)).alias("_value"))
    both = asked.withColumn("_asked", F.lit(True)).join(known, [*names, "_on"], "full")
    both = both.withColumn(CHUNK, chunk_column(both, "_on", width))
    ends = known.withColumn(CHUNK, chunk_column(known, "_on", width)).groupBy(*names, CHUNK).agg(
        F.max_by("_value", "_on").alias("_end"))
    # chunks that are asked about, also where the right side has none
    ends = both.select(*names, CHUNK).distinct().join(ends, [*names, CHUNK], "left")
    before = Window.partitionBy(*names).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    ends = scratch_table(ends.select(*names, CHUNK, F.last("_end", ignorenulls=True).over(before).alias("_carry")),
                         "asof-carry")
    here = Window.partitionBy(*names, CHUNK).orderBy("_on").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_value", ignorenulls=True).over(here)).where("_asked")
    found = found.join(ends, [*names, CHUNK]).select(*names, "_on", F.coalesce("_last", "_carry").alias("_found"))
    rows = left.select("*", *own, F.col(on).alias("_on")).join(found, [*names, "_on"], "left")
    return rows.select(*left.columns, *[F.col(f"_found.{c}").alias(c) for c in columns])
