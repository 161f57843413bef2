"""Bar store: scan, load, save, list (one logical table, partitioned by symbol bucket).

The store is a Parquet table partitioned by a hash bucket of the symbol and
carrying ``symbol`` as a real column.  Thousands of symbols therefore do not
become thousands of directories of small files, a symbol filter still prunes
to one bucket (the bucket predicate is derived from the symbol literal), and
a dynamic partition overwrite replaces only the buckets present in a batch.

What a reader must know to use it - bucket count, time column (``date``, or
``ts`` for intraday bars), whether it is partitioned by timeframe, and the
version of the last save - is a one-row table in the store (``_store``); a
save with another bucket count or time column is refused.

Layouts with the symbol in the *file name* (``<dir>/<SYMBOL>.parquet``) are
read with ``read_symbol_files`` which recovers it from ``_metadata``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BAR_COLUMNS, BAR_SCHEMA, INTRADAY_SCHEMA
from ..session import scratch_table
from .files import stem

BUCKET = "bucket"
TIMEFRAME = "timeframe"
DEFAULT_BUCKETS = 64
# rows per symbol kept in the store's tail table (below the window-group limit
# and above every snapshot lookback of the catalogue: trend 272, RSI(14) 995)
TAIL_ROWS = 1000

META = "buckets int, time_column string, by_timeframe boolean, version string"


def bucket_of(symbol_col, buckets: int = DEFAULT_BUCKETS):
    return F.pmod(F.xxhash64(symbol_col), F.lit(buckets)).cast("int")


def empty_bars(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], BAR_SCHEMA)


def symbol_name(symbol: Column) -> Column:
    return F.upper(F.trim(symbol))


def canonical(df: DataFrame) -> DataFrame:
    """Project to the daily, or with a ``ts`` column the intraday, bar schema with explicit casts."""
    schema = INTRADAY_SCHEMA if "ts" in df.columns and "date" not in df.columns else BAR_SCHEMA
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def _meta_path(path: str) -> str:
    # a leading underscore hides it from reads of the store itself
    return f"{path.rstrip('/')}/_store"


def store_meta(spark: SparkSession, path: str) -> Row | None:
    """The store's description, or None if there is no store."""
    if not _exists(spark, _meta_path(path)):
        return None
    return spark.read.schema(META).parquet(_meta_path(path)).first()


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """All bars of the store; a missing store is a typed empty frame.

    A store of several timeframes has no single series per symbol: use ``read_timeframe``."""
    meta = store_meta(spark, path)
    if meta is None:
        return empty_bars(spark)
    if meta.by_timeframe:
        raise ValueError("this store holds several timeframes: read_timeframe(spark, path, timeframe)")
    return canonical(_read_store(spark, path, meta))


def read_symbol_files(spark: SparkSession, pattern: str) -> DataFrame:
    """S1+S2 for one-file-per-symbol layouts: symbol from the file name; empty if the folder is missing."""
    if not any(c in pattern for c in "*?[{") and not _exists(spark, pattern):
        return empty_bars(spark)
    fields = [f for f in BAR_SCHEMA.fields if f.name != "symbol"]
    df = spark.read.schema(T.StructType(fields)).parquet(pattern)
    sym = stem(F.url_decode(F.col("_metadata.file_path")), ".parquet")
    return canonical(df.withColumn("symbol", sym))


def load_symbol(bars: DataFrame, symbol: str) -> DataFrame:
    """S3 over any frame of bars: those of one symbol (upper-cased), ordered by date."""
    return bars.where(F.col("symbol") == symbol.strip().upper()).select(*BAR_COLUMNS).orderBy("date")


def read_symbol(spark: SparkSession, path: str, symbol: str, timeframe: str | None = None) -> DataFrame:
    """S3: one symbol of a store, ordered by time; a symbol that is not stored is an error.

    Only the symbol's bucket (and the timeframe's partition) is listed and read."""
    meta = store_meta(spark, path)
    if meta is None:
        raise FileNotFoundError(f"no store at {path}")
    if meta.by_timeframe and timeframe is None:
        raise ValueError("this store holds several timeframes: name one")
    sym = symbol.strip().upper()
    rows = _read_store(spark, path, meta).where(
        (F.col(BUCKET) == bucket_of(F.lit(sym), meta.buckets)) & (F.col("symbol") == sym))
    if timeframe is not None:
        rows = rows.where(F.col(TIMEFRAME) == timeframe)
    rows = canonical(rows)
    if rows.isEmpty():
        raise KeyError(f"{sym} is not in the store at {path}")
    return rows.orderBy(meta.time_column)


def save_bars(df: DataFrame, path: str, buckets: int | None = None, timeframe: str | None = None) -> None:
    """S4 (+Q4): replace the full history of every symbol present in ``df``; symbols are upper-cased.

    Dynamic partition overwrite replaces only the touched buckets; rows of
    other symbols sharing a touched bucket are carried over by reading the
    bucket first (a left-anti join on symbol keeps them).  With ``timeframe``
    (``1d``, ``15min`` ...) the store is partitioned by timeframe first, so
    several histories of a symbol live side by side and each prunes to itself.
    Bars with a ``ts`` column make an intraday store, which keeps the time.
    A store has one writer at a time: two simultaneous saves replace each other's version.
    """
    spark = df.sparkSession
    rows = canonical(df)
    time = "ts" if "ts" in rows.columns else "date"
    meta = store_meta(spark, path)
    if meta is not None:
        if buckets not in (None, meta.buckets):
            raise ValueError(f"the store has {meta.buckets} buckets, not {buckets}")
        if meta.time_column != time or meta.by_timeframe != (timeframe is not None):
            raise ValueError("the store holds bars of another time column or without / with timeframes")
    buckets = meta.buckets if meta is not None else buckets or DEFAULT_BUCKETS
    rows = rows.withColumn("symbol", symbol_name(F.col("symbol")))
    new = rows.withColumn(BUCKET, bucket_of(F.col("symbol"), buckets))
    parts = [BUCKET]
    if timeframe is not None:
        new = new.withColumn(TIMEFRAME, F.lit(timeframe))
        parts = [TIMEFRAME, BUCKET]
    if meta is not None:
        new = scratch_table(new, "store-new")  # read for its partitions, its symbols and the write
        old = _read_store(spark, path, meta)
        # written: both joins then broadcast on its measured size, and the store is not shuffled for them
        names = scratch_table(new.select(*parts, "symbol").distinct(), "store-symbols")
        keep = (old.join(names.select(*parts).distinct(), parts, "left_semi")
                   .join(names.select("symbol"), "symbol", "left_anti"))
        # written before the files it was read from are replaced
        keep = scratch_table(keep, "store-keep")
        new = new.unionByName(keep.select(*new.columns))
    tail = _tail_version(spark, path) is not None
    version = uuid.uuid4().hex
    # the new version is announced first: a tail that a failed save leaves behind no longer matches
    spark.createDataFrame([(buckets, time, timeframe is not None, version)], META).coalesce(1).write.mode(
        "overwrite").parquet(_meta_path(path))
    # A bucket may hold a hot symbol, so each bucket is spread over its years
    # (one task per bucket-year, not per bucket).  Rows are written in date
    # order, so row groups carry narrow date ranges and a scan that needs only
    # recent bars (the snapshot plan's date cut-off) skips the old ones.
    (new.repartition(*parts, F.year(time))
        .sortWithinPartitions(time, "symbol")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts).parquet(path))
    if tail:
        # keep the tail table in step: the touched partitions' symbols are all in ``new``
        (tail_of(new, keys=_tail_keys(new), order=time).repartition(*parts).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*parts).parquet(tail_path(path)))
        _write_tail_version(spark, path, version)


# ---------------------------------------------------------------------------
# Tail table: the last TAIL_ROWS bars of every symbol, for latest-bar scans
# ---------------------------------------------------------------------------

def tail_path(path: str) -> str:
    # a leading underscore hides it from reads of the store itself
    return f"{path.rstrip('/')}/_tail{TAIL_ROWS}"


def _tail_version(spark: SparkSession, path: str) -> str | None:
    """Version of the store that its tail table was built from, or None."""
    at = f"{tail_path(path)}/_version"
    return spark.read.schema("version string").parquet(at).first().version if _exists(spark, at) else None


def _write_tail_version(spark: SparkSession, path: str, version: str) -> None:
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(
        f"{tail_path(path)}/_version")


def _tail_keys(df: DataFrame) -> tuple[str, ...]:
    return (TIMEFRAME, "symbol") if TIMEFRAME in df.columns else ("symbol",)


def tail_of(bars: DataFrame, rows: int | None = None, keys: tuple[str, ...] = ("symbol",),
            order: str = "date") -> DataFrame:
    """At least the last ``rows`` bars of every symbol (whole time chunks).

    Chosen by the snapshot framing's chunk statistics and a broadcast join,
    not by a per-symbol top-k over the history, so a hot symbol never meets
    one task with its whole history."""
    from ..operators.series import frame
    fr = frame(bars, (rows or TAIL_ROWS) - 1, keys=keys, order=order, latest=True)
    return fr.df.select(*bars.columns)


def build_tail(spark: SparkSession, path: str) -> None:
    """(Re)build the tail table of the store at ``path``; ``save_bars`` keeps it current after that."""
    meta = store_meta(spark, path)
    store = _read_store(spark, path, meta)
    parts = [TIMEFRAME, BUCKET] if meta.by_timeframe else [BUCKET]
    (tail_of(store, keys=_tail_keys(store), order=meta.time_column).repartition(*parts).write.mode("overwrite")
        .partitionBy(*parts).parquet(tail_path(path)))
    _write_tail_version(spark, path, meta.version)


def snapshot_bars(spark: SparkSession, path: str, lookback: int, timeframe: str | None = None) -> DataFrame:
    """Bars for a latest-bar scan whose indicators look back ``lookback`` rows.

    The tail table when it exists, covers the lookback and belongs to the store's
    present version (a scan over it gives the same latest-bar values as over the
    whole store), else the store.  ``timeframe`` picks one timeframe."""
    meta = store_meta(spark, path)
    if meta is not None and lookback < TAIL_ROWS and _tail_version(spark, path) == meta.version:
        if meta.by_timeframe and timeframe is None:
            raise ValueError("this store holds several timeframes: name one")
        tail = _read_store(spark, tail_path(path), meta)
        return canonical(tail if timeframe is None else tail.where(F.col(TIMEFRAME) == timeframe))
    return read_timeframe(spark, path, timeframe) if timeframe is not None else read_bars(spark, path)


def _read_store(spark: SparkSession, path: str, meta: Row) -> DataFrame:
    """The raw store with partition columns typed explicitly (no inference: '1d' is not a number)."""
    fields = list((INTRADAY_SCHEMA if meta.time_column == "ts" else BAR_SCHEMA).fields)
    if meta.by_timeframe:
        fields.append(T.StructField(TIMEFRAME, T.StringType(), True))
    fields.append(T.StructField(BUCKET, T.IntegerType(), True))
    return spark.read.schema(T.StructType(fields)).parquet(path)


def read_timeframe(spark: SparkSession, path: str, timeframe: str) -> DataFrame:
    """Q4: the bars of one timeframe (partition-pruned)."""
    meta = store_meta(spark, path)
    if meta is None:
        return empty_bars(spark)
    return canonical(_read_store(spark, path, meta).where(F.col(TIMEFRAME) == timeframe))


def list_symbols(bars: DataFrame) -> DataFrame:
    """Distinct stored symbols, sorted."""
    return bars.select("symbol").distinct().orderBy("symbol")


def symbols_present(requested: DataFrame, bars: DataFrame) -> DataFrame:
    """Requested symbols that exist in the store (left semi join)."""
    return requested.join(bars.select("symbol").distinct(), "symbol", "left_semi")


def symbols_missing(requested: DataFrame, bars: DataFrame) -> DataFrame:
    """Requested symbols absent from the store (left anti join)."""
    return requested.join(bars.select("symbol").distinct(), "symbol", "left_anti")


def _requested(spark: SparkSession, path: str, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requested symbols with their bucket, the store's symbols of those buckets)."""
    meta = store_meta(spark, path)
    if meta is None:
        raise FileNotFoundError(f"no store at {path}")
    # written, so that its size decides about the broadcast that prunes the store's buckets while it runs
    asked = scratch_table(requested.withColumn("_name", symbol_name(F.col("symbol"))).withColumn(
        "_bucket", bucket_of(F.col("_name"), meta.buckets)), "store-requested")
    # the planner prunes partitions dynamically only for a side that has a filter
    wanted = asked.where(F.col("_bucket") >= 0).select("_bucket").distinct()
    store = _read_store(spark, path, meta).join(wanted, F.col(BUCKET) == F.col("_bucket"), "left_semi")
    return asked, store.select(F.col("symbol").alias("_stored"), F.col(BUCKET).alias("_in")).distinct()


def store_has(spark: SparkSession, path: str, requested: DataFrame) -> DataFrame:
    """S6 against a store: the rows of ``requested`` whose ``symbol`` (any case, trimmed) is stored.

    The buckets of the requested symbols prune the store's partitions at run time, so only
    those buckets are read."""
    asked, stored = _requested(spark, path, requested)
    return asked.join(stored, (F.col("_bucket") == F.col("_in")) & (F.col("_name") == F.col("_stored")),
                      "left_semi").select(*requested.columns)


def store_lacks(spark: SparkSession, path: str, requested: DataFrame) -> DataFrame:
    """S6 against a store: the rows of ``requested`` whose ``symbol`` is not stored (a NULL symbol is not)."""
    asked, stored = _requested(spark, path, requested)
    return asked.join(stored, (F.col("_bucket") == F.col("_in")) & (F.col("_name") == F.col("_stored")),
                      "left_anti").select(*requested.columns)


def save_bucketed(df: DataFrame, table: str, path: str, buckets: int = DEFAULT_BUCKETS) -> None:
    """S4 as a table that Spark itself buckets by symbol and sorts by date (files below ``path``).

    Windows and aggregations by symbol over it need no exchange of the bars.  A symbol lives
    in one bucket, so this is for stores whose symbols are small beside a bucket; others keep
    ``save_bars`` and its framing by (symbol, time)."""
    rows = canonical(df).withColumn("symbol", symbol_name(F.col("symbol")))
    time = "ts" if "ts" in rows.columns else "date"
    (rows.repartition(buckets, "symbol").write.mode("overwrite").bucketBy(buckets, "symbol").sortBy("symbol", time)
         .option("path", path).format("parquet").saveAsTable(table))


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    """S1 over a table of ``save_bucketed``."""
    return canonical_columns(spark.table(table))


def canonical_columns(df: DataFrame) -> DataFrame:
    """The bar columns as they are: a cast or rename would hide the table's bucketing from the planner."""
    schema = INTRADAY_SCHEMA if "ts" in df.columns and "date" not in df.columns else BAR_SCHEMA
    return df.select(*[f.name for f in schema.fields])


def head(bars: DataFrame, symbol: str, n: int = 10) -> DataFrame:
    """First ``n`` bars of a symbol in date order."""
    return load_symbol(bars, symbol).limit(n)


def head_each(bars: DataFrame, n: int = 10) -> DataFrame:
    """S9 for every symbol at once: the first ``n`` bars of each symbol.

    ``row_number <= n`` is planned with a partial window-group limit before
    the shuffle, so at most ``n`` rows per symbol per map task move."""
    w = Window.partitionBy("symbol").orderBy("date")
    return bars.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
