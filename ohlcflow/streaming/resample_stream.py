"""Intraday resample as a Structured Streaming job.

Ticks arrive as a stream (``readStream`` over a landing folder here; any
streaming source with the tick schema works).  The event-time watermark
bounds the state: a bucket is emitted once the watermark passes its end and
its state is dropped; ticks older than the watermark are discarded as late.
The fold per bucket is the same as the batch resample (first/last by time,
max/min, sum), and partial aggregation runs before the state store shuffle.

``run_to_store`` writes what every trigger closes into a folder named after the
trigger's batch id.  Structured Streaming repeats a batch that was not
committed with the same id and the same rows, and the repeat replaces the
folder, so a job that dies between its write and its commit leaves no bucket
twice.  A bucket is closed once, so the folders together are the bars.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resample import MICRO_BITS, fits_micros, micros_in, time_order
from ..schema import TICK_SCHEMA
from ..session import ensure_checkpoint_dir


def read_tick_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(TICK_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def stream_resample(ticks: DataFrame, timeframe: str = "15 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Streaming OHLCV bars per (symbol, bucket) in append mode."""
    t = ticks.withColumn("_ts", F.col("ts").cast("timestamp"))
    window = F.window("_ts", timeframe)
    order = (time_order(micros_in(window, F.col("_ts")), MICRO_BITS, "price", "size") if fits_micros(timeframe)
             else F.struct("_ts", "price", "size"))
    at = F.col("_at")
    agg = (t.withWatermark("_ts", watermark)
            .withColumn("_w", window)
            .withColumn("_at", F.when(F.col("price").isNotNull(), order))
            .groupBy("symbol", "_w")
            # as in the batch fold: NULL prices are skipped, equal times ordered by a hash
            .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"),
                 F.min("price").alias("low"), F.max_by("price", at).alias("close"),
                 F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("volume")))
    return agg.select("symbol", F.col("_w.start").cast("timestamp_ntz").alias("ts"),
                      F.col("_w.end").cast("timestamp_ntz").alias("bucket_end"),
                      "open", "high", "low", "close", "volume")


def _checkpoint_for(spark: SparkSession, sink: str) -> str:
    conf = spark.sparkContext.getConf()
    root = (spark.conf.get("spark.sql.streaming.checkpointLocation", None)
            or spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None))
    if not root:
        # local runs only: ensure_checkpoint_dir refuses a driver-local folder on a cluster
        root = ensure_checkpoint_dir(spark)
    # a stable name (Python's hash() of a string changes between processes)
    return f"{root.rstrip('/')}/stream-resample-{hashlib.sha1(sink.encode()).hexdigest()[:16]}"


def run_to_parquet(spark: SparkSession, source: str, sink: str, *, timeframe: str = "15 minutes",
                   watermark: str = "10 minutes", checkpoint: str | None = None) -> None:
    """Process everything available in ``source`` and append closed buckets to ``sink``.

    Unless given, the checkpoint is a folder named after the sink below the
    session's streaming checkpoint root (``spark.sql.streaming.checkpointLocation``)
    or its shared ``spark.checkpoint.dir``: the same sink maps to the same
    folder in every run, so a restarted job resumes from committed offsets
    and state."""
    ckpt = checkpoint or _checkpoint_for(spark, sink)
    q = (stream_resample(read_tick_stream(spark, source), timeframe, watermark)
         .writeStream.format("parquet").outputMode("append")
         .option("path", sink).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()


STORE_SCHEMA = "symbol string, ts timestamp_ntz, bucket_end timestamp_ntz, open double, high double, low double, " \
               "close double, volume long"


def write_batch(store: str):
    """A ``foreachBatch`` function: the rows of batch n replace the folder ``batch=n`` of ``store``."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{store.rstrip('/')}/batch={batch_id}")
    return write


def run_to_store(spark: SparkSession, source: str, store: str, *, timeframe: str = "15 minutes",
                 watermark: str = "10 minutes", checkpoint: str | None = None,
                 max_files_per_trigger: int | None = None, write=None) -> None:
    """Process what is available in ``source`` and add closed buckets to ``store``, once each.

    Offsets, state and watermark live in the checkpoint (by default one named after the
    store), so the next run goes on where this one stopped, also after a failure."""
    q = (stream_resample(read_tick_stream(spark, source, max_files_per_trigger), timeframe, watermark)
         .writeStream.outputMode("append").foreachBatch(write or write_batch(store))
         .option("checkpointLocation", checkpoint or _checkpoint_for(spark, store))
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_stream_store(spark: SparkSession, store: str) -> DataFrame:
    """The closed buckets of a store that ``run_to_store`` wrote."""
    return spark.read.schema(STORE_SCHEMA).parquet(store).drop("batch")
