import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ohlcflow.operators.resample import ticks_to_bars
from ohlcflow.sources.derived import ticks_from_events
from ohlcflow.streaming import resample_stream as RS
from ohlcflow.streaming.resample_stream import run_to_parquet


def test_stream_resample_matches_batch_for_closed_windows(spark):
    ticks = ticks_from_events(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="stream-")
    src, sink = os.path.join(root, "in"), os.path.join(root, "out")
    # three landing files arriving over time
    ticks = ticks.withColumn("_part", F.pmod(F.hash("symbol", "ts"), F.lit(3)))
    for i in range(3):
        ticks.where(F.col("_part") == i).drop("_part").coalesce(1).write.parquet(os.path.join(src, f"batch={i}"))
    run_to_parquet(spark, os.path.join(src, "*"), sink, checkpoint=os.path.join(root, "ckpt"))
    got = spark.read.parquet(sink).drop("bucket_end")
    batch = ticks_to_bars(ticks.drop("_part"), "15 minutes")
    max_ts = ticks.agg(F.max("ts")).first()[0]
    closed = batch.where(F.col("ts") + F.expr("INTERVAL 15 MINUTES") <= F.lit(max_ts) - F.expr("INTERVAL 10 MINUTES"))
    assert got.count() > 0
    assert got.exceptAll(closed).count() == 0 and closed.exceptAll(got).count() == 0


def test_restarted_stream_resumes_from_its_default_checkpoint(spark):
    """Two runs on a growing landing folder: the second resumes (same sink -> same checkpoint)."""
    ticks = ticks_from_events(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="stream-resume-")
    src, sink = os.path.join(root, "in"), os.path.join(root, "out")
    cut = ticks.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).first()[0]
    early = ticks.where(F.unix_micros(F.col("ts").cast("timestamp")) <= cut)
    late = ticks.where(F.unix_micros(F.col("ts").cast("timestamp")) > cut)
    early.coalesce(1).write.parquet(os.path.join(src, "batch=0"))
    run_to_parquet(spark, os.path.join(src, "*"), sink)
    first = spark.read.parquet(sink).count()
    late.coalesce(1).write.parquet(os.path.join(src, "batch=1"))
    run_to_parquet(spark, os.path.join(src, "*"), sink)
    got = spark.read.parquet(sink).drop("bucket_end")
    assert got.count() > first
    # every bucket once, and equal to the batch fold wherever the final watermark closed it
    assert got.groupBy("symbol", "ts").count().where(F.col("count") > 1).count() == 0
    batch = ticks_to_bars(ticks, "15 minutes")
    max_ts = ticks.agg(F.max("ts")).first()[0]
    closed = batch.where(F.col("ts") + F.expr("INTERVAL 15 MINUTES") <= F.lit(max_ts) - F.expr("INTERVAL 10 MINUTES"))
    assert got.exceptAll(closed).count() == 0 and closed.exceptAll(got).count() == 0


def test_killed_batch_leaves_the_same_store(spark):
    """A job that dies after its write and before its commit, then runs again: no bucket twice, none lost."""
    import pytest
    ticks = ticks_from_events(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="stream-killed-")
    src = os.path.join(root, "in")
    ticks.repartition(3).write.parquet(os.path.join(src, "delivery=0"))
    stores = {name: os.path.join(root, name) for name in ("killed", "whole")}

    def dying(df, batch_id):
        RS.write_batch(stores["killed"])(df, batch_id)
        raise RuntimeError("lost before the commit")

    run = lambda name, **kw: RS.run_to_store(
        spark, os.path.join(src, "*"), stores[name], checkpoint=os.path.join(root, f"ckpt-{name}"),
        max_files_per_trigger=1, **kw)
    for _ in range(2):
        with pytest.raises(Exception):
            run("killed", write=dying)
    run("killed")
    run("whole")
    # a second delivery: both jobs go on
    ticks.withColumn("ts", F.col("ts") + F.expr("INTERVAL 40 DAYS")).limit(200).coalesce(1).write.parquet(
        os.path.join(src, "delivery=1"))
    for name in stores:
        run(name)
    killed, whole = (RS.read_stream_store(spark, stores[n]) for n in ("killed", "whole"))
    assert whole.count() > 100
    assert killed.exceptAll(whole).count() == 0 and whole.exceptAll(killed).count() == 0
    assert killed.groupBy("symbol", "ts").count().where("count > 1").count() == 0
