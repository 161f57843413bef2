"""ohlcflow: screening and reshaping OHLCV market bars on Spark.

Public surface:

* ``ohlcflow.session``        SparkSession helpers, scratch tables in the checkpoint folder
* ``ohlcflow.schema``         canonical bar / tick schemas
* ``ohlcflow.sources``        bar store, CSV landing ingest, bars derived from the test tables
* ``ohlcflow.functions``      column-level helpers (period strings, calendar buckets, safe math)
* ``ohlcflow.operators``      series framing, indicators, latest row, resampling, liquidity, quality
* ``ohlcflow.plans``          predicates, scan specs, the end-to-end scan and batch scans
* ``ohlcflow.streaming``      streaming resample with a watermark
"""

__version__ = "0.1.0"
