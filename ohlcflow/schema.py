"""Canonical schemas.  Ingest casts explicitly to these; nothing infers types."""

from pyspark.sql import types as T

BAR_COLUMNS = ("symbol", "date", "open", "high", "low", "close", "volume")

BAR_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("open", T.DoubleType(), True),
    T.StructField("high", T.DoubleType(), True),
    T.StructField("low", T.DoubleType(), True),
    T.StructField("close", T.DoubleType(), True),
    T.StructField("volume", T.LongType(), True),
])

INTRADAY_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("open", T.DoubleType(), True),
    T.StructField("high", T.DoubleType(), True),
    T.StructField("low", T.DoubleType(), True),
    T.StructField("close", T.DoubleType(), True),
    T.StructField("volume", T.LongType(), True),
])

TICK_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("price", T.DoubleType(), True),
    T.StructField("size", T.LongType(), True),
])

RECIPE_SCHEMA = T.StructType([
    T.StructField("recipe", T.StringType(), False),
    T.StructField("min_price", T.DoubleType(), True),
    T.StructField("min_volume", T.DoubleType(), True),
    T.StructField("min_relative_volume", T.DoubleType(), True),
    T.StructField("min_adr", T.DoubleType(), True),
    T.StructField("gap_up", T.DoubleType(), True),
    T.StructField("trend_template", T.BooleanType(), True),
])
