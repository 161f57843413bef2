"""CSV records of landing files, also those that span lines, without one task per file.

The text source splits large files over many tasks and hands out lines.  A line end inside
quotes belongs to a field, so whether a line begins a record depends on the quotes of all
lines before it.  That is a prefix scan: a line maps the state before it (outside or inside
quotes) to the state behind it, and such maps compose.  A map is constant, the identity or
a swap, so the state behind a line is the last constant before it, turned over by the swaps
since.

1. Files in which no line ends inside quotes hold one record a line; theirs pass through.
2. For the others the scan runs inside each split of a file (a window over at most a split),
   and over one row a split (a small table) for the state at the splits' beginnings.
3. Lines of a record that spans lines are joined in order, also across splits.

A quoted field that is still open at the end of its file makes its record ``broken``; what
follows its first line is dropped, so that a missing quote does not make one row of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_table

#: A whole quoted field at the beginning of a field; quotes inside are doubled.
_QUOTED = r'(^|,)[ \t]*"[^"]*+(?:""[^"]*+)*+"'
_OPEN = r'(?:^|,)[ \t]*"'


def ends_inside(line: Column, inside: bool) -> Column:
    """Whether quotes are open behind ``line``, if they are open before it (``inside``) or not."""
    text = F.concat(F.lit('"'), line) if inside else line
    left = F.regexp_replace(text, _QUOTED, "$1")
    return F.when(line.contains('"'), left.rlike(_OPEN)).otherwise(F.lit(inside))


def _plain(uri: Column) -> Column:
    """A file's URI decoded and with one slash behind the scheme, as all sources here spell it."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def file_path() -> Column:
    return _plain(F.col("_metadata.file_path"))


def list_files(spark: SparkSession, path: str, glob: str, modified_after: str | None = None) -> DataFrame:
    """``_path``, ``modified`` and ``length`` of every file; contents are not read.

    Scans leave out files of 0 bytes.  Those come from the names in the file index, which
    the driver holds for any read of the folder, and have no ``modified``."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after)
    raw = reader.load(path)
    files = raw.select(file_path().alias("_path"), F.col("modificationTime").alias("modified"), "length")
    named = spark.createDataFrame([(p,) for p in raw.inputFiles()], "uri string").select(_plain(F.col("uri")).alias("_path"))
    empty = named.distinct().join(files.select("_path"), "_path", "left_anti").select(
        "_path", F.lit(None).cast("timestamp").alias("modified"), F.lit(0).cast("long").alias("length"))
    return files.unionByName(empty)


def read_lines(spark: SparkSession, path: str | list[str], glob: str, modified_after: str | None = None) -> DataFrame:
    """``_path``, ``_at`` (split and place, ascending in a file) and ``_line``."""
    reader = spark.read.format("text").option("pathGlobFilter", glob)
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after)
    at = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    return reader.load(path).select(file_path().alias("_path"), at.alias("_at"), F.col("value").alias("_line"))


def _state(constant: Column, swaps: Column, before: Column) -> Column:
    """State from the last constant (``value``, ``swaps`` counted there), else from the one ``before``."""
    turned = F.coalesce(swaps, F.lit(0)) - F.coalesce(constant["swaps"], F.lit(0))
    value = F.coalesce(constant["value"], before)
    return F.when(turned % 2 == 0, value).otherwise(~value)


def _scanned(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines with the states ``_in`` before and ``_out`` behind them, the state behind every file)."""
    split = F.col("_at.split").alias("_split")
    lines = lines.select("*", split, ends_inside(F.col("_line"), False).alias("_a"),
                         ends_inside(F.col("_line"), True).alias("_b"))
    here = Window.partitionBy("_path", "_split").orderBy("_at")
    till = here.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_swaps", F.sum((F.col("_a") & ~F.col("_b")).cast("int")).over(till))
    last = F.last(F.when(F.col("_a") == F.col("_b"), F.struct(F.col("_a").alias("value"), F.col("_swaps").alias("swaps"))),
                  ignorenulls=True)
    lines = lines.withColumn("_constant", last.over(till)).withColumns({
        "_constant_before": F.lag("_constant").over(here), "_swaps_before": F.lag("_swaps").over(here)})
    lines = scratch_table(lines, "record-lines")
    # of a split: constant or not, the value it ends with from outside, whether it swaps
    ends = lines.groupBy("_path", "_split").agg(F.max_by(F.struct("_constant", "_swaps"), "_at").alias("_e"))
    outside = F.lit(False)
    value = _state(F.col("_e._constant"), F.col("_e._swaps"), outside)
    fixed = F.col("_e._constant").isNotNull()
    splits = Window.partitionBy("_path").orderBy("_split")
    upto = splits.rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.select("_path", "_split", fixed.alias("_fixed"), value.alias("_value"))
    ends = ends.withColumn("_swaps", F.sum((~F.col("_fixed") & F.col("_value")).cast("int")).over(upto))
    ends = ends.withColumn("_constant", F.last(F.when(F.col("_fixed"), F.struct(
        F.col("_value").alias("value"), F.col("_swaps").alias("swaps"))), ignorenulls=True).over(upto))
    ends = ends.withColumn("_behind", _state(F.col("_constant"), F.col("_swaps"), outside))
    ends = scratch_table(ends.select("_path", "_split", "_behind", F.coalesce(F.lag("_behind").over(splits), outside)
                                     .alias("_before")), "record-splits")
    whole = ends.groupBy("_path").agg(F.max_by("_behind", "_split").alias("_open_end"))
    lines = lines.join(ends.select("_path", "_split", "_before"), ["_path", "_split"]).select(
        "_path", "_split", "_at", "_line",
        _state(F.col("_constant_before"), F.col("_swaps_before"), F.col("_before")).alias("_in"),
        _state(F.col("_constant"), F.col("_swaps"), F.col("_before")).alias("_out"))
    return lines, whole


def _spanning(lines: DataFrame) -> DataFrame:
    """Records of files in which some field holds a line end."""
    lines, whole = _scanned(lines)
    till = Window.partitionBy("_path", "_split").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.when(~F.col("_in"), F.col("_at"))
    lines = scratch_table(lines.withColumn("_record", F.last(begin, ignorenulls=True).over(till)), "record-begins")
    # a split's first lines may belong to a record that began in an earlier split
    last = lines.groupBy("_path", "_split").agg(F.max("_record").alias("_last"))
    before = Window.partitionBy("_path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    last = scratch_table(last.select("_path", "_split", F.max("_last").over(before).alias("_earlier"),
                                     F.max("_last").over(Window.partitionBy("_path")).alias("_final")), "record-splits")
    lines = lines.join(last, ["_path", "_split"]).join(whole, "_path").withColumn(
        "_record", F.coalesce("_record", "_earlier"))
    broken = F.col("_open_end") & (F.col("_record") == F.col("_final"))
    single = lines.where(~F.col("_in") & (~F.col("_out") | broken)).select(
        "_path", "_at", F.col("_line").alias("_text"), broken.alias("_broken"))
    many = lines.where((F.col("_in") | F.col("_out")) & ~broken).groupBy("_path", "_record").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_line"))), lambda x: x["_line"]), "\n")
        .alias("_text"))
    return single.unionByName(many.select("_path", F.col("_record").alias("_at"), "_text", F.lit(False).alias("_broken")))


def records(lines: DataFrame) -> DataFrame:
    """``_path``, ``_at`` (place of its first line), ``_text`` and ``_broken`` of every record; blank lines between
    records are none."""
    per_file = lines.groupBy("_path").agg(F.max(ends_inside(F.col("_line"), False)).alias("_spans"))
    spans = scratch_table(per_file.where("_spans").select("_path"), "record-files")
    plain = lines.select("_path", "_at", F.col("_line").alias("_text"), F.lit(False).alias("_broken"))
    if not spans.isEmpty():
        plain = plain.join(spans, "_path", "left_anti").unionByName(_spanning(lines.join(spans, "_path", "left_semi")))
    return plain.where(F.trim("_text") != "")
