"""CSV landing files -> canonical bars, universe lists, bulk sync status.

Landing layout: one CSV per symbol, ``<dir>/<SYMBOL>.csv``, whose first record is a
header with at least ``date, open, high, low, close, volume`` in any column order
(extra columns are ignored, however many; fields may be quoted, hold line ends and
doubled quotes).  Files are read line by line with the text source, which splits large
files over many tasks (no file is ever one row or one task); ``records`` joins the lines
of a record, and every record is parsed by Spark's own CSV parser (``from_csv``).  Each
file's header is joined back to its records by file, so fields are matched by name.  A
symbol with a date or number that does not parse yields no bars at all (all-or-nothing,
like a failed fetch); other symbols continue.

``sync_status`` is the per-symbol result table of a bulk sync:
(symbol, ok, message, dollar_volume) with the screener's messages.  ``sync_increment``
does the same for the files that are new or changed since its last call.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.liquidity import LOOKBACK_DAYS, VOLUME_THRESHOLD, dollar_volume
from ..session import scratch_table
from . import small_files
from .files import stem
from .records import list_files, read_lines, records
from .small_files import local_folder
from .store import _exists, canonical, save_bars

# Status messages of a sync.
MSG_OK = "Synced"
MSG_BELOW = "Synced (below threshold: ${})"
MSG_EMPTY = "Failed to fetch or empty data"

FIELDS = ("date", "open", "high", "low", "close", "volume")


def _symbol_of(path_col) -> F.Column:
    return F.upper(stem(path_col, ".csv"))


def _fields(record: F.Column, columns: int) -> F.Column:
    """A record's CSV fields as an array of ``columns`` strings (NULL behind the last)."""
    names = [f"c{i}" for i in range(columns)]
    row = F.from_csv(record, ", ".join(f"{n} string" for n in names),
                     {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "escape": '"',
                      "maxColumns": str(columns + 1)})
    return F.transform(F.array(row), lambda r: F.array(*[r[n] for n in names]))[0]


GLOB = "*.csv"
AT = "struct<split: bigint, id: bigint>"


def listing(spark: SparkSession, path: str, modified_after: str | None = None) -> DataFrame:
    """``_path``, ``modified`` and ``length`` of a landing folder's files; in a local folder the driver holds none."""
    folder = local_folder(spark, path)
    if folder is None:
        return list_files(spark, path, GLOB, modified_after)
    return small_files.list_folder(spark, folder, GLOB.removeprefix("*"), modified_after)


def read_landing(spark: SparkSession, path: str, fresh: DataFrame | None = None,
                 modified_after: str | None = None) -> DataFrame:
    """Parsed landing rows: (symbol, date, open, high, low, close, volume, bad, _empty).

    A file's first record is its header.  Headers are one row per file, written as a small table;
    the widest gives the number of columns to parse.  Tasks that read files whole are handed the
    places of a file's fields with its name; records of split files are joined to them by file
    (broadcast on the table's measured size, shuffle-joined beyond).  ``bad`` names
    the first field that does not parse (``date`` for a record whose quotes do not close).
    Files without any data record (0-byte or header-only) come back as one ``_empty`` row of
    their symbol.  ``fresh`` (``_path``) limits the work to those files, ``modified_after`` the
    listing."""
    files = fresh
    if fresh is None or "length" not in fresh.columns:
        files = listing(spark, path, modified_after)
        files = scratch_table(files if fresh is None else files.join(fresh, "_path", "left_semi"), "landing-files")
    whole, lines = None, None
    if local_folder(spark, path) is not None:
        large = [r._path for r in files.where(F.col("length") > small_files.WHOLE).select("_path").collect()]
        whole = files.where(F.col("length").between(1, small_files.WHOLE))
        tasks = small_files.tasks_of(whole)
        if large:
            lines = read_lines(spark, [re.sub(r"([\\{}\[\]*?])", r"\\\1", x) for x in large], "*")
    else:
        lines = read_lines(spark, path, GLOB, modified_after)
        if fresh is not None:
            lines = lines.join(fresh.select("_path"), "_path", "left_semi")
    heads = []
    if whole is not None:
        heads.append(small_files.read_heads(whole, tasks).withColumn("_head_at", F.lit(None).cast(AT)))
    if lines is not None:
        rows = records(lines)
        heads.append(rows.groupBy("_path").agg(F.min_by("_text", "_at").alias("_head"), (F.count("*") > 1).alias("_more"),
                                               F.min("_at").alias("_head_at")))
    headers = scratch_table(reduce(DataFrame.unionByName, heads), "landing-headers")
    # fields of the widest header, at most: commas inside its quotes count, too
    widest = headers.agg(F.max(F.size(F.split("_head", ",")))).first()[0] or 1
    named = F.transform(_fields(F.col("_head"), widest), lambda x: F.lower(x))
    headers = headers.withColumn("_hdr", named).select(
        "_path", "_head_at", "_more", _symbol_of(F.col("_path")).alias("symbol"),
        F.array(*[F.coalesce(F.array_position("_hdr", c), F.lit(0)).cast("int") for c in FIELDS]).alias("_places"))
    headers = scratch_table(headers, "landing-places")
    data = []
    if whole is not None:
        data.append(small_files.read_bodies(headers.where(F.col("_head_at").isNull() & F.col("_more")), tasks, widest))
    if lines is not None:
        data.append(rows.join(headers, "_path").where(F.col("_at") != F.col("_head_at")).select(
            "symbol", "_places", "_text", "_broken", F.lit(False).alias("_picked")))
    data = reduce(DataFrame.unionByName, data).withColumn("_f", F.when(
        F.col("_picked"), _fields(F.col("_text"), len(FIELDS))).otherwise(_fields(F.col("_text"), widest)))
    place = {c: F.get("_places", F.lit(i)) for i, c in enumerate(FIELDS)}

    def val(name):
        return F.get("_f", place[name] - 1)

    date = F.try_to_date(val("date"), "yyyy-MM-dd")
    # strict %Y-%m-%d: the text must round-trip (rejects 2026-1-5 and trailing junk)
    strict = F.coalesce(date.isNotNull() & (F.date_format(date, "yyyy-MM-dd") == val("date")), F.lit(False))
    numbers = ("open", "high", "low", "close", "volume")
    bad = F.when(~strict | F.col("_broken"), "date")
    for c in numbers:
        bad = bad.when((place[c] == 0) | (val(c).isNotNull() & val(c).try_cast("double").isNull()), c)
    rows = data.select(
        "symbol", F.when(strict, date).alias("date"),
        *[val(c).try_cast("double").alias(c) for c in numbers[:-1]],
        F.floor(val("volume").try_cast("double")).cast("bigint").alias("volume"),
        bad.alias("bad"), F.lit(False).alias("_empty"))
    listed = files.select(_symbol_of(F.col("_path")).alias("symbol")).distinct()
    present = headers.where("_more").select("symbol").distinct()
    empty = (listed.join(present, "symbol", "left_anti")
                   .select("symbol", *[F.lit(None).cast(t).alias(c) for c, t in
                                       (("date", "date"), ("open", "double"), ("high", "double"), ("low", "double"),
                                        ("close", "double"), ("volume", "bigint"), ("bad", "string"))],
                           F.lit(True).alias("_empty")))
    return rows.unionByName(empty)


def landing_bars(spark: SparkSession, path: str, fresh: DataFrame | None = None,
                 modified_after: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good bars, rejected symbols).  A symbol with any field that does not parse is rejected whole.

    The records are parsed once, into a written table that both results read; ``fresh`` and
    ``modified_after`` as in ``read_landing``."""
    parsed = scratch_table(read_landing(spark, path, fresh, modified_after), "landing-rows")
    # one row per symbol, written: the semi join below broadcasts it on its
    # measured size (shuffle join beyond) instead of shuffling every line
    per_symbol = scratch_table(parsed.groupBy("symbol").agg(
        F.min("bad").alias("_bad"), F.count(F.when(~F.col("_empty"), 1)).alias("_rows")), "landing-symbols")
    good_syms = per_symbol.where(F.col("_bad").isNull() & (F.col("_rows") > 0)).select("symbol")
    good = canonical(parsed.where(~F.col("_empty")).join(good_syms, "symbol", "left_semi"))
    rejected = per_symbol.where(F.col("_bad").isNotNull() | (F.col("_rows") == 0)).select(
        "symbol", F.when(F.col("_rows") == 0, "empty").otherwise(F.concat(F.lit("bad_"), "_bad")).alias("reason"))
    return good, rejected


def status_of(good: DataFrame, rejected: DataFrame, threshold: float = VOLUME_THRESHOLD,
              lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """R3 status rows for the symbols of a landing folder."""
    dv = dollar_volume(good, lookback_days)
    ok = dv.select(
        "symbol", F.lit(True).alias("ok"),
        F.when(F.col("dollar_volume") >= F.lit(float(threshold)), F.lit(MSG_OK))
         .otherwise(F.format_string(MSG_BELOW.replace("{}", "%s"), F.format_number("dollar_volume", 0)))
         .alias("message"),
        "dollar_volume")
    failed = rejected.select("symbol", F.lit(False).alias("ok"), F.lit(MSG_EMPTY).alias("message"),
                             F.lit(0.0).alias("dollar_volume"))
    return ok.unionByName(failed)


def sync_status(spark: SparkSession, landing: str, threshold: float = VOLUME_THRESHOLD,
                lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """R3 status rows for every symbol in the landing folder, without saving."""
    return status_of(*landing_bars(spark, landing), threshold, lookback_days)


def sync(spark: SparkSession, landing: str, store_path: str, threshold: float = VOLUME_THRESHOLD) -> DataFrame:
    """Save every good symbol (before any threshold test), return the status table of the same rows."""
    good, rejected = landing_bars(spark, landing)
    save_bars(good, store_path)
    return status_of(good, rejected, threshold)


LANDED = "_path string, modified timestamp, length long"


def sync_increment(spark: SparkSession, landing: str, store_path: str,
                   threshold: float = VOLUME_THRESHOLD) -> DataFrame:
    """R3 by increments: sync the files that are new or changed since the last call, and return their status.

    The store remembers the files it took (``_landed``: path, modification time, length).  Only
    files modified since shortly before the newest of them are listed, and of these only the
    unknown ones are read.  They are remembered after the save, so a call that dies in between
    is repeated by the next one, which replaces the same histories."""
    landed = f"{store_path.rstrip('/')}/_landed"
    known = spark.read.schema(LANDED).parquet(landed) if _exists(spark, landed) else None
    newest = known.agg(F.max("modified")).select(F.date_format(
        F.col("max(modified)") - F.expr("INTERVAL 2 SECONDS"), "yyyy-MM-dd'T'HH:mm:ss")).first()[0] if known else None
    files = listing(spark, landing, newest)
    if known is not None:
        seen = known.select(*[F.col(c).alias(f"_known_{c}") for c in known.columns])
        files = files.join(seen, (F.col("_path") == F.col("_known__path")) & (F.col("length") == F.col("_known_length"))
                           & F.col("modified").eqNullSafe(F.col("_known_modified")), "left_anti")
    files = scratch_table(files, "landing-fresh")
    good, rejected = landing_bars(spark, landing, files, newest)
    save_bars(good, store_path)
    files.write.mode("append").parquet(landed)
    return status_of(good, rejected, threshold)


def eligible_summary(status: DataFrame, threshold: float = VOLUME_THRESHOLD) -> DataFrame:
    """A3 over a status table: (n_synced, n_failed, n_eligible)."""
    return status.agg(F.count_if(F.col("ok")).alias("n_synced"),
                      F.count_if(~F.col("ok")).alias("n_failed"),
                      F.count_if(F.col("ok") & (F.col("dollar_volume") >= threshold)).alias("n_eligible"))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """One symbol per line, stripped (all whitespace) and upper-cased; blank and '#' lines dropped.

    Files are read by line and split over tasks; duplicates are kept, and ``line`` ascends
    with the place in the file (it is not dense)."""
    raw = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    white = r"[\s\x1c-\x1f\x85\p{Z}]+"  # of any script, as the list's readers strip it
    sym = F.upper(F.regexp_replace("value", f"^{white}|{white}$", ""))
    return (raw.select("line", sym.alias("symbol"))
               .where((F.col("symbol") != "") & ~F.col("symbol").startswith("#")))


__all__ = ["read_landing", "landing_bars", "status_of", "sync_status", "sync", "sync_increment", "eligible_summary", "read_universe"]
