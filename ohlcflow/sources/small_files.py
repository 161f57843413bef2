"""Landing files listed and read by the tasks, many of them each.

Spark's file sources hold an entry of every file in the driver for each read of a folder, and
give a task but a few small files.  In a folder that the tasks reach as a path, one task lists
it into a table, and files up to ``WHOLE`` bytes are read whole by tasks of about ``TASK`` bytes:
line after line, with the same rules for records as ``records``.  Larger files and other stores
are left to Spark's sources, which split a file."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# sent along with the tasks, as ``files``
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes up to which a file is read whole, and that the files of a task have together, about.
WHOLE = 16 << 20
TASK = 32 << 20
#: What opening a file counts as, in bytes.
OPEN = 64 << 10
#: Bytes and records of a batch, about.
BATCH = 4 << 20
ROWS = 10_000

def local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder's path on the machines of the tasks, or None: another store, a pattern or no folder."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(jpath).toUri()
    found = uri.getScheme() == "file" and not set(path) & set("*?[]{}\\") and os.path.isdir(uri.getPath())
    return uri.getPath() if found else None


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _lister(folder: str, suffix: str) -> Callable:
    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folders, rows = [folder] * batch.num_rows, []
            while folders:
                with os.scandir(folders.pop()) as entries:
                    for x in entries:
                        if _hidden(x.name):
                            continue
                        if x.is_dir():
                            if "=" in x.name:  # a partition's folder
                                folders.append(x.path)
                        elif x.name.endswith(suffix):
                            s = x.stat()
                            rows.append((f"file:{x.path}", s.st_mtime_ns // 1_000_000, s.st_size))
                        if len(rows) == ROWS:
                            yield pa.record_batch([*map(pa.array, zip(*rows, strict=True))], ["_path", "ms", "length"])
                            rows = []
            if rows:
                yield pa.record_batch([*map(pa.array, zip(*rows, strict=True))], ["_path", "ms", "length"])
    return listed


def list_folder(spark: SparkSession, folder: str, suffix: str, modified_after: str | None = None) -> DataFrame:
    """``_path``, ``modified`` (NULL for files of 0 bytes, as ``list_files``) and ``length`` of every file."""
    rows = spark.range(0, 1, numPartitions=1).mapInArrow(_lister(folder, suffix), "_path string, ms long, length long")
    files = rows.select("_path", F.timestamp_millis("ms").alias("modified"), "length")
    if modified_after is not None:
        files = files.where(F.col("modified") > F.lit(modified_after).cast("timestamp"))
    return files.withColumn("modified", F.when(F.col("length") > 0, F.col("modified")))


def _lines(data: bytes) -> list[bytes]:
    """Lines as Spark's text source cuts them."""
    return data.removeprefix(b"\xef\xbb\xbf").splitlines()


def inside_behind(line: bytes, inside: bool) -> bool:
    """``records.ends_inside`` without patterns, by the pieces between quotes."""
    pieces = line.split(b'"')
    last, k, closed = len(pieces) - 1, 0, False
    if last == 0:
        return inside
    if inside:
        pieces.insert(0, b"")
        last += 1
    while k < last:  # a quote follows piece k
        before = pieces[k].rstrip(b" \t")
        if closed and not before:
            return True  # only blanks between a closed field and a quote
        if not (before.endswith(b",") or (k == 0 and not before)):
            k, closed = k + 1, False
            continue
        k += 1
        while k + 1 < last and not pieces[k + 1]:  # doubled quotes
            k += 2
        if k == last:
            return True
        k, closed = k + 1, True
    return False


def pick(record: bytes, places: list[int], columns: int) -> bytes | None:
    """The fields at ``places`` (0: none) as a record of their own; None where the field ends are the parser's to find.

    That is a quote that does not begin or end a field, or more than ``columns`` fields."""
    if b'"' not in record:
        fields = record.split(b",")
    else:
        pieces = record.split(b'"')
        last, k, fields = len(pieces) - 1, 0, []
        while k < last:
            between = pieces[k]
            if k:
                if between[:1] != b",":
                    return None
                between = between[1:] if len(between) > 1 else None
            if between:
                if between[-1:] != b",":
                    return None
                fields += between[:-1].split(b",")
            begin = k = k + 1
            while k + 1 < last and not pieces[k + 1]:
                k += 2
            if k >= last:
                return None
            fields.append(b'"%b"' % b'"'.join(pieces[begin:k + 1]))
            k += 1
        if pieces[last]:
            if pieces[last][:1] != b",":
                return None
            fields += pieces[last][1:].split(b",")
    n = len(fields)
    return b",".join([fields[p - 1] if 0 < p <= n else b"" for p in places]) if n <= columns else None


def cut(lines: Iterable[bytes]) -> Iterator[tuple[bytes, bool]]:
    """The records of a file and whether they are broken; blank lines between records are none."""
    held: list[bytes] = []
    for line in lines:
        if not held:
            if b'"' not in line:
                if line.strip(b" "):
                    yield line, False
            elif inside_behind(line, False):
                held = [line]
            else:
                yield line, False
        else:
            held.append(line)
            if b'"' in line and not inside_behind(line, True):
                yield b"\n".join(held), False
                held = []
    if held:
        yield held[0], True


def _first_two(path: str, length: int, some: int = 1 << 16) -> list[tuple[bytes, bool]]:
    """The first two records of a file, read no further than they need."""
    with open(path, "rb") as f:
        data = f.read(some)
        if length > len(data):
            records = cut(_lines(data)[:-1])  # the last line may go on
            found = [x for x, _ in zip(records, range(2), strict=False)]
            if len(found) == 2 and not any(broken for _, broken in found):
                return found
            data += f.read()
    return [x for x, _ in zip(cut(_lines(data)), range(2), strict=False)]


def _plain(path: str) -> str:
    return path.removeprefix("file:")


def _heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, heads, more = [], [], []
        for path, length in zip(batch.column("_path").to_pylist(), batch.column("length").to_pylist(), strict=True):
            if two := _first_two(_plain(path), length):
                paths.append(path)
                heads.append(two[0][0])
                more.append(len(two) > 1)
        yield pa.record_batch([pa.array(paths, pa.string()), pa.array(heads, pa.binary()), pa.array(more, pa.bool_())], ["_path", "_head", "_more"])


def _reader(columns: int) -> Callable:
    def bodies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = zip(*[batch.column(c).to_pylist() for c in ("_path", "symbol", "_places")], strict=True)
            for path, symbol, places in files:
                with open(_plain(path), "rb") as f:
                    records = cut(_lines(f.read()))
                next(records, None)
                picked, whole, held = [], [], 0
                at = [i * (p > 0) for i, p in enumerate(places, 1)]

                def made(rows: list, places: list[int], symbol: str = symbol) -> pa.RecordBatch:
                    n = len(rows)
                    return pa.record_batch({
                        "symbol": pa.repeat(pa.scalar(symbol, pa.string()), n),
                        "_places": pa.repeat(pa.scalar(places, pa.list_(pa.int32())), n),
                        "_text": pa.array([x for x, _ in rows], pa.binary()), "_broken": pa.array([x for _, x in rows], pa.bool_()),
                        "_picked": pa.repeat(pa.scalar(rows is picked), n)})

                for text, broken in records:
                    short = None if broken else pick(text, places, columns)
                    (whole if short is None else picked).append((text if short is None else short, broken))
                    held += len(text)
                    if held >= BATCH or len(picked) + len(whole) >= ROWS:
                        yield from [made(x, y) for x, y in ((picked, at), (whole, places)) if x]
                        picked, whole, held = [], [], 0
                yield from [made(x, y) for x, y in ((picked, at), (whole, places)) if x]
    return bodies


def _dealt(files: DataFrame, tasks: int) -> DataFrame:
    task = F.pmod(F.xxhash64("_path"), F.lit(tasks)).cast("int")
    return files.withColumn("_task", task).repartitionById(tasks, "_task").drop("_task")


def tasks_of(files: DataFrame) -> int:
    """How many tasks read the files: by their bytes, and no fewer than the cores can share."""
    n, total = files.agg(F.count("*"), F.sum(F.col("length") + OPEN)).first()
    return min(max(n, 1), max(-(-(total or 0) // TASK), 3 * files.sparkSession.sparkContext.defaultParallelism))


def read_heads(files: DataFrame, tasks: int) -> DataFrame:
    """``_path``, ``_head`` (first record) and ``_more`` (there are others) of the files (``_path``, ``length``)."""
    rows = _dealt(files.select("_path", "length"), tasks).mapInArrow(_heads, "_path string, _head binary, _more boolean")
    return rows.withColumn("_head", F.col("_head").cast("string"))


def read_bodies(files: DataFrame, tasks: int, columns: int) -> DataFrame:
    """Every record behind a file's first: ``_text`` and ``_broken``, with the file's ``symbol`` and ``_places``.

    ``_picked`` tells whether ``_text`` is only the fields at the file's places, in their order;
    ``_places`` are then those in it.  A record of more than ``columns`` fields stays whole."""
    rows = _dealt(files.select("_path", "symbol", "_places"), tasks).mapInArrow(
        _reader(columns), "symbol string, _places array<int>, _text binary, _broken boolean, _picked boolean")
    return rows.withColumn("_text", F.col("_text").cast("string"))
