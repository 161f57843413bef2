"""One file per value of a column, under that value's name (``<dir>/<SYMBOL>.csv``).

Spark's writers name files by task, in a folder each; a rename of every file would be one call
after the other from the driver.  In a folder that the tasks reach as a path, the tasks write the files
under their names instead, batch by batch.  Other stores take Spark's writer and the renames."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# sent along with the tasks, so that reading and saving bars asks nothing of the workers but Arrow
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What Spark calls the folder of a NULL or empty value.
UNNAMED = "__HIVE_DEFAULT_PARTITION__"


def stem(path: Column, suffix: str) -> Column:
    """The file name in ``path`` without ``suffix``; empty if it has another one.

    No pattern: one that looks for the last slash from every place costs more than the rest of a row."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.endswith(suffix), F.left(name, F.length(name) - len(suffix))).otherwise("")


def _name(value: str | None) -> str:
    """A value as Spark's writers spell it in a path."""
    return re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value or "") or UNNAMED


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The stretches of equal ``file`` in a batch, without that column."""
    at = batch.schema.get_field_index("file")
    ends = pc.run_end_encode(batch.column(at))
    rows, begin = batch.drop_columns(["file"]), 0
    for end, value in zip(ends.run_ends.to_pylist(), ends.values.to_pylist(), strict=True):
        yield _name(value), rows.slice(begin, end - begin)
        begin = end


class _Lines:
    def __init__(self, path: str, header: str | None):
        self.file = open(path, "wb")
        if header is not None:
            self.file.write(f"{header}\n".encode())

    def write_batch(self, rows: pa.RecordBatch) -> None:
        lines = pc.fill_null(rows.column(0).cast(pa.large_string()), "")
        lines = pc.binary_join_element_wise(lines, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
        if len(lines):  # their texts stand one after the other in one buffer
            at = np.frombuffer(lines.buffers()[1], np.int64)
            self.file.write(lines.buffers()[2][int(at[lines.offset]):int(at[lines.offset + len(lines)])])

    def close(self) -> None:
        self.file.close()


def _writer(folder: str, suffix: str, header: str | None = None):
    new = (lambda path, _: _Lines(path, header)) if suffix == ".csv" else pq.ParquetWriter

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        os.makedirs(folder, exist_ok=True)
        # a hidden name until the file is whole; of its own in every attempt
        draft = f"{folder}/_draft-{TaskContext.get().taskAttemptId()}"
        open_name, out, n = None, None, 0
        for batch in batches:
            for name, rows in _runs(batch) if batch.num_rows else ():
                if name != open_name:
                    if out is not None:
                        out.close()
                        os.replace(draft, f"{folder}/{open_name}{suffix}")
                    open_name, out, n = name, new(draft, rows.schema), n + 1
                out.write_batch(rows)
        if out is not None:
            out.close()
            os.replace(draft, f"{folder}/{open_name}{suffix}")
        yield pa.record_batch({"n": pa.array([n], pa.int64())})
    return written


def write_files(df: DataFrame, path: str, suffix: str, header: str | None = None) -> None:
    """Write the rows of every ``file`` as ``<file><suffix>`` (``.csv``: lines of text, ``.parquet``).

    The rows of a ``file`` stand one after the other in one partition; ``header`` is the first line of
    every ``.csv``."""
    uri = urlparse(path)
    if uri.scheme in ("", "file"):
        df.mapInArrow(_writer(unquote(uri.path), suffix, header), "n long").agg(F.sum("n")).collect()
        return
    if header is not None:
        heads = df.select("file").distinct().select("file", F.lit(header).alias("value"), F.lit(0).alias("_at"))
        df = df.select("file", "value", F.lit(1).alias("_at")).unionByName(heads).repartition("file")
        df = df.sortWithinPartitions("file", "_at").drop("_at")
    writer = df.write.mode("append").partitionBy("file")
    writer.text(path) if suffix == ".csv" else writer.parquet(path)
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    for folder in fs.listStatus(root):
        name = folder.getPath().getName()
        if name.startswith("file="):
            part = fs.listStatus(folder.getPath())[0].getPath()
            fs.rename(part, jvm.org.apache.hadoop.fs.Path(root, name.removeprefix("file=") + suffix))
            fs.delete(folder.getPath(), True)
