"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohlcflow.session import scratch_folder

#: Arrow batches handed to Python hold at most this many rows and about this many bytes,
#: so a task's memory follows the batch, not the partition.
ARROW_ROWS = 256
ARROW_BYTES = 8 << 20

#: White space as the word contracts give it: U+0020 and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python stages in rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, null text as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """Remainder that assigns a document to a fold: crc32 of the id written in decimal."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or local path."""
    if ":" not in uri.split("/", 1)[0]:
        return pafs.LocalFileSystem(), uri
    if re.match(r"file:/(?!//)", uri):
        return pafs.LocalFileSystem(), re.sub("^file:/+", "/", uri)
    return pafs.FileSystem.from_uri(uri)


class RecentWords(dict):
    """What is known of recent words: at most two generations of ``limit`` entries.

    ``of`` looks up the words of a batch of texts and asks ``compute`` for the unknown
    ones; the older generation goes when the younger is full.  Memory is bounded whatever
    the number of distinct words; only speed depends on what is kept."""

    def __init__(self, compute, limit: int = 150_000):
        super().__init__()
        self.compute, self.limit, self.older, self.unknown = compute, limit, {}, []

    def __missing__(self, word: str):
        if (known := self.older.get(word)) is not None:
            self[word] = known
        else:
            self.unknown.append(word)
        return known

    def of(self, texts: list[list[str]]) -> list[list]:
        """What is known of every word, in the order of the texts' words."""
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()
        find = self.__getitem__
        found = [list(map(find, words)) for words in texts]
        if self.unknown:
            todo, self.unknown = list(dict.fromkeys(self.unknown)), []
            self.update(zip(todo, self.compute(todo), strict=True))
            for words, f in zip(texts, found, strict=True):
                for i in [i for i, x in enumerate(f) if x is None] if None in f else ():
                    f[i] = find(words[i])
        return found


_NOT_WHITE = ("\x1c", "\x1d", "\x1e", "\x1f")
_PIECE = re.compile(r"[^ \t\n\r]+")


def pieces_of(text: str) -> list[str]:
    """The text cut at white space: all of it, except that U+001C to U+001F, which Python
    alone takes for white space, stay inside pieces (then only at blanks and line ends)."""
    return _PIECE.findall(text) if any(c in text for c in _NOT_WHITE) else text.split()


def give_back_memory() -> None:
    """Hand a Python worker's freed memory to the system: workers live on for the next step."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library, which has no such call
        pass


class Workspace:
    """A folder of one job's tables and files, below the session's scratch tables (``drop_scratch_tables``
    deletes it with them)."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = scratch_folder(spark, name)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back: cuts the lineage, survives lost executors."""
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let Spark's context cleaner drop the shuffle files of steps that are over and written."""
        gc.collect()
        self.spark._jvm.System.gc()
