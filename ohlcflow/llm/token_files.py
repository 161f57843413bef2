"""Token-id files: flat unsigned integers with 64-bit document offsets, read by memory map.

Documents are range-partitioned and sorted by id; every partition encodes its texts with
the ``tokenizers`` library and writes one shard of three flat little-endian files:

* ``.bin``: token ids, unsigned 16 bits if the vocabulary fits, else 32 bits;
* ``.off``: int64 offsets into the shard's ids, one per document and one at the end;
* ``.doc``: int64 document ids (the smallest int64 stands for null).

A shard's files carry an attempt's unique name and count only if the finished task
reports them, so retried or lost tasks leave at most unread files.  The report of each
shard (name, documents, tokens) is a row of the manifest; its prefix sums give every
shard's global token and document base, so shards are written independently and one
reader can address the corpus as one array.

Order: ascending doc_id, null first, then by text hash; repeated rows follow one another.
Null or empty text has only the end id.  An empty table gives an empty manifest.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohlcflow.llm.common import RecentWords, file_system, id_and_text, pieces_of, small_batches
from ohlcflow.session import scratch_folder

#: Pieces of one of two generations that a worker remembers (about 200 bytes each).
RECENT = 600_000
NULL_ID = np.iinfo(np.int64).min

MANIFEST = "shard int, name string, dtype string, n_docs long, n_tokens long"


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.lru_cache(maxsize=2)
def piece_ids(path: str, dtype: str) -> RecentWords:
    """Ids (as bytes of ``dtype``) that the library gives to recent pieces between white space.

    A letter and a stop behind it never share a pre-token, and case is folded, so pieces
    that differ in an ASCII word's case or in stops at the end share the word's encoding.
    A word of letters is one pre-token, so many words are encoded as one text, whose ids
    are parted behind the tokens that end a word."""
    t = encoder(path)
    ends = np.zeros(t.get_vocab_size(with_added_tokens=True), dtype=bool)
    ends[[i for token, i in t.get_vocab(with_added_tokens=True).items() if token.endswith("</w>")]] = True
    size = np.dtype(dtype).itemsize

    def encode(words: list[str]) -> list[bytes]:
        known: dict[str, bytes] = {}
        plain = [w for w in words if w.isalpha() and "\u0130" not in w]
        for i in range(0, len(plain), 256):
            part = plain[i:i + 256]
            ids = np.array(t.encode(" ".join(part), add_special_tokens=False).ids, dtype=dtype)
            cuts = (np.flatnonzero(ends[ids]) + 1) * size
            if len(cuts) == len(part):  # else they are encoded one by one
                raw, cuts = ids.tobytes(), cuts.tolist()
                known.update(zip(part, [raw[a:z] for a, z in zip([0, *cuts], cuts, strict=False)], strict=True))
        rest = [w for w in words if w not in known]
        known.update(zip(rest, [np.array(e.ids, dtype=dtype).tobytes() for e in t.encode_batch_fast(
            rest, add_special_tokens=False)], strict=True))
        return [known[w] for w in words]

    recent = RecentWords(encode, limit=RECENT)

    def compute(pieces: list[str]) -> list[bytes]:
        words, stops = [], []
        for p in pieces:
            word = p.rstrip(".,;:!?")
            stop = p[len(word):]
            if not word or not word[-1].isalpha():
                word, stop = p, ""
            words.append(word.lower() if word.isascii() and "<|" not in word else word)
            stops.append(stop)
        return [w + s for w, s in zip(*recent.of([words, stops]), strict=True)]

    return RecentWords(compute, limit=RECENT)


def encode_texts(texts: list[str], path: str, dtype: str, by_piece: bool) -> list[bytes]:
    if not by_piece:
        return [np.array(e.ids, dtype=dtype).tobytes()
                for e in encoder(path).encode_batch_fast(texts, add_special_tokens=False)]
    known = piece_ids(path, dtype)
    cut = [pieces_of(t) for t in texts]
    return [b"".join(ids) for ids in known.of(cut)]


def encodes_by_piece(tokenizer: str) -> bool:
    """Whether the vocabulary encodes pieces between white space by themselves and drops the white space."""
    probes = ["a", "The", "don't", "x1,y2.", "ÉTÉ", "日本", "<|endoftext|>", "word", "''", "\U0001F600z"]
    ids = lambda t: encoder(tokenizer).encode(t, add_special_tokens=False).ids
    apart = [i for p in probes for i in ids(p)]
    return all(ids(edge + gap.join(probes) + edge) == apart for gap in (" ", "\n", " \t\r\n ") for edge in ("", " "))


def write(docs: DataFrame, tokenizer: str, out: str | None = None, end_id: int = 1, by_piece: bool = False,
          shards: int | None = None) -> tuple[str, DataFrame]:
    """Write ``docs`` (``doc_id``, ``text``) as token files; (folder, manifest with bases).

    ``tokenizer`` is the path of a vocabulary file that every executor can read.
    ``by_piece`` is for vocabularies that drop white space and fold case: pieces between
    white space are then encoded by themselves, and recent ones remembered; another one is
    refused.  ``out`` is a shared folder
    (default: one beside the session's scratch tables)."""
    spark = docs.sparkSession
    small_batches(spark)
    out = out or scratch_folder(spark, "token-files")
    if by_piece and not encodes_by_piece(tokenizer):
        raise ValueError(f"{tokenizer} does not encode pieces between white space by themselves")
    dtype = "<u2" if max(encoder(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else "<u4"
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fs, folder = file_system(out)
    fs.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(out)
        end = np.array([end_id], dtype=dtype).tobytes()
        size = np.dtype(dtype).itemsize
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        streams, n_docs, at = None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            if streams is None:
                streams = [fs.open_output_stream(f"{folder}/{name}.{x}") for x in ("bin", "off", "doc")]
                streams[1].write(np.zeros(1, dtype="<i8").tobytes())
            ids = encode_texts(b.column("text").to_pylist(), tokenizer, dtype, by_piece)
            ends = at + np.cumsum([len(x) // size + 1 for x in ids])
            streams[0].write(end.join(ids) + end)
            streams[1].write(ends.astype("<i8").tobytes())
            streams[2].write(b.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(
                "<i8").tobytes())
            n_docs, at = n_docs + b.num_rows, int(ends[-1])
        if streams:
            for s in streams:
                s.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([name]), pa.array([dtype]), pa.array([n_docs], pa.int64()),
                 pa.array([at], pa.int64())], names=["shard", "name", "dtype", "n_docs", "n_tokens"])

    d = id_and_text(docs).withColumn("_order", F.xxhash64("text"))
    d = d.repartitionByRange(shards, "doc_id", "_order").sortWithinPartitions("doc_id", "_order")
    reports = sorted(d.select("doc_id", "text").mapInArrow(run, MANIFEST).collect())  # one row per shard
    docs_before = np.concatenate([[0], np.cumsum([r.n_docs for r in reports], dtype=np.int64)])
    before = np.concatenate([[0], np.cumsum([r.n_tokens for r in reports], dtype=np.int64)])
    manifest = spark.createDataFrame(
        [(*r, int(docs_before[i]), int(before[i])) for i, r in enumerate(reports)],
        MANIFEST + ", doc_base long, token_base long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest")
    return out, manifest_of(spark, out)


def manifest_of(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/manifest")


class FlatFile:
    """A flat file that slices like an array: memory-mapped where the folder is mounted, else read by ranges."""

    def __init__(self, folder: str, name: str, dtype: str):
        fs, path = file_system(f"{folder}/{name}")
        self.dtype = np.dtype(dtype)
        local = isinstance(fs, pafs.LocalFileSystem)
        # a plain view: slices of a memmap object cost several times as much
        self.mapped = np.memmap(path, dtype=dtype, mode="r").view(np.ndarray) if local else None
        self.file = None if self.mapped is not None else fs.open_input_file(path)

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[part]
        size = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((part.stop - part.start) * size, part.start * size), dtype=self.dtype)


def documents(spark: SparkSession, out: str, rows: int = 256) -> DataFrame:
    """Every document read back from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    manifest = manifest_of(spark, out)
    shards = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.to_pylist():
                off = FlatFile(out, f"{m['name']}.off", "<i8")
                doc = FlatFile(out, f"{m['name']}.doc", "<i8")
                ids = FlatFile(out, f"{m['name']}.bin", m["dtype"])
                for i in range(0, m["n_docs"], rows):
                    z = min(i + rows, m["n_docs"])
                    o, d = off[i:z + 1], doc[i:z]
                    crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(o, o[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d, pa.int64(), mask=d == NULL_ID), pa.array(m["token_base"] + o[:-1], pa.int64()),
                         pa.array(np.diff(o), pa.int64()), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.repartitionByRange(shards, "shard").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
