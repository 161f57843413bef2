"""Benchmark decontamination by spaced-seed hashing.

A document is contaminated by a benchmark item if ``window`` consecutive words of it
agree with ``window`` consecutive words of the item in all but at most
``substitutions`` places.  The window is cut into ``substitutions + 2`` blocks; each
fixed mask ignores all blocks but two, and whatever the substitutions hit, two blocks
stay untouched, so one mask at least sees equal words in both texts: no overlap is lost.

Seeds (hashes of the words under a mask) of benchmark and documents are joined, and the
windows around every joined hit are compared word by word.  Before the join a Bloom
filter of the benchmark's seeds, of bounded size, is broadcast, and document seeds that
it refutes are not emitted; what it lets through by chance fails the comparison.

An item with fewer words than a window is a window of its own length, with substitutions
in proportion (of 12 words 2, so of 6 to 11 one, of fewer none).  One of fewer than
``least_words`` words, which any text may hold by chance, overlaps only with a document that
has the same words and no others.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z
lower-cased.  Result: one row per document and item that overlap.  Defined results:
null and empty texts overlap with nothing; items with equal texts each get their rows;
rows of documents with one id count as one document; a null id is an id like any other.
``clean`` judges every row by its own text, also where rows share an id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohlcflow.llm import bloom
from ohlcflow.llm.common import id_and_text, small_batches
from ohlcflow.llm.words import ALNUM, Words, find_words, mix, text_runs
from ohlcflow.session import scratch_table

WINDOW = 12
SUBSTITUTIONS = 2
LEAST_WORDS = 5

#: Bits per seed of the Bloom filter, up to its largest size.
FILTER_BITS_PER_SEED = 256
#: Seed rows and bytes of their words up to which the benchmark side of the join is broadcast;
#: above, both sides are shuffled.
BROADCAST_SEEDS = (200_000, 64 << 20)

_ODD = mix(np.arange(1, 1025, dtype=np.uint64)) | np.uint64(1)  # a multiplier per window place


def blocks(window: int, substitutions: int) -> list[range]:
    n = substitutions + 2
    cuts = [window * i // n for i in range(n + 1)]  # of a single word one block is empty
    return [range(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def seeds(w: Words, window: int, substitutions: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the window's first word, seed) under every mask, for windows inside one text.

    Windows of other lengths have other seeds."""
    n = len(w.hash) - window + 1
    if n <= 0:
        return
    at = np.flatnonzero(w.doc[:n] == w.doc[window - 1:])
    parts = [sum(w.hash[j:j + n] * _ODD[j] for j in block) for block in blocks(window, substitutions)]
    for k, (a, b) in enumerate(itertools.combinations(range(len(parts)), 2)):
        yield at, mix((parts[a] + parts[b])[at] + np.uint64(window << 16 | k + 1))


def allowed(n_words: int, window: int, substitutions: int, least_words: int) -> int:
    """Substitutions that a window of ``n_words`` tolerates."""
    return 0 if n_words < least_words else min(substitutions * n_words // window, max(n_words - 2, 0))


def short_seeds(w: Words, n: int, window: int, substitutions: int, least_words: int,
                items: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``seeds`` of the windows of ``n`` words that short items are looked up by: of items those that are
    whole texts, of documents all, but below ``least_words`` whole texts, too."""
    first = w.first
    size = np.diff(first)[w.doc] if len(w.doc) else w.doc
    for at, seed in seeds(w, n, allowed(n, window, substitutions, least_words)):
        if items or n < least_words:
            whole = (size[at] == n) & (at == first[w.doc[at]])
            at, seed = at[whole], seed[whole]
        yield at, seed


def _word_texts(w: Words, first: int, last: int) -> list[str]:
    return [w.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(w.start[first:last], w.end[first:last],
                                                                              strict=True)]


SEED_ROWS = "item_id long, item_at int, n_words int, seed long, item_words array<string>"


def benchmark_seeds(items: DataFrame, window: int, substitutions: int, least_words: int) -> DataFrame:
    """Every seed of the benchmark with the words of its window (of the whole item if it is short)."""

    def rows_of(b: pa.RecordBatch) -> Iterator[tuple]:
        ids = b.column("item_id").to_pylist()
        for at, data, offsets in text_runs(b.column("text")):
            w = find_words(data, offsets, ALNUM)
            first = w.first
            size = np.diff(first)
            for place, seed in seeds(w, window, substitutions):
                for p, s in zip(place.tolist(), seed.view(np.int64).tolist(), strict=True):
                    d = int(w.doc[p])
                    yield ids[at + d], p - int(first[d]), window, s, _word_texts(w, p, p + window)
            for n in np.unique(size[(size > 0) & (size < window)]).tolist():
                for place, seed in short_seeds(w, n, window, substitutions, least_words, True):
                    for p, s in zip(place.tolist(), seed.view(np.int64).tolist(), strict=True):
                        yield ids[at + int(w.doc[p])], 0, n, s, _word_texts(w, p, p + n)

    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = rows_of(b)
            while some := list(itertools.islice(rows, 4096)):
                cols = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                                 names=["item_id", "item_at", "n_words", "seed", "item_words"])

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, SEED_ROWS)


def document_seeds(docs: DataFrame, table: np.ndarray, window: int, substitutions: int, least_words: int,
                   short: list[int]) -> DataFrame:
    """Seeds of the documents that the filter lets through, with the words of their window; ``short``
    lists the lengths of short items."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts_hash = b.column("doc_id"), b.column("text_hash")
            for at, data, offsets in text_runs(b.column("text")):
                w = find_words(data, offsets, ALNUM)
                first = w.first
                kinds = [(window, *x) for x in seeds(w, window, substitutions)]
                for n in short:
                    kinds += [(n, *x) for x in short_seeds(w, n, window, substitutions, least_words, False)]
                for length, place, seed in kinds:
                    hit = bloom.might_hold(shared.value, seed)
                    if not len(hit):
                        continue
                    place, seed = place[hit], seed[hit]
                    d = w.doc[place]
                    texts = [_word_texts(w, p, min(p + length, int(first[k + 1])))
                             for p, k in zip(place.tolist(), d.tolist(), strict=True)]
                    row = pa.array(at + d)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(row), texts_hash.take(row), pa.array((place - first[d]).astype(np.int32), pa.int32()),
                         pa.array(seed.view(np.int64), pa.int64()), pa.array(texts, pa.list_(pa.string()))],
                        names=["doc_id", "text_hash", "doc_at", "seed", "doc_words"])

    texts = id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    return texts.mapInArrow(run, "doc_id long, text_hash long, doc_at int, seed long, doc_words array<string>")


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, substitutions: int = SUBSTITUTIONS,
            least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id``, ``text_hash``, ``item_id``, ``doc_at`` and ``equal`` (words that agree) of every
    window of a document that overlaps with one of an item, once for each mask that sees it."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    if not 0 <= substitutions < window - 1 or window // (substitutions + 2) < 1:
        raise ValueError("a window needs a word for each block")
    bench = scratch_table(benchmark_seeds(items, window, substitutions, least_words), "benchmark-seeds")
    size = bench.agg(F.count("*").alias("n"), F.collect_set(F.when(F.col("n_words") < window, F.col("n_words"))).alias("short"),
                     F.sum(F.octet_length(F.array_join("item_words", " "))).alias("bytes")).first()
    table = bloom.build(bench, "seed", size.n, FILTER_BITS_PER_SEED)
    found = document_seeds(docs, table, window, substitutions, least_words, sorted(size.short))
    small = size.n <= BROADCAST_SEEDS[0] and (size.bytes or 0) <= BROADCAST_SEEDS[1]
    side = F.broadcast(bench) if small else bench
    both = found.join(side, "seed").filter(F.size("doc_words") == F.col("n_words"))
    equal = F.size(F.filter(F.zip_with("item_words", "doc_words", lambda a, b: a == b), lambda x: x))
    most = F.element_at(F.array(*[F.lit(allowed(n, window, substitutions, least_words)) for n in range(1, window + 1)]),
                        F.col("n_words"))
    both = both.withColumn("equal", equal).filter(F.col("n_words") - F.col("equal") <= most)
    return both.select("doc_id", "text_hash", "item_id", "doc_at", "equal")


def overlaps(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_windows`` (starts of overlapping windows in the document),
    ``first_word``, ``last_word`` (smallest and largest start) and ``most_equal`` (words that
    agree in the best window), one row per document and item that overlap; options as in ``matches``."""
    return matches(docs, items, **options).groupBy("doc_id", "item_id").agg(
        F.count_distinct("doc_at").alias("n_windows"), F.min("doc_at").cast("long").alias("first_word"),
        F.max("doc_at").cast("long").alias("last_word"), F.max("equal").cast("long").alias("most_equal"))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose text overlaps with no item, all columns kept; rows are told
    apart by id and text."""
    leaked = matches(docs, items, **options).select(
        F.col("doc_id").alias("_leaked"), F.col("text_hash").alias("_leaked_text")).distinct()
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("_leaked"))
    text = F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_leaked_text")
    return docs.join(leaked, own & text, "left_anti")
