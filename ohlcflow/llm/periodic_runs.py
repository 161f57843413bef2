"""Periodic runs of words, by the branching-tandem test on an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q (words q apart are equal)
and at least ``max(least, 2 * q)`` words, which no neighbouring word extends.

1. Suffix array.  The words of the documents of a batch become numbers (equal only inside
   one document); suffixes are ordered by prefix doubling, and only those that share their
   prefix with another go on to the next length.  The names of every length are kept: they
   answer how many words two places have in common, forwards or backwards.
2. LCP intervals.  For every place of the LCP array the nearest smaller values on both
   sides bound the interval of its depth and part it into two sides; no tree is built.
3. Branching tandem test.  For every suffix i of the smaller side, a place ``i + depth`` or
   ``i - depth`` whose inverse suffix array entry lies in the other side makes two equal
   neighbouring factors of ``depth`` words that the next word does not continue.  Each
   suffix is on the smaller side at most log n times.
4. Runs.  The square is rotated to the left as far as the words before it agree; the
   stretch that its rotations cover is a run.  A multiple of a run's period gives the same
   stretch, and the smallest period stays.

Words are ``[^\\x20\\x09-\\x0D]+``.  Defined results: null and empty texts have no words and no
runs; every row is judged by itself, also rows with equal or null ids; extra columns are
ignored.  A text is held whole by one task, with some 150 bytes a word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohlcflow.llm.common import small_batches

LEAST = 12

#: Documents of a batch are taken together up to about this many words (a longer one alone).
CHUNK_WORDS = 1 << 16
#: Smaller-side suffixes are tested in portions of about this many.
PORTION = 1 << 20

RUN_ROWS = ("doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, "
            "collapsed string")


class SuffixArray:
    """Order of the suffixes of ``symbols`` (non-negative, below ``size``), the names of all
    prefixes of 1, 2, 4, ... symbols, and the common prefixes of neighbours.

    Equal names of a length are equal prefixes of that many symbols; a prefix that the end of
    the array cuts off has a name of its own."""

    def __init__(self, symbols: np.ndarray, size: int):
        n = len(symbols)
        last = np.full(1, -1)
        self.names = [(1, np.concatenate([symbols, last]))]
        after = np.concatenate([symbols[1:], last]) + 1
        rank = np.empty(n + 1, dtype=np.int64)
        rank[n] = -1
        todo = self._refine(rank, np.arange(n), symbols * (size + 1) + after, np.zeros(n, dtype=np.int64))
        length = 2
        while True:
            self.names.append((length, rank.copy()))
            if not len(todo):
                break
            key = rank[todo] * (n + 1) + rank[np.minimum(todo + length, n)] + 1
            todo = self._refine(rank, todo, key, rank[todo])
            length *= 2
        self.rank = rank[:n]
        self.order = np.empty(n, dtype=np.int64)
        self.order[self.rank] = np.arange(n)

    @staticmethod
    def _refine(rank: np.ndarray, todo: np.ndarray, key: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Rank the suffixes ``todo`` by ``key``, which orders by ``group`` first; return those
        that share their key.  A rank is the number of suffixes before the group."""
        by = np.argsort(key)
        key, group, todo = key[by], group[by], todo[by]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        outer = np.concatenate([[True], group[1:] != group[:-1]])
        at = np.arange(len(key))
        within = np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(outer, at, 0))
        rank[todo] = group + within
        alone = fresh & np.concatenate([fresh[1:], [True]])
        return todo[~alone]

    def common(self, a: np.ndarray, b: np.ndarray, step: int = 1) -> np.ndarray:
        """Number of equal symbols from the places ``a`` and ``b`` on (step 1) or before them (step -1)."""
        a, b, found = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
        for length, names in reversed(self.names):
            if step > 0:
                equal = names[a] == names[b]
            else:
                x, y = a - length, b - length
                equal = (x >= 0) & (y >= 0) & (names[np.maximum(x, 0)] == names[np.maximum(y, 0)])
            move = np.where(equal, length, 0)
            found += move
            a += step * move
            b += step * move
        return found

    def lcp(self) -> np.ndarray:
        """Common prefix of the suffixes at k - 1 and k of the order; -1 at both ends."""
        n = len(self.order)
        found = np.zeros(n + 1, dtype=np.int64)
        first = self.names[0][1][self.order]
        k = np.flatnonzero(first[1:] == first[:-1]) + 1
        found[k] = self.common(self.order[k - 1], self.order[k])
        found[[0, n]] = -1
        return found


def sides(lcp: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every place ``k`` of the LCP array the nearest place before it with no larger value
    and the nearest after it with a smaller one: suffixes ``[before, k)`` and ``[k, after)``
    have exactly ``lcp[k]`` symbols in common, one from each side."""
    before, after = np.arange(len(lcp)) - 1, np.arange(len(lcp)) + 1
    for near, worse in ((before, np.greater), (after, np.greater_equal)):
        open_ = k
        while len(open_):
            open_ = open_[worse(lcp[near[open_]], lcp[open_])]
            near[open_] = near[near[open_]]
    return before[k], after[k]


def branching_squares(array: SuffixArray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, period) of every square that the next symbol does not continue; ``longest``
    gives for every place the symbols of its document, half of which bound a period."""
    lcp, order, rank = array.lcp(), array.order, array.rank
    n = len(order)
    k = np.flatnonzero(lcp > 0)
    if not len(k):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = sides(lcp, k)
    some = 2 * lcp[k] <= longest[order[k]]
    k, before, after = k[some], before[some], after[some]
    left_less = k - before <= after - k
    small, large = np.where(left_less, before, k), np.where(left_less, k, before)
    small_end, large_end = np.where(left_less, k, after), np.where(left_less, after, k)
    size, depth = small_end - small, lcp[k]
    starts, periods = [], []
    cuts = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + PORTION, PORTION))
    for a, b in zip(cuts[:-1], np.append(cuts[1:-1], len(k)), strict=True):
        if a == b:
            continue
        which = np.repeat(np.arange(a, b), size[a:b])
        place = np.arange(len(which)) - np.repeat(np.cumsum(size[a:b]) - size[a:b], size[a:b]) + small[which]
        i, d = order[place], depth[which]
        lo, hi = large[which], large_end[which]
        for j, first in ((i + d, i), (i - d, i - d)):
            at = rank[np.clip(j, 0, n - 1)]
            hit = (j >= 0) & (j < n) & (lo <= at) & (at < hi)
            starts.append(first[hit])
            periods.append(d[hit])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(periods)


def runs_of(symbols: np.ndarray, size: int, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(start, length, period) of all runs, by start and period; ``first`` holds the first place
    of every document and the number of symbols, and documents have no symbol in common."""
    none = (np.zeros(0, np.int64),) * 3
    if len(symbols) < 2:
        return none
    array = SuffixArray(symbols, size)
    words = np.diff(first)
    square, period = branching_squares(array, np.repeat(words, words))
    if not len(square):
        return none
    end = square + 2 * period
    start = square - array.common(square, square + period, -1)
    some = end - start >= least
    start, end, period = start[some], end[some], period[some]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[fresh], end[fresh], period[fresh]
    by = np.lexsort((period, start))
    return start[by], (end - start)[by], period[by]


def judge_texts(texts: list[bytes], least: int = LEAST) -> Iterator[tuple[int, tuple, bytes]]:
    """(number of words, (start, length, period) of its runs, collapsed text) of every text."""
    at = 0
    while at < len(texts):
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        some, ids, total = [], [], 0
        while at < len(texts) and (not some or total < CHUNK_WORDS):
            words = texts[at].split()  # of bytes: at U+0020 and U+0009 to U+000D only
            some.append(words)
            ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            total += len(words)
            at += 1
        counts = np.array([len(x) for x in some])
        first = np.concatenate([[0], np.cumsum(counts)])
        size = len(some) * max(1, len(number))
        symbols = np.concatenate(ids) + np.repeat(np.arange(len(some)) * len(number), counts)
        start, length, period = runs_of(symbols, size, first, least)
        repeated = np.zeros(total + 1, dtype=np.int64)
        np.add.at(repeated, start + period, 1)
        np.add.at(repeated, start + length, -1)
        kept = np.cumsum(repeated) == 0
        cut = np.searchsorted(start, first)
        for d, words in enumerate(some):
            a, b, own = cut[d], cut[d + 1], slice(first[d], first[d + 1])
            if a < b:
                words = [w for w, k in zip(words, kept[own].tolist(), strict=True) if k]
            yield int(counts[d]), (start[a:b] - first[d], length[a:b], period[a:b]), b" ".join(words)


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Of every row ``doc_id``, ``n_words``, ``runs`` (by start, then period) and ``collapsed``: the
    words, joined by one space, that no run contains after its first period."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            judged = list(judge_texts(b.column("text").cast(pa.large_binary()).to_pylist(), least))
            if not judged:
                continue
            spans = [np.concatenate([runs[k] for _, runs, _ in judged]) for k in range(3)]
            ends = np.concatenate([[0], np.cumsum([len(runs[0]) for _, runs, _ in judged])]).astype(np.int32)
            found = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in spans], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([n for n, _, _ in judged], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found),
                 pa.array([text.decode() for _, _, text in judged], pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, RUN_ROWS)
