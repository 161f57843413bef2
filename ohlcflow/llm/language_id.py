"""Language identification by words first, character n-grams for unseen words.

A word that the model knows scores its log frequency in every language.  An unseen word
falls back to its character 5-grams (with marks for its ends); if none of them is known
to its 4-grams, and so on down to single characters; the mean log frequency of the known
n-grams of the first length that has any is its score.  A text's language is the one
with the largest sum over all its words; the score is that language's share of the
posterior with equal priors.

Words are maximal runs of letters and marks of the lower-cased text.  Fitting uses a
bounded sample (about ``per_language`` documents of each language, chosen by a hash of
the id), counted by Spark; of each kind (words, n-grams of each length) a language keeps
at most ``keep`` entries, the most frequent by a count threshold.  The model that is
broadcast holds the kept entries only (16 bytes each, so at most some 4 MB a language) and
one score a language and kind for what a language does not have; there may be any number
of languages.

Defined results: null text or text without a letter is ``und`` with score 0; so is every
text if there is nothing to learn from; equal sums go to the language that sorts first;
a text none of whose characters is known has equal sums.  Rows with null language are
not learned from; repeated rows each count.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ohlcflow.llm.common import small_batches
from ohlcflow.llm.words import RUN_BYTES, Words, find_words, mix
from ohlcflow.session import scratch_table

PER_LANGUAGE = 1000
KEEP = 40_000
LONGEST = 5
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def letter_classes() -> np.ndarray:
    """Class table over code points: letters and marks stand for themselves, all else parts words."""
    t = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(1, sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] in "LM":
            t[c] = c
    return t


@functools.lru_cache(maxsize=1)
def is_letter() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


def word_runs(texts: list[str]) -> Iterator[tuple[int, Words]]:
    """(number of the first text, words) of runs of about ``RUN_BYTES`` characters."""
    at = 0
    while at < len(texts):
        run, size = [], 0
        while at + len(run) < len(texts) and (not run or size + len(texts[at + len(run)]) <= RUN_BYTES):
            run.append(texts[at + len(run)].lower())
            size += len(run[-1])
        data = np.frombuffer("".join(run).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in run])]).astype(np.int64)
        yield at, find_words(data, offsets, letter_classes())
        at += len(run)


def grams(w: Words, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position in ``which``) of the n-grams of the chosen words, ends marked by 1 and 2."""
    size = w.end[which] - w.start[which] + 2
    total = int(size.sum())
    word = np.repeat(np.arange(len(which)), size)
    first = np.cumsum(size) - size
    place = np.arange(total) - first[word]
    c = w.data[np.clip(w.start[which][word] + place - 1, 0, max(len(w.data) - 1, 0))].astype(np.uint64) \
        if len(w.data) else np.zeros(0, np.uint64)
    c[place == 0] = 1
    c[place == size[word] - 1] = 2
    ok = place + n <= size[word]
    if n == 1:  # a mark alone says nothing
        ok &= (place > 0) & (place < size[word] - 1)
    at = np.flatnonzero(ok)
    h = np.full(len(at), n, dtype=np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0x100000001B3) + c[at + k])
    return h, word[at]


def count_entries(texts: list[str], language: np.ndarray) -> tuple[np.ndarray, ...]:
    """(language, kind, hash, count) of the words (kind 0) and n-grams (kind n) of a batch."""
    out = []
    for at, w in word_runs(texts):
        lang = language[at:at + len(w.offsets) - 1][w.doc]
        order = np.lexsort((w.hash, lang))
        new = np.concatenate([[True], (w.hash[order][1:] != w.hash[order][:-1]) | (lang[order][1:] != lang[order][:-1])]
                             )[:len(order)]
        which = order[new]
        times = np.diff(np.append(np.flatnonzero(new), len(order)))
        out.append((lang[which], np.zeros(len(which), np.int32), w.hash[which], times))
        for n in range(1, LONGEST + 1):
            h, word = grams(w, which, n)
            g_lang, g_times = lang[which][word], times[word]
            order = np.lexsort((h, g_lang))
            edge = np.concatenate([[True], (h[order][1:] != h[order][:-1])
                                   | (g_lang[order][1:] != g_lang[order][:-1])])[:len(order)]
            starts = np.flatnonzero(edge)
            sums = np.add.reduceat(g_times[order], starts) if len(starts) else g_times[:0]
            out.append((g_lang[order][starts], np.full(len(starts), n, np.int32), h[order][starts], sums))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


@dataclass
class Kind:
    """The entries of one kind: for each known hash a score in some of the languages.

    Row r of ``keys`` has the entries ``[first[r], first[r + 1])``: languages and how far their log
    frequency lies above ``unseen``, that of an entry which a language does not have."""

    keys: np.ndarray
    first: np.ndarray
    language: np.ndarray
    above: np.ndarray
    unseen: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 if unknown."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``rows``, place among the entries) of all entries of the rows."""
        n = self.first[rows + 1] - self.first[rows]
        which = np.repeat(np.arange(len(rows)), n)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + self.first[rows][which]


@dataclass
class Model:
    languages: list[str]
    kinds: list[Kind]

    def find(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        return self.kinds[kind].find(hashes)

    @property
    def scores(self) -> list[np.ndarray]:
        """By kind: log frequency of each key in each language, as a whole matrix."""
        out = []
        for k in self.kinds:
            m = np.tile(k.unseen, (len(k.keys), 1))
            row, at = k.entries(np.arange(len(k.keys)))
            m[row, k.language[at]] += k.above[at]
            out.append(m)
        return out

    def word_parts(self, w: Words, which: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Of the chosen words: the kind that each is scored by (-1: none knows it), and the scores above
        that kind's unseen ones as (word, language, value)."""
        kind = np.full(len(which), -1)
        parts = []
        left = np.arange(len(which))
        for n in (0, *range(LONGEST, 0, -1)):
            if not len(left):
                break
            k = self.kinds[n]
            h, word = (w.hash[which[left]], np.arange(len(left))) if n == 0 else grams(w, which[left], n)
            row = k.find(h)
            known = row >= 0
            hits = np.bincount(word[known], minlength=len(left))
            at, entry = k.entries(row[known])
            own = word[known][at]
            parts.append((left[own], k.language[entry], k.above[entry] / hits[own]))
            kind[left[hits > 0]] = n
            left = left[hits == 0]
        return kind, tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else ((), (), ())

    def word_scores(self, w: Words, which: np.ndarray) -> np.ndarray:
        """Score of each chosen word in each language."""
        kind, (word, language, value) = self.word_parts(w, which)
        out = np.zeros((len(which), len(self.languages)))
        for n, k in enumerate(self.kinds):
            out[kind == n] = k.unseen
        np.add.at(out, (word, language), value)
        return out

    def totals(self, w: Words, n_docs: int) -> np.ndarray:
        """Sum of the scores of each text's words, by language."""
        _, which, back, times = np.unique(w.hash, return_index=True, return_inverse=True, return_counts=True)
        kind, (word, language, value) = self.word_parts(w, which)
        width = len(self.languages)
        out = np.zeros(n_docs * width)
        # the words' entries, met at every occurrence of the word
        by_word = np.argsort(word, kind="stable")
        n = np.bincount(word, minlength=len(which))
        first = np.cumsum(n) - n
        order = np.argsort(back, kind="stable")
        step = max(1, (1 << 22) // max(1, int(n.max(initial=0))))
        for a in range(0, len(order), step):  # bounded portions of occurrences
            some = order[a:a + step]
            own = back[some]
            at = np.repeat(np.arange(len(some)), n[own])
            entry = by_word[np.arange(len(at)) - np.repeat(np.cumsum(n[own]) - n[own], n[own]) + first[own][at]]
            out += np.bincount(w.doc[some][at] * width + language[entry], weights=value[entry], minlength=len(out))
        out = out.reshape(n_docs, width)
        for k, entries in enumerate(self.kinds):
            out += np.bincount(w.doc[kind[back] == k], minlength=n_docs)[:, None] * entries.unseen
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        best = np.full(len(texts), -1)
        score = np.zeros(len(texts))
        for at, w in word_runs(texts):
            n = len(w.offsets) - 1
            letters = is_letter()[w.data]
            has = np.zeros(n, dtype=bool)
            if len(letters):
                seen = np.concatenate([[0], np.cumsum(letters)])
                has = seen[w.offsets[1:]] > seen[w.offsets[:-1]]
            if not self.languages or not len(w.hash):
                continue
            total = self.totals(w, n)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            best[at:at + n][has] = total.argmax(axis=1)[has]
            score[at:at + n][has] = share[has]
        return [self.languages[i] if i >= 0 else UNKNOWN for i in best], score


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, keep: int = KEEP) -> Model:
    """Learn from ``doc_id``, ``text`` and ``lang`` of ``docs``."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text"),
                    F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull())
    sizes = d.groupBy("lang").agg(F.count("*").alias("size"))
    # written, so that the planner knows its size: no text is shuffled for it
    numbered = scratch_table(sizes.select("lang", (F.row_number().over(Window.orderBy("lang")) - 1).alias("language"),
                            F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("size")).alias("rate")), "languages")
    languages = [r.lang for r in numbered.orderBy("language").select("lang").collect()]  # the model's own names
    u = F.pmod(F.xxhash64(F.coalesce("_id", F.lit(0))), F.lit(1 << 20)) / F.lit(float(1 << 20))
    some = d.join(numbered, "lang").filter(u < F.col("rate")).select("text", "language")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, kind, h, n = count_entries(b.column("text").to_pylist(), b.column("language").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.int32()), pa.array(kind, pa.int32()), pa.array(h.view(np.int64), pa.int64()),
                 pa.array(n, pa.int64())], names=["language", "kind", "h", "n"])

    entries = some.mapInArrow(run, "language int, kind int, h long, n long").groupBy("language", "kind", "h").agg(
        F.sum("n").alias("n")).checkpoint()
    # a count threshold for each language and kind: the smallest that keeps at most `keep` entries
    by_count = entries.groupBy("language", "kind", F.least("n", F.lit(1000)).alias("at")).agg(
        F.count("*").alias("entries"), F.sum("n").alias("total"))
    down = Window.partitionBy("language", "kind").orderBy(F.desc("at"))
    least = scratch_table(by_count.withColumn("kept", F.sum("entries").over(down)).groupBy("language", "kind").agg(
        F.coalesce(F.min(F.when(F.col("kept") <= keep, F.col("at"))), F.lit(1000)).alias("least"),
        F.sum("total").alias("total")), "language-thresholds")
    frequent = entries.join(least, ["language", "kind"]).filter("n >= least").select("language", "kind", "h", "n").toArrow()
    totals = {(r.language, r.kind): r.total for r in least.collect()}  # languages x kinds
    language, kind, h, n = (frequent[c].to_numpy() for c in ("language", "kind", "h", "n"))
    kinds = []
    for k in range(LONGEST + 1):
        own = kind == k
        keys, row = np.unique(h[own].view(np.uint64), return_inverse=True)
        order = np.lexsort((language[own], row))
        total = np.array([totals.get((i, k), 0) for i in range(len(languages))], dtype=np.float64) + len(keys) + 1.0
        unseen = np.log(0.5 / total)
        lang = language[own][order]
        above = np.log((n[own][order] + 0.5) / total[lang]) - unseen[lang] if len(lang) else np.zeros(0)
        first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(keys)))]).astype(np.int64)
        kinds.append(Kind(keys, first, lang.astype(np.int32), above.astype(np.float32), unseen))
    return Model(languages, kinds)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` of every whole text; only the text is looked at."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()),
                                              pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
                       ).mapInArrow(run, "doc_id long, lang_pred string, score double")
