"""Suffix-array deduplication of repeated byte strings.

A byte of a document is removed if it lies in a string of ``length`` bytes that also
starts anywhere else, in the same document or another; everything is judged on the
input.  The suffixes are sorted by a distributed difference-cover algorithm, bounded by
the length that matters, and adjacent suffixes of the sorted order are compared.

1. Segments.  Every string of ``length`` bytes has a canonical anchor: the gram (half as
   many bytes) inside it with the smallest hash, the leftmost of equals.  It depends on the
   string alone, so equal strings have equal grams at equal places.  A segment is a run of
   starts whose strings share one anchor; it is known by the hashes of its gram and of its
   bytes.
2. Candidates.  Strings of a gram that occurs once do not repeat.  All strings of a segment
   that occurs twice do repeat.  What is left to decide is the segments that occur once,
   but whose gram occurs in other segments, too: these and one copy of each other segment
   of their grams are sorted.
3. Blocks.  The chosen segments' bytes, neighbours joined to strings, are packed into
   blocks of about ``BLOCK`` bytes, kept as files in the shared folder.
4. Down.  At each level the triples of symbols at positions 1 and 2 modulo 3 of every
   string are sorted globally and named by rank; the names form the strings of the next
   level, whose symbols cover three times as many bytes.  Names that cover ``length``
   bytes need no further level.
5. Up.  The ranks of a level's samples come from the level below.  The remaining suffixes
   (position 0 modulo 3) are merged in: how many suffixes precede another is a sum of
   counts, by first symbol and rank of the next suffix against position 1, by two symbols
   and a rank against position 2.
6. Adjacent prefixes.  In the final order equal ranks are equal strings; neighbours of
   different rank are compared on a 128-bit hash of their ``length`` bytes.  Strings that
   occur at least twice are marked.

A global sort sends every block's *distinct* keys, as one binary row per block and key
range, to the range's task (ranges by sampled splitters) and gets one row back, so equal
keys, however frequent, are one key per block, and no task sees more than its range.
All files have contents that depend only on their inputs, and appear by renaming, so
retried and repeated tasks do no harm.

Defined results: null and empty texts have no bytes; texts shorter than ``length`` lose
nothing; documents are told apart by id and text, and a repeated row is another document
with the same text, so its strings occur twice; a null id is an id like any other.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ohlcflow.llm import bloom
from ohlcflow.llm.common import Workspace, file_system, give_back_memory, small_batches
from ohlcflow.llm.words import _BASE, _INVERSE, mix, powers, text_runs

LENGTH = 200
#: Bytes of a gram, as a share of the length: half leaves half the length for its place.
GRAM_SHARE = 2
#: Bits per repeated gram of the filter that spares segments before they are joined.
GRAM_BITS = 16
#: Bytes of a block of strings, and keys of a range.
BLOCK = 2 << 20
RANGE = 1 << 20
#: Blocks that one task handles, one after the other.
BLOCKS_PER_TASK = 4
#: Least number of blocks, most keys of each, and keys for each range that are looked at to place
#: the splitters.  Documents come to blocks by hash, so a few blocks show the distribution of
#: all; more ranges look at more blocks, so the ranges stay even however many there are.
SAMPLE_BLOCKS, SAMPLE, SAMPLE_PER_RANGE = 8, 4096, 32

_SECOND = 0xD6E8FEB86659FD93
_SECOND_INVERSE = pow(_SECOND, -1, 1 << 64)


# -- segments -------------------------------------------------------------------------


def _sliding(x: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """Best of every ``width`` values in a row."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    y, step = x, 1
    while 2 * step <= width:
        y = best(y[:-step], y[step:])
        step *= 2
    return best(y[:n], y[width - step:width - step + n])


def gram_hashes(data: np.ndarray, width: int, base: int = _BASE, inverse: int = _INVERSE) -> np.ndarray:
    """Hash of every ``width`` bytes in a row."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(data * powers(base, n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(inverse, n - width + 1))


def canonical(order: np.ndarray, width: int) -> np.ndarray:
    """Of the ``width`` values from every place on, the place of the smallest, the first of equals."""
    least = _sliding(order, width, np.minimum)
    pad = np.zeros(width - 1, dtype=order.dtype)
    # places that are the smallest of some run; a run's own is the first that equals its minimum
    places = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == order)
    at = np.searchsorted(places, np.arange(len(least)))
    wrong = np.flatnonzero(order[places[at]] != least)
    while len(wrong):
        at[wrong] += 1
        wrong = wrong[order[places[at[wrong]]] != least[wrong]]
    return places[at]


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts that stand one after the other in ``data``: (text, first start, end of starts, gram
    hash, hash of the bytes) of every segment, in order."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    gram = length // GRAM_SHARE
    g = gram_hashes(data, gram)
    at = canonical((g >> np.uint64(32)).astype(np.uint32), length - gram + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = text[:len(at)] == text[length - 1:]  # strings that do not cross into the next text
    change = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1]) | (text[1:len(at)] != text[:len(at) - 1])
    begin = np.flatnonzero(np.concatenate([[True], change]))
    end = np.append(begin[1:], len(at))
    kept = inside[begin]
    begin, end = begin[kept], end[kept]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(data * powers(_SECOND, len(data)), out=sums[1:])
    whole = (sums[end + length - 1] - sums[begin]) * powers(_SECOND_INVERSE, len(data))[begin]
    first = offsets[text[begin]]
    return text[begin], begin - first, end - first, g[at[begin]], mix(whole + (end - begin).astype(np.uint64))


#: Of a document's segments, as they stand in the ``packed`` bytes.
SEGMENT = np.dtype([("gram", "<i8"), ("seg", "<i8"), ("begin", "<i4"), ("end", "<i4")])
PARSED = "k_id long, k_text long, packed binary"
NO_ID = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with the key that tells them apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k_id"),
                       F.xxhash64(text).alias("k_text"), text.cast("binary").alias("data"))


def parse(docs: DataFrame, length: int) -> DataFrame:
    """The segments of every document of at least ``length`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in text_runs(b.column("data")):
                text, begin, end, gram, seg = segments(data, offsets, length)
                own, count = np.unique(text, return_counts=True)
                rows = np.empty(len(text), dtype=SEGMENT)
                rows["gram"], rows["seg"], rows["begin"], rows["end"] = gram.view(np.int64), seg.view(np.int64), begin, end
                cuts = (np.append(0, np.cumsum(count)) * SEGMENT.itemsize).astype(np.int32)
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(cuts), pa.py_buffer(rows)])
                place = pa.array(at + own, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("k_id").take(place), b.column("k_text").take(place), packed],
                                                 names=["k_id", "k_text", "packed"])

    return keyed(docs).mapInArrow(run, PARSED)


def unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(segments, number of the row that each is of) of a batch of ``parse``."""
    packed = b.column("packed")
    sizes = pa.compute.binary_length(packed).to_numpy() // SEGMENT.itemsize
    return np.frombuffer(b"".join(packed.to_pylist()), dtype=SEGMENT), np.repeat(np.arange(len(sizes)), sizes)


def occurrences(parsed: DataFrame, work: Workspace) -> DataFrame:
    """Segments that repeat or are to be decided: key, ``begin``, ``end``, ``gram``, ``seg``,
    ``copies``, ``open`` (its gram has undecided segments)."""
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gram, n = np.unique(unpacked(b)[0]["gram"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(n, pa.int64())], names=["gram", "n"])

    twice = work.table(parsed.mapInArrow(grams, "gram long, n long").groupBy("gram").agg(
        F.sum("n").alias("n")).filter("n > 1").select("gram"), "grams")
    table = parsed.sparkSession.sparkContext.broadcast(bloom.build(twice, "gram", twice.count(), GRAM_BITS))

    def spare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leave out segments whose gram the filter refutes: it occurs once."""
        for b in batches:
            segs, row = unpacked(b)
            kept = bloom.might_hold(table.value, segs["gram"].view(np.uint64))
            segs, row = segs[kept], pa.array(row[kept])
            yield pa.RecordBatch.from_arrays(
                [b.column("k_id").take(row), b.column("k_text").take(row),
                 *[pa.array(np.ascontiguousarray(segs[c])) for c in ("begin", "end", "gram", "seg")]],
                names=["k_id", "k_text", "begin", "end", "gram", "seg"])

    rows = work.table(parsed.mapInArrow(spare, "k_id long, k_text long, begin int, end int, gram long, seg long"), "segments")
    counts = work.table(rows.groupBy("gram", "seg").agg(F.count("*").alias("copies")), "segment-counts")
    grams = counts.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("copies").alias("all"),
                                       F.sum((F.col("copies") == 1).cast("int")).alias("once")).filter("all > 1")
    kinds = counts.join(grams.select("gram", ((F.col("kinds") > 1) & (F.col("once") > 0)).alias("open")), "gram")
    kinds = kinds.filter((F.col("copies") > 1) | F.col("open"))
    rows = rows.join(kinds, ["gram", "seg"])
    return rows.select("k_id", "k_text", "begin", "end", "gram", "seg", "copies", "open")


# -- blocks ------------------------------------------------------------------------------


class Shelf:
    """Arrays by name in a shared folder; a file appears whole, by renaming."""

    def __init__(self, folder: str):
        self.folder = folder

    def put(self, name: str, array: np.ndarray) -> None:
        fs, folder = file_system(self.folder)
        part = f"{folder}/{name}.{uuid.uuid4().hex}.part"
        with fs.open_output_stream(part) as f:
            np.lib.format.write_array(f, np.ascontiguousarray(array), allow_pickle=False)
        fs.move(part, f"{folder}/{name}")

    def get(self, name: str) -> np.ndarray:
        fs, folder = file_system(self.folder)
        with fs.open_input_file(f"{folder}/{name}") as f:
            return np.load(io.BytesIO(f.read()), allow_pickle=False)

    def drop(self, name: str) -> None:
        fs, folder = file_system(self.folder)
        if fs.get_file_info(f"{folder}/{name}").type != pafs.FileType.NotFound:
            fs.delete_file(f"{folder}/{name}")


#: Of a block's pieces (segments): string, first start in the string, starts, document, place in it, undecided.
PIECE = [("string", "<i8"), ("start", "<i8"), ("n", "<i8"), ("k_id", "<i8"), ("k_text", "<i8"), ("at", "<i8"),
         ("single", "?")]


def make_blocks(docs: DataFrame, chosen: DataFrame, shelf: Shelf, length: int, most: int) -> DataFrame:
    """Write the chosen segments' bytes as blocks of strings; ``block``, ``n`` (bytes) of each."""
    wanted = chosen.groupBy("k_id", "k_text").agg(F.sort_array(F.collect_list(F.struct(
        "begin", "end", (F.col("copies") == 1).alias("single")))).alias("pieces"))
    both = keyed(docs).join(wanted, ["k_id", "k_text"]).select("k_id", "k_text", "data", "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings: list[bytes] = []
        pieces: list[tuple] = []
        size, before = 0, None

        def block() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            shelf.put(f"{name}.s0", np.frombuffer(b"".join(strings), dtype=np.uint8))
            shelf.put(f"{name}.l0", np.array([len(s) for s in strings], dtype=np.int64))
            shelf.put(f"{name}.pieces", np.array(pieces, dtype=PIECE))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], names=["block", "n"])

        for b in batches:
            for k_id, k_text, raw, own in zip(b.column("k_id").to_pylist(), b.column("k_text").to_pylist(),
                                              b.column("data"), b.column("pieces").to_pylist(), strict=True):
                if (k_id, k_text) == before:  # a repeated row: its segments are taken already
                    continue
                before = (k_id, k_text)
                view = memoryview(raw.as_buffer())
                begin = end = 0
                for i, p in enumerate(own):
                    if not i or p["begin"] > end:
                        begin = p["begin"]
                    end = p["end"] + length - 1
                    pieces.append((len(strings), p["begin"] - begin, p["end"] - p["begin"], k_id, k_text, p["begin"],
                                   p["single"]))
                    if i + 1 == len(own) or own[i + 1]["begin"] > end:
                        strings.append(bytes(view[begin:end]))
                        size += end - begin
                        if size >= most:
                            yield block()
                            strings, pieces, size = [], [], 0
        if strings:
            yield block()

    # rows of one document stand together, so a repeated row follows its equal
    return both.sortWithinPartitions("k_id", "k_text").mapInArrow(run, "block string, n long")


# -- strings of one block ----------------------------------------------------------------


def places(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in its string, symbols from there to the string's end) of every symbol."""
    lens = lens.astype(np.int32)  # a block is far smaller
    at = np.arange(int(lens.sum()), dtype=np.int32) - np.repeat(np.cumsum(lens, dtype=np.int32) - lens, lens)
    return at, np.repeat(lens, lens) - at


def child_lens(lens: np.ndarray) -> np.ndarray:
    """Lengths of the next level's strings: those of residue 1 and 2 of each string, in turn."""
    return np.stack([(lens + 1) // 3, lens // 3], axis=1).reshape(-1)


def child_places(lens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the name of each sample (place 1 or 2 modulo 3) stands in the next level's strings."""
    own = child_lens(lens)
    first = (np.cumsum(own) - own).reshape(-1, 2)
    string = np.repeat(np.arange(len(lens)), lens)
    sample = at % 3 > 0
    return first[string[sample], at[sample] % 3 - 1] + at[sample] // 3


def ahead(x: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
    """The symbol ``k`` places on, 0 behind the string's end."""
    out = np.zeros_like(x)
    out[:max(len(x) - k, 0)] = x[k:]
    out[left <= k] = 0
    return out


# -- global sorting ----------------------------------------------------------------------


def pack(columns: list[np.ndarray], most: list[int]) -> list[np.ndarray]:
    """Columns of bounded values as one or more 64-bit columns of the same lexicographic order."""
    out: list[np.ndarray] = []
    used = 64
    for c, m in zip(columns, most, strict=True):
        bits = max(1, int(m).bit_length())
        c = c.astype(np.uint64)
        if used + bits <= 64:
            out[-1] = (out[-1] << np.uint64(bits)) | c
            used += bits
        else:
            out.append(c)
            used = bits
    return out


def sorted_values(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, place of every element among them)."""
    order = np.argsort(x)
    x = x[order]
    new = np.empty(len(x), dtype=bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    back = np.empty(len(x), dtype=np.uint32)
    back[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return x[new], back


def distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(distinct rows in lexicographic order, place of every row among them)."""
    if len(columns) == 1:
        values, back = sorted_values(columns[0])
        return [values], back
    head, rank = distinct(columns[:-1])
    last, low = None, columns[-1]
    if len(low) and int(low.max()) >> 32:  # by rank, too, so that both fit one number
        last, low = sorted_values(low)
    both, back = sorted_values((rank.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64))
    at, low = (both >> np.uint64(32)).astype(np.int64), both & np.uint64(0xFFFFFFFF)
    return [*[h[at] for h in head], low if last is None else last[low.astype(np.int64)]], back


def split_at(columns: list[np.ndarray], splitters: list[tuple]) -> list[int]:
    """First row not below each splitter, for rows in lexicographic order."""
    out = []
    for s in splitters:
        a, z = 0, len(columns[0])
        for c, v in zip(columns, s, strict=True):
            part, v = c[a:z], np.uint64(v)
            a, z = a + int(np.searchsorted(part, v, "left")), a + int(np.searchsorted(part, v, "right"))
        out.append(a)
    return out


def squeeze(columns: list[np.ndarray]) -> bytes:
    """64-bit columns as compressed byte planes; of a rising column the differences."""
    n, head, body = len(columns[0]), [len(columns)], []
    for c in columns:
        c = c.view(np.uint64)
        rising = bool((c[1:] >= c[:-1]).all())
        if rising:
            c = np.diff(c, prepend=np.uint64(0))
        width = max(1, (int(c.max()).bit_length() + 7) // 8)
        head += [rising, width]
        body.append(np.ascontiguousarray(c.view(np.uint8).reshape(n, 8)[:, :width].T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(bytes(head) + b"".join(body))


def unsqueeze(body: pa.Scalar, n: int) -> np.ndarray:
    """The columns of ``squeeze`` as rows of a uint64 array."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body.as_buffer()), dtype=np.uint8)
    count = int(raw[0])
    out = np.zeros((count, n), dtype=np.uint64)
    at = 1 + 2 * count
    for k in range(count):
        rising, width = raw[1 + 2 * k], int(raw[2 + 2 * k])
        out[k].view(np.uint8).reshape(n, 8)[:, :width] = raw[at:at + width * n].reshape(width, n).T
        at += width * n
        if rising:
            np.cumsum(out[k], out=out[k])
    return out


@dataclass
class Round:
    """One global sort of keys that the blocks have, in one or more families of their own order.

    ``keys(get, family)`` gives a block's elements: key columns, columns carried along (a
    function of the key), weight columns.  ``answer(columns, carried, weights)`` turns
    the distinct keys of a range, with summed weights, into answer columns by key and a
    few numbers to tell.  ``apply(get, put, found)`` receives for every family a block's
    answers and ranges by element, and what the ranges told, in their order.
    ``elements`` is about how many a family has; it sets the number of ranges."""

    keys: Callable
    answer: Callable
    apply: Callable
    elements: float
    families: int = 1


class Sorter:
    def __init__(self, work: Workspace, blocks: DataFrame, shelf: Shelf, n_blocks: int, total: int, keys: int):
        self.work, self.shelf = work, shelf
        self.blocks = blocks.select("block").repartition(-(-n_blocks // BLOCKS_PER_TASK))
        self.names = blocks.select("block")
        self.total, self.range_keys = total, keys
        self.number, self.stale = 0, []

    def _splitters(self, r: Round, ranges: int) -> list[list[tuple]]:
        """By family, keys that part the ranges: quantiles of evenly spaced elements of some blocks."""
        shelf, each = self.shelf, max(8, min(SAMPLE, 64 * ranges))
        looked_at = max(SAMPLE_BLOCKS, -(-SAMPLE_PER_RANGE * ranges // SAMPLE))
        some = self.names.orderBy("block").limit(looked_at).repartition(max(2, looked_at // BLOCKS_PER_TASK))

        def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name in b.column("block").to_pylist():
                    for f in range(r.families):
                        columns, _, _ = r.keys(lambda x, name=name: shelf.get(f"{name}.{x}"), f)
                        n = len(columns[0])
                        at = np.unique(np.linspace(0, n - 1, min(n, each)).astype(np.int64)) if n else []
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([f], pa.int32()), pa.array([[c[at].view(np.int64).tolist() for c in columns]],
                                                                 pa.list_(pa.list_(pa.int64())))],
                            names=["family", "picked"])

        if ranges == 1:
            return [[] for _ in range(r.families)]
        rows: list[list[tuple]] = [[] for _ in range(r.families)]
        picked = some.mapInArrow(sample, "family int, picked array<array<long>>")
        for x in picked.toArrow().to_pylist():
            rows[x["family"]] += zip(*[[v & 0xFFFFFFFFFFFFFFFF for v in c] for c in x["picked"]], strict=True)
        return [sorted({v[len(v) * i // ranges] for i in range(1, ranges)}) if v else [] for v in map(sorted, rows)]

    def run(self, r: Round, stale: tuple[str, ...] = ()) -> list[list]:
        """Do a round; afterwards the blocks' files ``stale`` go.  Returns the tells by family."""
        ranges = max(1, math.ceil(r.elements / self.range_keys))
        shelf, splitters, work, gone = self.shelf, self._splitters(r, ranges), self.work, self.stale
        self.number += 1
        tag = f"round{self.number}"

        def merge(own: list, back: np.ndarray, carried: list, weights: list) -> tuple[list, list]:
            n = len(own[0])
            more = [np.empty(n, dtype=np.uint64) for _ in carried]
            for m, c in zip(more, carried, strict=True):
                m[back] = c
            return more, [np.bincount(back, weights=w, minlength=n).astype(np.uint64) for w in weights]

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name in b.column("block").to_pylist():
                    for x in gone:  # of rounds that are over
                        shelf.drop(f"{name}.{x}")
                    for f in range(r.families):
                        columns, carried, weights = r.keys(lambda x, name=name: shelf.get(f"{name}.{x}"), f)
                        own, back = distinct(columns)
                        more, sums = merge(own, back, carried, weights)
                        cuts = [0, *split_at(own, splitters[f]), len(own[0])]
                        shelf.put(f"{name}.{tag}-{f}", back)
                        shelf.put(f"{name}.{tag}-{f}-cuts", np.array(cuts))
                        shape = [len(own), len(more), len(sums)]
                        for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                            if z > a:
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array([f * ranges + k], pa.int32()), pa.array([name]),
                                     pa.array([z - a], pa.int32()), pa.array([shape], pa.list_(pa.int32())),
                                     pa.array([squeeze([c[a:z] for c in [*own, *more, *sums]])], pa.binary())],
                                    names=["range", "block", "n", "shape", "body"])
                        del columns, own, back, more, sums, carried, weights
            give_back_memory()

        def rank(t: pa.Table) -> pa.Table:
            t = t.sort_by("block")
            n_key, n_more, _ = t["shape"][0].as_py()
            sizes = t["n"].to_pylist()
            parts = np.cumsum([0, *sizes])
            merged = np.empty((sum(t["shape"][0].as_py()), parts[-1]), dtype=np.uint64)
            for x, n, a in zip(t["body"], sizes, parts.tolist(), strict=False):
                merged[:, a:a + n] = unsqueeze(x, n)
            own, back = distinct(list(merged[:n_key]))
            more, sums = merge(own, back, list(merged[n_key:n_key + n_more]), merged[n_key + n_more:])
            del merged
            answers, tell = r.answer(own, more, [x.astype(np.int64) for x in sums])
            out = [squeeze([x[back[a:z]].astype(np.int64) for x in answers])
                   for a, z in zip(parts, parts[1:], strict=False)]
            del own, back, more, sums, answers
            give_back_memory()
            return pa.table({"range": t["range"], "block": t["block"], "n": t["n"], "body": pa.array(out, pa.binary()),
                             "tell": pa.array([tell] + [None] * (len(out) - 1), pa.list_(pa.int64()))})

        sent = self.blocks.mapInArrow(send, "range int, block string, n int, shape array<int>, body binary")
        replies = work.table(sent.groupBy("range").applyInArrow(
            rank, "range int, block string, n int, body binary, tell array<long>"), f"replies-{tag}")
        told = sorted((x["range"], x["tell"]) for x in replies.filter(F.col("tell").isNotNull()).select(
            "range", "tell").toArrow().to_pylist())  # one row per range
        tells = [[(k % ranges, t) for k, t in told if k // ranges == f] for f in range(r.families)]
        del sent
        work.release()

        def take(t: pa.Table) -> pa.Table:
            name = t["block"][0].as_py()
            t = t.sort_by("range")
            rows = list(zip(t["range"].to_pylist(), t["body"], t["n"].to_pylist(), strict=True))
            found = []
            for f in range(r.families):
                back, cuts = shelf.get(f"{name}.{tag}-{f}"), shelf.get(f"{name}.{tag}-{f}-cuts")
                parts = [unsqueeze(x, n) for k, x, n in rows if k // ranges == f]
                answers = np.concatenate(parts, axis=1).view(np.int64) if parts else np.zeros((2, 0), np.int64)
                which = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                found.append(([x[back] for x in answers], which[back], tells[f] or [(0, [0, 0])]))
            r.apply(lambda x: shelf.get(f"{name}.{x}"), lambda x, a: shelf.put(f"{name}.{x}", a), found)
            return pa.table({"block": [name]})

        taken = replies.select("block", "range", "n", "body").groupBy("block").applyInArrow(take, "block string")
        work.table(taken, f"taken-{tag}")
        del replies, taken
        work.drop(f"replies-{tag}")
        work.release()
        self.stale = [*stale, *[f"{tag}-{f}{x}" for f in range(r.families) for x in ("", "-cuts")]]
        return tells


def dense(columns: list, _, __) -> tuple[list, list[int]]:
    """Rank among the distinct keys."""
    return [np.arange(len(columns[0]))], [len(columns[0])]


def below(_, __, weights: list) -> tuple[list, list[int]]:
    """Weight of each class on smaller keys."""
    return [np.cumsum(w) - w for w in weights], [int(w.sum()) for w in weights]


def bases(tells: list) -> np.ndarray:
    """What all smaller ranges told, summed: one row per range."""
    told = np.zeros((tells[-1][0] + 2, len(tells[0][1])), dtype=np.int64)
    for k, t in tells:
        told[k + 1] = t
    return np.cumsum(told, axis=0)


# -- the difference cover, level by level --------------------------------------------------


def small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32 if not len(x) or int(x.max()) < 1 << 32 else np.uint64)


def suffix_ranks(sorter: Sorter, length: int) -> None:
    """Give every block ``r0``: a rank for each of its suffixes.

    Suffixes that differ in their first ``length`` bytes are ranked in their order."""
    most_rank = sorter.total + 1
    depth = 1
    while 3 ** depth < length:
        depth += 1
    most = [256]  # largest symbol of every level

    def symbols(get: Callable, level: int) -> np.ndarray:
        return get("s0").astype(np.uint32) + 1 if level == 0 else get(f"s{level}")

    def down(level: int, last: bool) -> Round:
        def keys(get, _):
            s, (at, left) = symbols(get, level), places(get(f"l{level}"))
            sample = at % 3 > 0
            columns = pack([s[sample], ahead(s, left, 1)[sample], ahead(s, left, 2)[sample]], [most[level]] * 3)
            return columns, [], [np.ones(len(columns[0]))]

        def apply(get, put, found):
            answers, which, tells = found[0]
            lens = get(f"l{level}")
            name = answers[0] + bases(tells)[which, 0]
            next_level = np.empty(len(name), dtype=np.int64)
            next_level[child_places(lens, places(lens)[0])] = name
            # the names of the last level serve as its ranks alone
            put(f"r{level + 1}" if last else f"s{level + 1}", small(next_level + (0 if last else 1)))
            put(f"l{level + 1}", child_lens(lens))

        return Round(keys, below if last else dense, apply, sorter.total * (2 / 3) ** (level + 1))

    for level in range(depth):
        tells = sorter.run(down(level, level + 1 == depth))
        most.append(sum(t[0] for _, t in tells[0]) + 1)

    def sample_ranks(get: Callable, level: int, lens: np.ndarray, at: np.ndarray) -> np.ndarray:
        """By position: how many samples precede a sample, and 1; else 0."""
        rank = np.zeros(len(at), dtype=np.int64)
        rank[at % 3 > 0] = get(f"r{level + 1}").astype(np.int64)[child_places(lens, at)] + 1
        return rank

    def up(level: int) -> Round:
        """Merge suffixes at places 0 modulo 3 with the samples at places 1 and at places 2."""
        def keys(get, family):
            other = family + 1
            lens, s = get(f"l{level}"), symbols(get, level)
            at, left = places(lens)
            rank = ahead(sample_ranks(get, level, lens, at), left, other)
            residue = at % 3
            chosen = (residue == 0) | (residue == other)
            columns, most_of = [s], [most[level]]
            if other == 2:  # the ranks of both stand two places on
                columns, most_of = [s, ahead(s, left, 1)], [most[level]] * 2
            columns = pack([c[chosen] for c in [*columns, rank]], [*most_of, most_rank])
            zero = (residue[chosen] == 0).astype(np.float64)
            return columns, [], [zero, 1 - zero]

        def apply(get, put, found):
            lens = get(f"l{level}")
            at, _ = places(lens)
            rank = np.maximum(sample_ranks(get, level, lens, at) - 1, 0)
            for family, (answers, which, tells) in enumerate(found):
                base = bases(tells)
                zeros, others = answers[0] + base[which, 0], answers[1] + base[which, 1]
                chosen = (at % 3 == 0) | (at % 3 == family + 1)
                # a merged suffix has the samples before it and, once, its own kind; a sample the merged ones
                rank[chosen] += np.where(at[chosen] % 3 == 0, others + (0 if family else zeros), zeros)
            put(f"r{level}", small(rank))

        return Round(keys, below, apply, sorter.total * (2 / 3) ** (level + 1), families=2)

    for level in range(depth - 1, -1, -1):
        sorter.run(up(level), (f"r{level + 1}", f"l{level + 1}", f"s{level + 1}"))


def window_starts(pieces: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the block, piece, place in the piece) of every start."""
    first = np.cumsum(lens) - lens
    n = pieces["n"]
    piece = np.repeat(np.arange(len(pieces)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return (first[pieces["string"]] + pieces["start"])[piece] + at, piece, at


def mark_repeats(sorter: Sorter, length: int) -> None:
    """Compare adjacent prefixes: give every block ``dup``, one flag per start."""
    def keys(get, _):
        data = get("s0")
        at, _, _ = window_starts(get("pieces"), get("l0"))
        one, two = gram_hashes(data, length), gram_hashes(data, length, _SECOND, _SECOND_INVERSE)
        return [get("r0").astype(np.uint64)[at]], [one[at], two[at]], [np.ones(len(at))]

    def answer(columns, carried, weights):
        """1 if a prefix repeats within the range, 2 and 3 in its first and last run of equal prefixes."""
        one, two = carried
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        run = np.cumsum(new) - 1
        times = np.bincount(run, weights=weights[0]).astype(np.int64)
        out = (times > 1).astype(np.int64)[run]
        out[run == run[-1]] = 3
        out[run == 0] = 2
        ends = [int(x[k].view(np.int64)) for k in (0, -1) for x in (one, two)]
        return [out], [*ends, int(times[0]), int(times[-1]), len(times)]

    def apply(get, put, found):
        answers, which, tells = found[0]
        repeats = np.zeros((2, tells[-1][0] + 1), dtype=bool)  # of the ranges' first and last runs
        run: list[tuple[int, int]] = []  # ends of neighbouring ranges that are one run
        times, prefix = 0, None
        for k, (a1, a2, z1, z2, n_first, n_last, n_runs) in tells:
            if prefix != (a1, a2):
                run, times = [], 0
            run.append((0, k))
            times, prefix = times + n_first, (a1, a2)
            for side, j in run:
                repeats[side][j] = times > 1
            if n_runs > 1:
                run, times, prefix = [(1, k)], n_last, (z1, z2)
                repeats[1][k] = times > 1
        flag = answers[0]
        put("dup", np.where(flag == 2, repeats[0][which], np.where(flag == 3, repeats[1][which], flag == 1)))

    sorter.run(Round(keys, answer, apply, sorter.total))


def marked_spans(sorter: Sorter) -> DataFrame:
    """``k_id``, ``k_text``, ``a``, ``z``: the runs of marked starts of undecided segments."""
    shelf = sorter.shelf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("block").to_pylist():
                pieces = shelf.get(f"{name}.pieces")
                _, piece, at = window_starts(pieces, shelf.get(f"{name}.l0"))
                dup = shelf.get(f"{name}.dup").astype(bool) & pieces["single"][piece]
                edge = np.concatenate([[True], piece[1:] != piece[:-1], [True]])[:len(piece) + 1]
                begin = np.flatnonzero(dup & (edge[:-1] | ~np.concatenate([[False], dup])[:-1]))
                end = np.flatnonzero(dup & (edge[1:] | ~np.concatenate([dup, [False]])[1:]))
                own = pieces[piece[begin]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own["k_id"], pa.int64()), pa.array(own["k_text"], pa.int64()),
                     pa.array(own["at"] + at[begin], pa.int32()), pa.array(own["at"] + at[end] + 1, pa.int32())],
                    names=["k_id", "k_text", "a", "z"])

    return sorter.blocks.mapInArrow(run, "k_id long, k_text long, a int, z int")


# -- documents -----------------------------------------------------------------------------


def repeated_starts(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, keys: int = RANGE) -> DataFrame:
    """``k_id``, ``k_text``, ``spans``: of every document the runs of starts of repeated strings, in order.

    ``block`` (bytes) and ``keys`` size the tasks."""
    spark = docs.sparkSession
    small_batches(spark)
    work = Workspace(spark, "suffix-dedup")
    shelf = Shelf(f"{work.folder}/blocks")
    fs, folder = file_system(shelf.folder)
    fs.create_dir(folder, recursive=True)
    near = work.table(occurrences(work.table(parse(docs, length), "parsed"), work), "occurrences")
    work.release()
    for name in ("parsed", "grams", "segments", "segment-counts"):
        work.drop(name)
    spans = near.filter("copies > 1").select("k_id", "k_text", F.col("begin").alias("a"), F.col("end").alias("z"))
    # of each segment that repeats, one copy: that of the smallest document, first in it
    first = near.filter("open AND copies > 1").groupBy("gram", "seg").agg(F.min(F.struct(
        "k_id", "k_text", "begin", "end", "copies")).alias("one")).select("one.*")
    chosen = near.filter("open AND copies = 1").select(*first.columns).unionByName(first)
    blocks = work.table(make_blocks(docs, chosen, shelf, length, block), "block-names")
    size = blocks.agg(F.count("*").alias("n"), F.sum("n").alias("total")).first()
    work.release()
    if size.n:
        sorter = Sorter(work, blocks, shelf, size.n, size.total, keys)
        suffix_ranks(sorter, length)
        mark_repeats(sorter, length)
        spans = spans.unionByName(work.table(marked_spans(sorter), "marked"))
    found = work.table(spans.groupBy("k_id", "k_text").agg(F.sort_array(F.collect_set(F.struct("a", "z"))).alias(
        "spans")), "spans")
    for name in ("blocks", "occurrences"):
        work.drop(name)
    work.release()
    return found


def kept_bytes(data: memoryview, spans: list[tuple[int, int]], length: int) -> tuple[bytes, int]:
    """(what is left, maximal removed runs) when strings starting in sorted ``spans`` go."""
    out, at, runs = [], 0, 0
    for a, z in spans:
        z += length - 1
        if a > at or (not runs and a == at):
            out.append(data[at:a])
            runs += 1
        at = max(at, z)
    out.append(data[at:])
    return b"".join(out), runs


def remove_repeats(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, keys: int = RANGE) -> DataFrame:
    """``doc_id``, ``kept`` (binary), ``n_bytes``, ``n_removed``, ``n_spans`` for every row of ``docs``."""
    starts = repeated_starts(docs, length, block, keys)
    d = keyed(docs)
    d = d.join(starts, ["k_id", "k_text"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k_id, raw, spans in zip(b.column("k_id").to_pylist(), b.column("data"), b.column("spans"), strict=True):
                view = memoryview(raw.as_buffer())
                kept, runs = kept_bytes(view, [(s["a"], s["z"]) for s in spans.as_py() or ()], length)
                rows.append((None if k_id == NO_ID else k_id, kept, len(view), len(view) - len(kept), runs))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return d.select("k_id", "data", "spans").mapInArrow(
        run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def rewrite(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, keys: int = RANGE) -> DataFrame:
    """``docs`` with all columns and only what is left of ``text``.

    Cut inside a character, its bytes go too; a text of which nothing is left becomes
    null, null and empty texts stay as they are."""
    starts = repeated_starts(docs, length, block, keys)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)
                                                                         ).alias("k_id"), F.xxhash64(text).alias("k_text"))
    rows = rows.join(starts, ["k_id", "k_text"], "left").select("row", "spans")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = pa.RecordBatch.from_struct_array(b.column("row"))
            texts = []
            for t, spans in zip(row.column(at).to_pylist(), b.column("spans"), strict=True):
                if t and spans.is_valid:
                    kept, _ = kept_bytes(memoryview(t.encode()), [(s["a"], s["z"]) for s in spans.as_py()], length)
                    t = kept.decode("utf-8", "ignore") or None
                texts.append(t)
            columns = list(row.columns)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=row.schema.names)

    schema = T.StructType([T.StructField(f.name, f.dataType, f.nullable or f.name == "text") for f in docs.schema])
    return rows.mapInArrow(run, schema)
