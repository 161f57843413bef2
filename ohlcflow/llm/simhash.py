"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint has 64 bits: a bit is set if it is set in more than half of
the XXH64 hashes of its word shingles.  Fingerprints that differ in at most
``distance`` bits are linked; the groups are the components of these links.

Multi-index hashing: fingerprints are cut into segments.  Two fingerprints within the
distance differ in at most ``distance // segments`` bits in some segment, so a table by
segment value is asked for every value of a small Hamming ball around each
fingerprint's segment; the fetched fingerprints are verified on all bits.  Of the two
sides of a pair only the one with the smaller segment value (or fingerprint) asks, and
a pair counts in the first segment that shows it, so each link is found once.  The
number of segments follows from the number of different fingerprints and changes the
work, not the links.

Fingerprints are made distinct before the search, so copies are never paired; groups
are found on fingerprints and carried back to the documents.

Defined results: null and empty texts have fingerprint zero, linked like any other;
texts with fewer words than a shingle are one shingle; a group's id is its smallest
doc_id (null only if all of them are null); repeated rows each get their row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohlcflow.llm.common import id_and_text, small_batches
from ohlcflow.llm.graph import connected_components
from ohlcflow.session import scratch_table

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Shingles of one text that are held as single bits at a time.
BIT_ROWS = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of a text."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[width - 1:].tolist(),
                                                                     strict=True)), dtype="<u8", count=n)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, BIT_ROWS):
        bits = np.unpackbits(hashes[i:i + BIT_ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``text_hash``, ``fp`` (the fingerprint's bits as a signed long)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(fp.view(np.int64), pa.int64())],
                names=["doc_id", "text_hash", "fp"])

    return id_and_text(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        run, "doc_id long, text_hash long, fp long")


#: A fingerprint with more than this part of all rows is joined back by broadcast.
HOT_SHARE = 200


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(radius + 1))


def segments_for(n: int, distance: int) -> int:
    """Two or three segments: whichever costs fewer probes and fetched fingerprints for ``n``."""
    def cost(m: int) -> float:
        return m * ball(64 // m, distance // m) * (1 + n / 2 ** (64 // m))
    return min((3, 2), key=cost)


def links(nodes: DataFrame, distance: int = DISTANCE, segments: int | None = None) -> DataFrame:
    """``u``, ``v``: pairs of different fingerprints of ``nodes`` (distinct ``fp``) within ``distance`` bits."""
    m = segments or segments_for(nodes.count(), distance)
    radius = distance // m
    cuts = [64 * s // m for s in range(m + 1)]
    widths = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]

    def masks(width: int) -> list[int]:
        found = [0]
        for _ in range(radius):
            found = sorted({x | 1 << i for x in found for i in range(width)} | set(found))
        return found

    def segment(fp, s: int):
        return F.shiftrightunsigned(fp, cuts[s]).bitwiseAND(F.lit((1 << widths[s]) - 1))

    own = F.array(*[F.struct(F.lit(s).alias("s"), segment(F.col("fp"), s).alias("value")) for s in range(m)])
    entries = nodes.select("fp", F.explode(own).alias("k")).select(
        F.col("k.s").alias("s"), F.col("k.value").alias("value"), F.col("fp").alias("v"))
    by_segment = F.array(*[F.array(*[F.lit(x).cast("long") for x in masks(w)]) for w in widths])
    asked = entries.select("s", F.col("value").alias("from"), F.col("v").alias("u"),
                           F.explode(F.get(by_segment, F.col("s"))).alias("mask"))
    asked = asked.select("s", "u", "from", F.col("from").bitwiseXOR(F.col("mask")).alias("value")).filter(
        F.col("value") >= F.col("from"))
    differ = F.col("u").bitwiseXOR(F.col("v"))
    checks = [F.bit_count(differ) <= distance, (F.col("value") > F.col("from")) | (F.col("u") < F.col("v"))]
    for s in range(m - 1):
        checks.append((F.col("s") <= s) | (F.bit_count(segment(differ, s)) > radius))
    near = asked.join(entries, ["s", "value"])
    for c in checks:
        near = near.filter(c)
    return near.select("u", "v")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``text_hash``, ``fp``, ``root`` (smallest fingerprint of the group) and
    ``component_id`` (smallest doc_id of the group) for every row of ``docs``."""
    fps = scratch_table(fingerprints(docs, shingle, seed), "simhash-fp")
    nodes = scratch_table(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
    roots = scratch_table(connected_components(links(nodes, distance)), "simhash-roots").withColumnRenamed("node", "fp")
    least = nodes.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch_table(nodes.join(roots.join(least, "root"), "fp", "left").select(
        "fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id")),
        "simhash-named")
    # the copies of one text are one fingerprint: those that hold a large share of the rows (at most
    # HOT_SHARE fingerprints) are broadcast, so no task meets all copies of one; the others are joined by key
    most = F.lit(fps.count() // HOT_SHARE)
    hot = F.broadcast(named.filter(F.col("n") > most).drop("n"))
    rest = fps.join(hot.select("fp"), "fp", "left_anti").join(named.filter(F.col("n") <= most).drop("n"), "fp")
    return fps.join(hot, "fp").unionByName(rest).select("doc_id", "text_hash", "fp", "root", "component_id")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` for every group, with all its columns: that of the smallest doc_id
    (ties: smallest text hash; null ids last); of rows equal in both, any one."""
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("one")
    chosen = near_duplicates(docs, **options).groupBy("root").agg(one).select(
        F.col("one.doc_id").alias("_id"), F.col("one.text_hash").alias("_hash")).distinct()
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("_doc"),
                      F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"))
    kept = row.join(chosen, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left_semi")
    return kept.dropDuplicates(["_doc", "_text"]).select("row.*")
