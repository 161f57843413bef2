"""Centroid clustering in whole numbers, nearest centroids by the threshold algorithm.

Vectors with the right number of components, all finite, are kept, and each component x
becomes the integer ``floor(scale * x)``.  ``k`` kept vectors start as centroids; a round
assigns every vector to the nearest centroid (squared Euclidean distance, ties to the
smaller number) and replaces every centroid that has vectors by the floor of their mean.

Nearest centroid.  Per dimension the centroids are sorted by their component.  From a
vector's value two fingers walk outward in every list; a step takes the next nearest
centroid of each list and computes the exact distance of those not seen yet.  What is
unseen lies at least as far as the fingers in every dimension, so the search stops when
the sum of the squared frontier distances strictly exceeds the best exact distance (an
equal sum may hide a tie with a smaller number).

A round is one pass over the vectors: tasks emit ``k`` component sums, Spark adds them, and
only the ``k`` sums reach the driver.  Sums travel in limbs of 40 bits, so they are exact
for any number of vectors and any finite component; integers too large for 64-bit
distances are handled as Python integers.

Defined results: rows with equal or null ``vec_id`` are vectors of their own; ids that are
equal tie by their components when centroids are chosen, null ids come last; fewer than
``k`` kept vectors make that many centroids; no kept vector makes no row.  A distance or
sum beyond 64 bits is null.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohlcflow.llm.common import Workspace, small_batches

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256

#: Integers below this bound have squared distances of up to 2048 dimensions within 64 bits.
NARROW = 1 << 25
LIMB = 40
LARGEST = (1 << 63) - 1

ROWS = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def is_kept(embedding: Column, dimensions: int) -> Column:
    """Whether a vector has exactly ``dimensions`` components, none null or not finite."""
    wrong = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(embedding) == dimensions) & ~wrong


def as_integers(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of finite doubles: int64, or Python integers where those are too large."""
    if not x.size or float(np.abs(x).max()) * scale < NARROW:
        return np.floor(x * scale).astype(np.int64)
    exact = [math.floor(v * scale) if abs(v) < 2.0**52 else int(v) * scale for v in x.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(x.shape)


def vectors_of(batch: pa.RecordBatch, dimensions: int, scale: int) -> np.ndarray:
    values = batch.column("embedding").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return as_integers(values.reshape(-1, dimensions), scale)


class SortedLists:
    """Centroids (k rows of integers) with one list per dimension, sorted by component."""

    def __init__(self, centroids: list[list[int]]):
        wide = any(abs(x) >= NARROW for c in centroids for x in c)
        self.centroids = np.array(centroids, dtype=object if wide else np.int64)
        self.order = np.argsort(self.centroids, axis=0, kind="stable")
        self.value = np.take_along_axis(self.centroids, self.order, axis=0)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of every vector."""
        n, dims = vectors.shape
        k = len(self.centroids)
        wide = object in (vectors.dtype, self.centroids.dtype)
        kind = object if wide else np.int64
        vectors = vectors.astype(kind)
        columns = np.arange(dims)
        below = np.stack([np.searchsorted(self.value[:, d], vectors[:, d], side="right") for d in range(dims)],
                         axis=1) - 1
        above = below + 1
        beyond = (4 * max(int(np.abs(vectors).max(initial=0)), int(np.abs(self.centroids).max())) + 1 if wide
                  else np.iinfo(np.int64).max)
        none = beyond * beyond * dims if wide else beyond  # larger than any distance
        distance = np.full((n, k), none, dtype=kind)
        seen = np.zeros((n, k), dtype=bool)
        number, best = np.zeros(n, dtype=np.int64), np.full(n, none, dtype=kind)
        open_ = np.arange(n)
        while len(open_):
            lo, hi, v = below[open_], above[open_], vectors[open_]
            down = np.where(lo >= 0, v - self.value[np.maximum(lo, 0), columns], beyond)
            up = np.where(hi < k, self.value[np.minimum(hi, k - 1), columns] - v, beyond)
            lower = down <= up
            pick = np.where(lower, self.order[np.maximum(lo, 0), columns], self.order[np.minimum(hi, k - 1), columns])
            fresh = np.zeros((len(open_), k), dtype=bool)
            np.put_along_axis(fresh, pick, True, axis=1)
            row, centroid = np.nonzero(fresh & ~seen[open_])
            gap = vectors[open_[row]] - self.centroids[centroid]
            distance[open_[row], centroid] = (gap * gap).sum(axis=1)
            seen[open_] |= fresh
            number[open_] = distance[open_].argmin(axis=1)  # the first of equals
            best[open_] = distance[open_, number[open_]]
            frontier = np.where(lower, down, up)
            bound = (frontier * frontier).sum(axis=1)
            below[open_] -= lower
            above[open_] += ~lower
            open_ = open_[~((bound > best[open_]).astype(bool) | seen[open_].all(axis=1))]
        return number, best


def limbs_of(totals: list[int]) -> list[list[int]]:
    """Limbs of 40 bits, smallest first, whose weighted sums are the totals; the last carry the signs."""
    out = []
    while any(not -(1 << LIMB) <= t < (1 << LIMB) for t in totals):
        out.append([t & ((1 << LIMB) - 1) for t in totals])
        totals = [t >> LIMB for t in totals]
    return [*out, totals]


def cluster_sums(vectors: DataFrame, lists: SortedLists, dimensions: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and exact component sums of every centroid that is nearest to a vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            v = vectors_of(b, dimensions, scale)
            number, _ = shared.value.nearest(v)
            for c in np.unique(number).tolist():
                own = v[number == c]
                count[c] = count.get(c, 0) + len(own)
                total[c] = total.get(c, 0) + own.sum(axis=0).astype(object)
        rows = [(c, i, count[c] if i == 0 else 0, limb)
                for c in sorted(count) for i, limb in enumerate(limbs_of([int(x) for x in total[c]]))]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             names=["cluster", "limb", "n", "sums"])

    parts = vectors.mapInArrow(run, "cluster int, limb int, n long, sums array<long>")
    added = parts.groupBy("cluster", "limb").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(dimensions)])
    found: dict[int, tuple[int, list[int]]] = {}
    for r in added.collect():  # k rows a limb
        n, sums = found.get(r.cluster, (0, [0] * dimensions))
        found[r.cluster] = (n + r.n, [s + (r[f"s{d}"] << (LIMB * r.limb)) for d, s in enumerate(sums)])
    return found


def first_centroids(vectors: DataFrame, k: int, scale: int, seed: str) -> list[list[int]]:
    """The ``k`` vectors whose id after ``seed`` has the smallest SHA-256."""
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "embedding").select("embedding").limit(k).collect()
    return [as_integers(np.array(r.embedding, dtype=np.float64), scale).tolist() for r in rows]


def fit(vectors: DataFrame, k: int, rounds: int, dimensions: int, scale: int, seed: str) -> list[list[int]]:
    centroids = first_centroids(vectors, k, scale, seed)
    for _ in range(rounds if centroids else 0):
        for c, (n, sums) in cluster_sums(vectors, SortedLists(centroids), dimensions, scale).items():
            centroids[c] = [s // n for s in sums]
    return centroids


def cluster(table: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
            scale: int = SCALE, seed: str = "2:") -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of
    every kept vector of ``table`` (columns ``vec_id`` and ``embedding``)."""
    spark = table.sparkSession
    small_batches(spark)
    work = Workspace(spark, "centroid-cluster")
    vectors = work.table(table.filter(is_kept(F.col("embedding"), dimensions)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")),
        "vectors")
    centroids = fit(vectors, k, rounds, dimensions, scale, seed)
    if not centroids:
        return spark.createDataFrame([], ROWS)
    shared = spark.sparkContext.broadcast(SortedLists(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                number, distance = shared.value.nearest(vectors_of(b, dimensions, scale))
                far = [int(x) if x <= LARGEST else None for x in distance.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), pa.array(number, pa.int32()), pa.array(far, pa.int64())],
                    names=["vec_id", "cluster", "distance"])

    assigned = work.table(vectors.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    exact = F.col("distance").cast("decimal(38,0)")
    rows = assigned.groupBy("cluster").agg(
        F.when(F.count("*") == F.count("distance"), F.sum(exact)).alias("inertia")).collect()  # k rows
    sums = {r.cluster: None if r.inertia is None else int(r.inertia) for r in rows}
    fits = lambda x: x if x is not None and x <= LARGEST else None
    total = fits(None if None in sums.values() else sum(sums.values()))
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    clusters = spark.createDataFrame([(c, fits(s), total, digest(c)) for c, s in sorted(sums.items())],
                                     "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia",
                                                                  "inertia", "centroid_sha256")
