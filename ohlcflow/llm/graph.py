"""Connected components of an undirected graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohlcflow.session import scratch_table

MAX_ROUNDS = 100


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node of the component) for every node of ``edges`` (``u``, ``v``: long).

    Alternating large-star and small-star rounds: every node's neighbours are hung on
    its smallest neighbour until the edges form stars, which takes a number of rounds
    that grows with the logarithm of the size, not with the diameter.  Every half round
    is one aggregate (combined before its shuffle) and one join by node, whose hot nodes
    adaptive execution splits; each round is written to the shared folder, which cuts
    the lineage and survives lost executors.  Loops and repeated edges do no harm; null
    ends are ignored."""
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter(
        F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = scratch_table(e, "cc-edges")
    before = _state(e)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        # large star: the larger neighbours of a node go to its smallest neighbour (or itself)
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(
            F.col("u") != F.col("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        e = scratch_table(small, "cc-edges")
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
