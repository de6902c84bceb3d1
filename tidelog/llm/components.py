"""Connected components of a links table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import BROADCAST_BYTES, stash

MOST_ROUNDS = 60
#: Neighbours from which a node's edges are joined by a broadcast, and bytes of a row in it.
HEAVY, ROW_BYTES = 1_000, 32


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id of ``links`` (a, b).

    Rounds of group-by-minimum and equi-joins; each round is written to the shared
    folder. Nodes of very many neighbours are joined apart, so no task gets such a node's
    edges. Ends when a round changes nothing: then every id points at its smallest.
    """
    edges = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = _mark(edges)
    for _ in range(MOST_ROUNDS):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        # large star: every larger neighbour points at the smallest of the neighbourhood
        large = _joined(both, low).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stash(large, "large")
        # small star: every smaller neighbour, and the id itself, points at the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _joined(large, least).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stash(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def _joined(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Edges with ``m`` of their ``a``. low: a, m, n; nodes of large n (the largest that fit) are broadcast."""
    least = HEAVY
    while (some := low.where(F.col("n") >= least).count()) * ROW_BYTES > BROADCAST_BYTES:
        least *= 8
    if not some:
        return edges.join(low.select("a", "m"), "a")
    heavy = F.broadcast(low.where(F.col("n") >= least).select("a", "m"))
    light = edges.join(heavy.select("a"), "a", "left_anti").join(low.where(F.col("n") < least).select("a", "m"), "a")
    return light.unionByName(edges.join(heavy, "a"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(xxhash64(a, b, 1) as decimal(20, 0)))")).first())
