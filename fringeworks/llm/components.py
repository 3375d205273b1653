"""Connected components of an edge table: forests in parts of bounded size, then alternating large-star and small-star steps.

Edges are dealt evenly, so many to a part; a task joins those of its part into trees and sends an edge for each node that isn't a
root. One part is then done; of several, the trees are joined by star steps, few as the trees are shallow. Each step is two aggregations with map-side partial minima and a join that Spark can split where a node has very many
edges; edges never gather in one task. The table of a round is written to the shared folder. Rounds grow with the logarithm of
the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeworks.llm.common import written


#: Edges of a part.
PART = 250_000


def _trees(batches) -> Iterator:
    """(a, b): of the edges of a part, each node but the roots with its root, the smallest node."""
    import pyarrow as pa

    up: dict[int, int] = {}

    def root(k: int) -> int:
        top = k
        while (above := up.get(top, top)) != top:
            top = above
        while k != top:
            k, up[k] = up.get(k, top), top
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(k) for k in nodes], pa.int64())], names=["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that an edge (a, b) of longs touches; loops are ignored."""
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    known = written(edges.where("a != b").select("a", "b"), "edges")
    parts = max(1, -(-known.count() // PART))
    now = written(known.repartition(parts).mapInArrow(_trees, "a long, b long").where("a != b").distinct(), "edges")
    if parts == 1:
        return _listed(now)
    before = mark(now)
    while True:
        now = written(_small_star(_large_star(now)), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    return _listed(now)


def _listed(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
