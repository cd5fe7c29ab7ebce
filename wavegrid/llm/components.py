"""Connected components over a distributed list of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.scan import SMALL_BYTES, map_batches
from wavegrid.session import ensure_checkpoint_dir

#: Links that one worker folds into a local forest before it passes them on.
FOREST_LINKS = 500_000
#: A node with more than this part of all link ends is a hub; there are fewer hubs than this.
HUBS = 1_000
#: Bytes of a node and its smallest neighbour, sent to every executor.
NODE_BYTES = 64


class _Forest:
    """Trees of linked nodes; every root is the smallest node of its tree."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def rows(self) -> pa.RecordBatch:
        nodes = [x for x in self.parent if self.root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(self.root, nodes), pa.int64())], ["u", "v"])


def local_forests(batches):
    """Replace the links that one task sees by links to the smallest node of each local tree."""
    forest, seen = _Forest(), 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.link(a, b)
        seen += batch.num_rows
        if seen >= FOREST_LINKS:
            yield forest.rows()
            forest, seen = _Forest(), 0
    yield forest.rows()


def _with_least(rows: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """``rows`` (u, v) with the ``m`` of their u. Of at most HUBS * hub rows fewer than HUBS nodes have over ``hub``: those
    are broadcast, so that no task joins all links of a hub; all nodes are, where so few rows can't have many."""
    if HUBS * hub * NODE_BYTES <= SMALL_BYTES:
        return rows.join(F.broadcast(least.select("u", "m")), "u")
    hubs = F.broadcast(least.where(F.col("n") > hub).select("u", "m"))
    met = rows.join(hubs, "u", "left")
    return met.where(F.col("m").isNotNull()).union(met.where(F.col("m").isNull()).drop("m").join(least.where(F.col("n") <= hub).select("u", "m"), "u"))


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that has a link; component is the smallest node reachable.

    Alternating large-star and small-star rounds: every round is joins and minima over the
    links, so no component is ever gathered in one place, nor the links of one node. Rounds grow with the logarithm of
    the longest chain. Links with a null end and loops are ignored.
    """
    spark = links.sparkSession
    ensure_checkpoint_dir(spark)
    a, b = F.col(a).cast("long"), F.col(b).cast("long")
    start = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull())
    # shuffled first, so that no task runs the worker that makes links and this one at once, by both ends, so that
    # a hub's links spread, and sorted, so that a task that is run again folds the same links together
    dealt = start.repartition("u", "v").sortWithinPartitions("v", "u")
    edges = map_batches(dealt, local_forests, "u long, v long").distinct().checkpoint()
    before = None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
        before = state
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        hub = -(-2 * state[0] // HUBS)
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
        large = _with_least(both, least, hub).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        edges = _with_least(large, small, hub).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).distinct().checkpoint()


def unsigned(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64, copy=False).view(np.uint64)
