"""Helpers that the operators of this subpackage share: connected components, union-find; tables and word hashing from `loomspan.tables`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.tables import Scratch, mix64, shared_folder, small_batches

__all__ = ["Forest", "Scratch", "components", "mix64", "shared_folder", "small_batches", "spread", "stored_bytes"]


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt anew if they come in fewer splits than tasks run at once, as one small file does; else as they are."""
    least = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(least) if rows.rdd.getNumPartitions() < least else rows


def stored_bytes(table: DataFrame) -> int:
    """Bytes of the files that a table read back by `Scratch.keep` has, from the file listing."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges (a > b) with the parts that one task's edges join as stars around their smallest ids: no part is lost, chains get short."""

    def contract(batches):
        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (above := up.get(top, top)) != top:
                top = above
            while x != top:
                up[x], x = top, up.get(x, x)
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        nodes = list(up)
        for at in range(0, len(nodes), 100_000):
            some = nodes[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(contract, "a long, b long")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of `edges(a, b)`: one row (id, component_id) per end, component_id its smallest id.

    The edges are written first, so that their contraction needs no second Python worker beside the one that finds them.
    Each task contracts its own edges. Then large-star and small-star rounds alternate until stars are left, each of
    partial aggregations and joins, written to the shared folder. Self-loops and nulls are dropped; nodes without edges
    don't appear.
    """
    found = scratch.keep(edges.where("a <> b").select("a", "b"), "found_edges")
    now = scratch.keep(_contracted(found).distinct(), "edges")
    scratch.drop("found_edges")
    name, rounds = "edges", 0
    while True:
        # A star forest: every node is the outer end of one edge, or an inner end only.
        ends = now.select(F.col("a").alias("x"), F.lit(1).alias("outer"), F.lit(0).alias("inner")).unionByName(now.select(F.col("b").alias("x"), F.lit(0).alias("outer"), F.lit(1).alias("inner")))
        unfinished = ends.groupBy("x").agg(F.sum("outer").alias("outer"), F.max("inner").alias("inner")).where("outer + inner > 1").limit(1).count()
        if not unfinished:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
        rounds += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.keep(large, f"large{rounds}")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lowest.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        small = scratch.keep(lowest.select("a", F.col("m").alias("b")).unionByName(moved).distinct(), f"small{rounds}")
        scratch.drop(name, f"large{rounds}")
        now, name = small, f"small{rounds}"


class Forest:
    """Union-find over 0..n-1; the smaller root wins."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def roots(self) -> np.ndarray:
        up = self.up
        while not np.array_equal(up, up[up]):
            up = up[up]
        self.up = up
        return up
