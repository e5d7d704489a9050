"""Exact links inside families of candidates, and groups of sorted rows in a stream.

A family is a group of texts that candidate pairs hold together. Its sets meet in one task if they are few; a larger one
is cut into blocks. Blocks link inside; then one member of each component meets the others'; what is then outside its
family's largest component meets every block. So no link between components is lost, and copies of one text in a family
of any size aren't compared in pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import sigtree
from loomspan.llm._shared import Forest, Scratch

BLOCK = 2_048


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key from batches sorted by it; a group may span batches."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = table[key].to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and held[0][key][0].as_py() != keys[a]:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _links(rows: DataFrame, token_set: Callable[[str], np.ndarray], num: int, den: int) -> DataFrame:
    """Links (a, b) inside each `task` of rows (task, id, part, text); rows of a part count as linked already.

    Between parts that a chain of links joins, as many links as it takes; b is the smallest id of all of them.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "task"):
            if table.num_rows < 2:
                continue
            ids = table["id"].to_numpy()
            _, first, part = np.unique(table["part"].to_numpy(), return_index=True, return_inverse=True)
            forest = Forest(len(ids))
            forest.up = first[part]
            sets = [token_set(t) for t in table["text"].to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)

            def same(i: int, j: int) -> bool:
                shared = common(sets[i], sets[j])
                return (num + den) * shared >= num * (sizes[i] + sizes[j])

            if len(ids) == 2:
                found = same(0, 1) and forest.join(0, 1)
            else:
                bits = sigtree.bits_for(int(np.median(sizes)))
                found = sigtree.links(sizes, np.stack([sigtree.bitmap(s, bits) for s in sets]), num, den, same, forest)
            if found:
                roots = forest.roots()
                heads = np.unique(first)
                moved = heads[roots[heads] != heads]
                yield _edges([(int(ids[i]), int(ids[roots[i]])) for i in moved.tolist()])

    return rows.select("task", "id", "part", "text").repartition("task").sortWithinPartitions("task", "id").mapInArrow(link, "a long, b long")


def family_links(scratch: Scratch, members: DataFrame, token_set: Callable[[str], np.ndarray], num: int, den: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join every two members (id, family, text) of a family that a chain of links joins.

    `members` is read more than once: give a written table. Linked: shared tokens are num / den of the union or more.
    """
    counts = scratch.keep(members.groupBy("family").agg(F.count(F.lit(1)).alias("n")), "family_sizes")
    large = counts.where(F.col("n") > block).select("family", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    cut = scratch.keep(large, "large_families")
    task = lambda *c: F.xxhash64(*c)
    if not cut.limit(1).count():
        return _links(members.select(F.col("family").alias("task"), "id", F.col("id").alias("part"), "text"), token_set, num, den)
    small = members.join(counts.where(F.col("n") <= block).select("family"), "family", "left_semi")
    blocked = members.join(cut, "family").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    one = _links(small.select(F.col("family").alias("task"), "id", F.col("id").alias("part"), "text"), token_set, num, den)
    two = _links(blocked.select(task("family", "block").alias("task"), "id", F.col("id").alias("part"), "text"), token_set, num, den)
    found = scratch.keep(two, "block_links")

    # Inside a block a link's b is its component's smallest id, so one join names the components.
    named = blocked.join(found.select(F.col("a").alias("i"), F.col("b").alias("part")), F.col("id") == F.col("i"), "left").withColumn("part", F.coalesce("part", "id")).drop("i")
    named = scratch.keep(named, "named_blocks")
    leaders = named.where("id = part")
    per = leaders.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    spread = leaders.join(per, "family").withColumn("task", task("family", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block))))
    met = scratch.keep(_links(spread.select("task", "id", F.col("id").alias("part"), "text"), token_set, num, den), "leader_links")
    found = found.unionByName(met)
    marked = named.join(met.select(F.col("a").alias("i"), F.col("b").alias("to")), F.col("part") == F.col("i"), "left").withColumn("part", F.coalesce("to", "part")).drop("i", "to")
    marked = scratch.keep(marked, "labelled")
    parts = marked.groupBy("family", "part").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("family").agg(F.max(F.struct("n", (-F.col("part")).alias("p"))).alias("m")).select("family", (-F.col("m.p")).alias("main"))
    minor = scratch.keep(marked.join(main, "family").where("part <> main").drop("main"), "minor")
    sizes = minor.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks"))
    chunked = minor.join(sizes, "family").withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
    near = chunked.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    far = marked.join(sizes, "family").withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
    both = near.select("family", "block", "chunk", "id", "part", "text").unionByName(far.select("family", "block", "chunk", "id", "part", "text")).dropDuplicates(["family", "block", "chunk", "id"])
    three = _links(both.select(task("family", "block", "chunk").alias("task"), "id", "part", "text"), token_set, num, den)
    return one.unionByName(found).unionByName(three)
