"""Sampling for training data: caps, TF-IDF, clusters, windows, splits and shards. Choices are by seeded hashes, so reruns agree."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(key: Column, seed: int, n: int) -> Column:
    """A number below n from MD5 of key and seed; the same in any SQL engine."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("long"), F.lit(n))


def order_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key, F.lit(f"|{seed}")))


def capped(rows: DataFrame, group: str, key: Column, most: int = 1000, seed: int = 42) -> DataFrame:
    """At most so many rows of each group, by hash order."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(order_key(key, seed), key))).where(F.col("n") <= most).drop("n")


def one_per_cluster(rows: DataFrame, cluster: list[str], key: Column, seed: int = 42) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*cluster).orderBy(order_key(key, seed), key))).where("n = 1").drop("n")


def group_split(rows: DataFrame, group: Column, valid_and_test: float = 0.05, seed: int = 42) -> DataFrame:
    """rows with split: train, valid or test, the same for a whole group; the two small parts share the fraction."""
    share = bucket(group, seed, 10_000)
    edge = round(valid_and_test * 10_000)
    return rows.withColumn("split", F.when(share < edge // 2, "valid").when(share < edge, "test").otherwise("train"))


def repo_key(task_id: Column) -> Column:
    """The first two parts of a task id."""
    return F.substring_index(task_id, "/", 2)


def shards(rows: DataFrame, repo: str, size: int = 500) -> DataFrame:
    """rows with shard: repositories by name, so many a shard, from 1. The window runs over one row per repository."""
    named = rows.select(repo).distinct()
    named = named.withColumn("shard", F.ceil(F.row_number().over(Window.orderBy(repo)) / F.lit(size)).cast("int"))
    return rows.join(named, repo)


def tfidf(docs: DataFrame, min_df: int = 5) -> DataFrame:
    """(group, doc_id, term, weight): smoothed inverse document frequency ln((1 + n) / (1 + df)) + 1 in each group, rows of unit length. docs: group, doc_id, tokens.

    Terms are counted once for each document; after the join with the few frequent terms a document's are gathered once,
    and its length is that of the gathered array.
    """
    n = docs.groupBy("group").agg(F.count(F.lit(1)).cast("double").alias("n"))
    tf = docs.select("group", "doc_id", F.explode("tokens").alias("term")).groupBy("group", "doc_id", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    df = docs.select("group", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("group", "term").agg(F.count(F.lit(1)).cast("double").alias("df")).where(F.col("df") >= min_df)
    idf = df.join(n, "group").select("group", "term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, ["group", "term"]).groupBy("group", "doc_id").agg(F.collect_list(F.struct("term", (F.col("tf") * F.col("idf")).alias("raw"))).alias("terms"))
    length = F.sqrt(F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["raw"] * t["raw"]))
    return raw.withColumn("length", length).select("group", "doc_id", "length", F.inline("terms")).select("group", "doc_id", "term", (F.col("raw") / F.col("length")).alias("weight"))


def poisson_steps(mean: float) -> list[float]:
    """The Poisson distribution's sums up to 0, 1, ..., 39."""
    steps, total, p = [], 0.0, math.exp(-mean)
    for k in range(40):
        total += p
        steps.append(total)
        p *= mean / (k + 1)
    return steps


def poisson_windows(chunks: DataFrame, key: Column, mean: float = 3.0, seed: int = 42) -> DataFrame:
    """chunks (lines) with n_lines and offset: max(1, Poisson(mean)) lines, at most all, from a uniform start."""
    unit = lambda salt: bucket(F.concat(key, F.lit(f"/{salt}")), seed, 1_000_000).cast("double") / 1e6
    drawn = F.size(F.filter(F.array(*map(F.lit, poisson_steps(mean))), lambda c: c <= unit("n")))
    n = F.least(F.greatest(drawn, F.lit(1)), F.size("lines"))
    return chunks.withColumn("n_lines", n).withColumn("offset", F.floor(unit("at") * (F.size("lines") - F.col("n_lines") + 1)).cast("int"))


def kmeans(vectors: DataFrame, ratio: float = 0.1, seed: int = 42, rounds: int = 20) -> DataFrame:
    """(group, doc_id, cluster) by Lloyd's algorithm in each group, with max(1, ratio * n) clusters of k-means++ starts.

    vectors: group, doc_id, vector. A group (at most the sample cap of 1000 rows upstream) is clustered in one task.
    """

    def fit(table: pa.Table) -> pa.Table:
        x = np.array(table["vector"].to_pylist(), np.float64)
        k = max(1, int(ratio * len(x)))
        random = np.random.default_rng(seed)
        order = np.argsort(np.array(table["doc_id"].to_pylist(), dtype=object))
        x = x[order]
        centres = x[[random.integers(len(x))]]
        while len(centres) < k:
            far = ((x[:, None] - centres[None]) ** 2).sum(2).min(1)
            chance = far / far.sum() if far.sum() > 0 else np.full(len(x), 1 / len(x))
            centres = np.vstack([centres, x[random.choice(len(x), p=chance)]])
        for _ in range(rounds):
            near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            moved = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(k)])
            if np.allclose(moved, centres):
                break
            centres = moved
        return pa.table({"group": table["group"].take(order), "doc_id": table["doc_id"].take(order), "cluster": pa.array(near, pa.int32())})

    types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.select("group", "doc_id", "vector").groupBy("group").applyInArrow(fit, f"`group` {types['group']}, doc_id {types['doc_id']}, cluster int")
