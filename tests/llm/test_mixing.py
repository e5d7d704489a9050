import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from sql_compare import assert_same, connect

from loomspan.llm import mixing


def test_same_as_sql(spark, sf_dir):
    assert_same(mixing.op3_mixing(spark, sf_dir), connect(sf_dir), mixing.OP3_SQL)


def sizes(spark, table):
    return {r.source: r for r in mixing.source_targets(spark.createDataFrame([(s, n) for s, n in table], "source string, size long")).collect()}


def test_targets(spark):
    got = sizes(spark, [("a", 100), ("b", 100), ("c", 100)])
    assert [got[k].target for k in "abc"] == pytest.approx([50, 100, 150])
    got = sizes(spark, [("a", 1000), ("b", 10), ("c", 90), (None, 0)])
    # b stops at 30, c at 270, null at 0; a takes the rest.
    assert [got[k].target for k in ("a", "b", "c", None)] == pytest.approx([800, 30, 270, 0])
    assert sizes(spark, [("a", 0)])["a"].target == 0
    assert sizes(spark, []) == {}


def test_hypergeometric_distribution(spark):
    n = 20_000
    draws = spark.range(n).select(mixing.hypergeometric(F.lit(20), F.lit(8), F.lit(9), (F.col("id") + 0.5) / n).alias("k"))
    got = Counter(r.k for r in draws.collect())
    for k in range(9):
        want = math.comb(8, k) * math.comb(12, 9 - k) / math.comb(20, 9)
        assert got.get(k, 0) / n == pytest.approx(want, abs=2 / n)
    edge = spark.range(1).select(*(mixing.hypergeometric(F.lit(t), F.lit(g), F.lit(d), F.lit(0.7)).alias(f"c{i}") for i, (t, g, d) in enumerate([(0, 0, 0), (5, 5, 3), (5, 0, 3), (7, 4, 7), (10**9, 5 * 10**8, 10**6)]))).first()
    assert list(edge)[:4] == [0, 3, 0, 4] and abs(edge.c4 - 500_000) < 5_000


def test_draws(spark, make_docs, texts):
    docs = make_docs(texts(1, 300)).withColumns({"source": F.when(F.col("doc_id") % 10 > 2, "hot").when(F.col("doc_id") % 10 == 0, F.lit(None).cast("string")).otherwise(F.col("source")), "block": F.lit("clash"), "size": F.lit("clash")})
    docs = docs.unionByName(docs.where("doc_id < 20"))
    draws, documents = mixing.mix(docs, block_docs=8, shards=4)
    d, w = documents.toPandas(), draws.toPandas()
    assert len(d) == docs.count()
    assert (d.taken <= 3 * d["size"]).all()
    for target, found in d.groupby("target"):
        each = found.groupby("source", dropna=False).taken.sum()
        assert (abs(each - math.floor(target)) <= 1e-9).all()
    assert w.words.sum() == d.taken.sum()
    assert w.groupby(["doc_id", "copy_no"]).words.sum().to_dict() == {k: v for k, v in d.set_index(["doc_id", "copy_no"]).taken.to_dict().items() if v}
    assert not w.duplicated(["doc_id", "copy_no", "round"]).any()
    assert set(w["shard"]) == {0, 1, 2, 3}
    again = mixing.mix(docs, block_docs=8, shards=4)[0].toPandas()
    key = ["doc_id", "copy_no", "round"]
    assert again.sort_values(key).reset_index(drop=True).equals(w.sort_values(key).reset_index(drop=True))
    assert mixing.mix(docs.limit(0))[0].count() == 0


def test_quotas_add_up(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 37), (3, 5)], "place long, quota long")
    got = {r.place: r.shares for r in mixing.split_quotas(quotas, 8, 3, 4).collect()}
    assert {p: sum(x) for p, x in got.items()} == {0: 1000, 1: 37, 3: 5}
    per_shard = [sum(x) for x in zip(*got.values(), strict=True)]
    assert len(per_shard) == 8 and max(per_shard) - min(per_shard) <= 1
    assert [r.shares for r in mixing.split_quotas(quotas.where("place = 1"), 1, 3, 4).collect()] == [[37]]


def test_quotas_of_many_sources(spark):
    """Three levels of groups of 4: sources' and shards' sums are exact, and no share is negative."""
    quotas = spark.createDataFrame([(p, (p * 37) % 50) for p in range(50)], "place long, quota long")
    got = {r.place: r.shares for r in mixing.split_quotas(quotas, 4, 9, 50, fanout=4).collect()}
    assert {p: sum(x) for p, x in got.items()} == {p: (p * 37) % 50 for p in range(50)}
    per_shard = [sum(x) for x in zip(*got.values(), strict=True)]
    assert max(per_shard) - min(per_shard) <= 1 and min(map(min, got.values())) >= 0


def test_shares_are_hypergeometric(spark):
    """Of 10 places in two shards of 5, how many of a group's 6 stand in the first: as drawn without replacement."""
    n = 3000
    left = F.array(*(F.lit(x).cast("long") for x in (10, 5, 5)))
    found = Counter(r.k for r in spark.range(n).select(F.get(mixing._share(left, F.lit(6).cast("long"), 2, F.col("id")), F.lit(1)).alias("k")).collect())
    want = {k: math.comb(6, k) * math.comb(4, 5 - k) / math.comb(10, 5) for k in range(1, 6)}
    assert set(found) <= set(want) and all(abs(found[k] / n - w) < 0.04 for k, w in want.items())


def test_shards_hold_what_the_tree_gives(spark, make_docs, texts):
    """Every block draw goes to one shard: the distinct (block, round) of a shard are its quotas, and shards are of equal size."""
    docs = make_docs(texts(2, 400)).withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").otherwise(F.col("source")))
    draws, documents = mixing.mix(docs, block_docs=4, shards=8)
    rows = draws.join(documents.select("doc_id", "copy_no", "source"), ["doc_id", "copy_no"]).toPandas()
    assert set(rows["shard"]) == set(range(8))
    assert not rows.duplicated(["doc_id", "copy_no", "round"]).any()
    # Documents of one block are drawn together: a block's draw is in one shard.
    by_round = rows.groupby(["doc_id", "round"])["shard"].nunique()
    assert (by_round == 1).all()
    per_shard = rows.groupby("shard").size()
    assert per_shard.max() < 2.5 * per_shard.min()


def test_sums_before(spark):
    rows = spark.createDataFrame([(p, b, (b * 7 + p) % 5) for p in range(2) for b in range(40)], "place long, block long, words long").withColumn("range", F.floor(F.col("block") / 8))
    got = {(r.place, r.block): r.found for r in mixing._before(rows, ["place"], "range", ["block"], F.col("words"), "found").collect()}
    assert got == {(p, b): sum((k * 7 + p) % 5 for k in range(b)) for p in range(2) for b in range(40)}


def test_sql_with_nulls(spark, make_docs, tmp_path):
    docs = make_docs(["a b", None, "", "c", "d e f"]).withColumn("source", F.when(F.col("doc_id") < 3, F.lit(None).cast("string")).otherwise(F.col("source")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert_same(mixing.op3_mixing(spark, str(tmp_path)), con, mixing.OP3_SQL)
