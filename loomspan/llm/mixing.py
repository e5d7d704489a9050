"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

A source's documents stand in a seeded random order, cut into blocks of a narrow range of that order. The mix takes
whole passes over a source's blocks, then as many more blocks in that order as its target still wants, the last one
(and its last document) in part: exact quotas of block draws. The tree splits the quotas of all sources among the output
shards, whose sizes halve down a binary tree: a group of sources gets, at each node, one hypergeometric draw of the node's
places for the left child, out of what the groups before it left; a group is split again among its sources in the same way,
`FANOUT` at a time, so that no row holds more than `FANOUT` sources. A source's block draws, in a second random order, then
go to the shards by its quotas: shards hold disjoint draws, and each shard orders what it has anew. What a document is
taken for is the sum of its dealt draws.

Orders inside a source are found in two steps, over ranges and inside a range, so that no task orders more than about the
square root of a source's blocks.

Defined results: a null, empty or blank text has 0 words and is taken 0 times; a null source is a source of its own,
last in order; repeated rows (same id, source and text) are separate documents of equal place, told apart by a row
number; an empty table gives an empty mix; columns other than the named ones are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm._shared import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources by code point, repeated.
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Documents that a block holds on average.
BLOCK_DOCS = 512
#: Output shards, rounded up to a power of two.
SHARDS = 16
#: Sources, or groups of them, that one row of the tree splits.
FANOUT = 64


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: source, source_size, docs, target. `sizes` holds (source, size), one row per document.

    The weighted share of all words, capped at `max_repeats` times the source's size with the excess shared anew by
    weight. In the order of cap per weight, a source is capped exactly if its cap is below what an even share of the
    rest would give it, so running sums settle it at once. The windows without a key run over one row per source.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    each = each.withColumn("place", F.row_number().over(by_name) - 1)
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    each = each.withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, here_on = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    each = (
        each.withColumn("budget", F.sum("source_size").over(everything).cast("double"))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(here_on))
        .withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("even", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(everything)["level"])
    )
    return each.select("source", "place", "source_size", "docs", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("even") * F.col("weight")).alias("target"))


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(2**53)


def _ln_factorial(n: Column) -> Column:
    """Stirling's series after a shift by 8; n a double of 0 or more."""
    x = n + 9.0
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12.0 * x) - 1 / (360.0 * x * x * x) + 1 / (1260.0 * x * x * x * x * x)
    shift = n + 1.0
    for k in range(2, 9):
        shift = shift * (n + float(k))
    return series - F.ln(shift)


def _ln_choose(n: Column, k: Column) -> Column:
    return _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)


def hypergeometric(total: Column, good: Column, draws: Column, unit: Column) -> Column:
    """The number of good ones among `draws` of `total` without replacement, by inverting its distribution at `unit`.

    The sum runs over all values within 10 standard deviations and 25 of the mean (chance beyond: below 1e-16, the unit's step).
    """
    t, g, d = (c.cast("double") for c in (total, good, draws))
    safe = F.greatest(t, F.lit(1.0))
    mean = d * g / safe
    wide = 10.0 * F.sqrt(F.greatest(mean * (1 - g / safe) * (t - d) / F.greatest(t - 1.0, F.lit(1.0)), F.lit(0.0))) + 25.0
    low = F.greatest(F.lit(0.0), d + g - t, F.floor(mean - wide)).cast("long")
    high = F.least(g, d, F.ceil(mean + wide)).cast("long")
    base = _ln_choose(t, d)

    def chance(k: Column) -> Column:
        k = k.cast("double")
        return F.exp(_ln_choose(g, k) + _ln_choose(t - g, d - k) - base)

    start = F.struct(F.lit(0.0).alias("sum"), low.alias("k"))
    step = lambda s, k: F.struct((s["sum"] + chance(k)).alias("sum"), F.when(s["sum"] + chance(k) <= unit, F.least(k + 1, high)).otherwise(s["k"]).alias("k"))
    settled = F.when(low >= high, low)  # one value is possible only
    return F.coalesce(settled, F.aggregate(F.sequence(low, F.greatest(low, high)), start, step, lambda s: s["k"]))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _halved(total: Column, leaves: int) -> Column:
    """Sizes of the nodes of a binary tree of equal halves, the root first, node k's children at 2k + 1 and 2k + 2."""
    both = lambda n: F.array(F.shiftright(n + 1, 1), F.shiftright(n, 1))
    return F.aggregate(F.sequence(F.lit(0), F.lit(max(leaves - 2, 0))), F.array(total), lambda a, k: F.when(F.lit(leaves > 1), F.concat(a, both(F.get(a, k)))).otherwise(a))


def _share(left: Column, quota: Column, leaves: int, *unit: Column) -> Column:
    """How many of the places `left` (sizes of the tree's nodes) go to a group with a quota: the same for the group, by a hypergeometric draw at each node."""

    def split(got: Column, k: Column) -> Column:
        first = hypergeometric(F.get(left, k), F.get(got, k), F.get(left, 2 * k + 1), _unit(*unit, k))
        return _let(first, lambda n: F.concat(got, F.array(n, F.get(got, k) - n)))

    if leaves == 1:
        return F.array(quota)
    return F.aggregate(F.sequence(F.lit(0), F.lit(leaves - 2)), F.array(quota), split)


def _take(leaves: int, seed: int, level: int):
    """The step of an aggregate over groups: a group gets its share of what is left."""

    def take(state: Column, group: Column) -> Column:
        got = _share(state["left"], group["q"], leaves, F.lit(seed), F.lit(level), group["child"])
        return _let(got, lambda g: F.struct(F.zip_with(state["left"], g, lambda a, b: a - b).alias("left"), F.concat(state["out"], F.array(F.struct(group["child"].alias("child"), g.alias("sizes")))).alias("out")))

    return take


def split_quotas(quotas: DataFrame, shards: int, seed: int, sources: int, fanout: int = FANOUT) -> DataFrame:
    """`quotas(place, quota)` of places 0 to `sources` - 1 split among 2^k >= `shards` shards of equal size: rows (place, shares), one share a shard.

    Down a tree of groups of `fanout` places; a row splits the sizes of its shards' tree among its groups, one after the
    other, by what is left.
    """
    leaves = 1 << max(0, math.ceil(math.log2(max(1, shards))))
    levels = 1
    while fanout**levels < sources:
        levels += 1
    nodes = quotas.groupBy().agg(F.coalesce(F.sum("quota"), F.lit(0)).cast("long").alias("total")).select(F.lit(0).cast("long").alias("node"), _halved(F.col("total"), leaves).alias("left"))
    for level in reversed(range(levels)):
        child = F.floor(F.col("place") / F.lit(fanout**level)).cast("long")
        groups = quotas.groupBy(child.alias("child")).agg(F.sum("quota").cast("long").alias("q"))
        groups = groups.groupBy(F.floor(F.col("child") / F.lit(fanout)).cast("long").alias("up")).agg(F.array_sort(F.collect_list(F.struct("child", "q"))).alias("groups"))
        none = F.array().cast("array<struct<child:bigint,sizes:array<bigint>>>")
        split = F.aggregate("groups", F.struct("left", none.alias("out")), _take(leaves, seed, level), lambda s: s["out"])
        nodes = nodes.join(groups, F.col("node") == F.col("up")).select(F.explode(split).alias("g")).select(F.col("g.child").alias("node"), F.col("g.sizes").alias("left"))
    return nodes.select(F.col("node").alias("place"), F.slice("left", leaves, leaves).alias("shares"))


def _before(rows: DataFrame, keys: list[str], coarse: str, order: list, value: Column, name: str) -> DataFrame:
    """rows with the sum of `value` over the rows of equal keys that stand before, in the order of `coarse`, then `order`.

    Sums by `coarse` come first, so each window holds one range's rows, or one row a range.
    """
    sums = rows.groupBy(*keys, coarse).agg(F.sum(value).alias("sum"))
    ranges = Window.partitionBy(*keys).orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(k).alias(f"{k}_r") for k in [*keys, coarse]), F.coalesce(F.sum("sum").over(ranges), F.lit(0)).cast("long").alias("base"))
    inside = Window.partitionBy(*keys, coarse).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    each = rows.withColumn("near", F.coalesce(F.sum(value).over(inside), F.lit(0)).cast("long"))
    on = [F.col(k) == F.col(f"{k}_r") for k in [*keys, coarse]]
    return each.join(sums, on).withColumn(name, F.col("base") + F.col("near")).drop("near", "base", *(f"{k}_r" for k in [*keys, coarse]))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_repeats: int = MAX_REPEATS, block_docs: int = BLOCK_DOCS, shards: int = SHARDS, seed: int = 17, row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(draws, documents).

    documents: doc_id, copy_no (tells equal rows apart), source, size, source_size, target, taken.
    draws: doc_id, copy_no, round, words (the first so many of the document), shard, position (order inside the shard),
    and, with a `row_col` that tells all rows apart, row.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *([F.col(row_col).alias("row")] if row_col else []))
    row = ["row"] if row_col else []
    # 60 bits of MD5 as the random order: the same in any SQL engine. Equal rows are counted, not told apart, here.
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")
    sized = scratch.keep(rows.withColumn("random", order), "sized")
    # Blocks: 2^depth equal ranges of the 60-bit order, by the number of documents of the source.
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("docs"), F.lit(1)) / F.lit(float(block_docs))))).cast("int")
    goals = source_targets(sized, weights, max_repeats).withColumn("depth", depth).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")).withColumn("rest", (F.floor("target") - F.col("passes") * F.col("source_size")).cast("long"))
    goals = scratch.keep(goals.select(F.col("source").alias("s"), F.col("place").cast("long").alias("place"), "source_size", "target", "passes", "rest", "depth"), "goals")
    sources = goals.count()
    # Spark broadcasts the goals by their size as written, else joins by a shuffle whose hot sources it splits.
    placed = sized.join(goals, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.floor(F.col("random") / F.pow(F.lit(2.0), 60 - F.col("depth"))).cast("long")).drop("s")
    blocks = placed.groupBy("place", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"), F.first("depth").alias("depth"))
    blocks = blocks.where("words > 0").withColumn("half", F.shiftright(F.col("depth"), 1)).withColumn("range", F.floor(F.col("block") / F.pow(F.lit(2.0), F.col("half"))).cast("long"))
    blocks = _before(blocks, ["place"], "range", ["block"], F.col("words"), "from")
    blocks = scratch.keep(blocks.withColumn("extra", F.least(F.greatest(F.col("rest") - F.col("from"), F.lit(0)), F.col("words"))).withColumn("draws", (F.col("passes") + F.when(F.col("extra") > 0, 1).otherwise(0)).cast("int")).select("place", "block", "half", "extra", "draws"), "blocks")

    quotas = blocks.groupBy("place").agg(F.sum("draws").cast("long").alias("quota"))
    # Of each source: how many draws the shards up to each one take.
    upto = F.aggregate("shares", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)), lambda a: F.slice(a, 2, F.size(a) - 1))
    shares = scratch.keep(split_quotas(quotas, shards, seed, sources).select(F.col("place").alias("p"), upto.alias("upto")), "shares")
    # One row per draw of a block, ranked in a second random order of its source's draws.
    drawn = blocks.where("draws > 0").select("place", "block", "half", F.explode(F.sequence(F.lit(0), F.col("draws") - 1)).alias("round"))
    drawn = drawn.withColumn("at", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "place", "block", "round"), 1)).withColumn("range", F.floor(F.col("at") / F.pow(F.lit(2.0), 63 - F.col("half"))).cast("long"))
    ranked = _before(drawn, ["place"], "range", ["at", "block", "round"], F.lit(1), "rank")
    dealt = ranked.join(shares, F.col("place") == F.col("p")).select("place", "block", "round", F.size(F.filter("upto", lambda n: n <= F.col("rank"))).alias("shard"))
    plan = dealt.groupBy("place", "block").agg(F.array_sort(F.collect_list(F.struct("round", "shard"))).alias("dealt")).join(blocks.select("place", "block", "extra"), ["place", "block"]).select(F.col("place").alias("p"), F.col("block").alias("b"), "extra", "dealt")

    window = Window.partitionBy("place", "block").orderBy("random", "doc_id", "size", *row)
    ordered = placed.withColumn("end", F.sum("size").over(window.rowsBetween(Window.unboundedPreceding, 0))).withColumn("copy_no", F.row_number().over(window))
    whole = ordered.join(plan, (F.col("place") == F.col("p")) & (F.col("block") == F.col("b")), "left")
    part = F.least(F.greatest(F.coalesce("extra", F.lit(0)) - (F.col("end") - F.col("size")), F.lit(0)), F.col("size"))
    # Whole in the passes, in part in the draw after them.
    words = lambda d: F.when(d["round"] < F.col("passes"), F.col("size")).otherwise(F.col("part"))
    taken = F.transform(F.coalesce("dealt", F.array().cast("array<struct<round:int,shard:int>>")), lambda d: F.struct(d["round"].alias("round"), words(d).cast("long").alias("words"), d["shard"].alias("shard")))
    whole = whole.withColumn("part", part).withColumn("taken", F.filter(taken, lambda d: (d["words"] > 0) & (d["shard"] < (1 << max(0, math.ceil(math.log2(max(1, shards))))))))
    documents = whole.select("doc_id", "copy_no", "source", "size", "source_size", "target", F.aggregate("taken", F.lit(0).cast("long"), lambda n, d: n + d["words"]).alias("taken"))
    draws = whole.select("doc_id", "copy_no", *row, F.inline("taken"))
    draws = draws.withColumn("position", F.xxhash64(F.lit(seed + 1), "shard", "doc_id", "copy_no", "round"))
    return draws, documents


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    _, documents = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS random
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY (source IS NULL), source) - 1 AS place FROM d GROUP BY source),
w AS (
  SELECT *, CAST(place % 3 + 1 AS DOUBLE) AS weight, CAST(3 AS DOUBLE) * source_size AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM s),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
c AS (SELECT *, cap <= level * weight AS capped FROM l),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight * (
           SELECT level FROM c WHERE NOT capped ORDER BY cap / weight, place LIMIT 1) END AS target FROM c),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.passes, CAST(floor(g.target) AS BIGINT) - g.passes * g.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.random, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(passes * size + least(greatest(rest - before, 0), size) AS BIGINT) AS taken FROM r
"""
