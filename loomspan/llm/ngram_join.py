"""N-gram Jaccard self-join of documents by signature trees.

Documents of equal shingle sets form a class, of which one goes on. MinHash keys route the classes: those that share a
key meet in a signature tree over their bitmaps and size ranges, whose dual traversal leaves what the bitmaps can't rule
out; what that holds together is a family. The families' texts then meet once, and a second tree over exact sets links
them. At a Jaccard similarity of 0.85, 24 keys of 3 values miss a pair with a chance of 1.2e-10; everything else is exact.

Defined results: without words, null or empty: no shingles, linked with nothing, a component of its own; fewer words than
a shingle has: the whole sequence is the one shingle; rows that share an id, or have none, are documents of their own, each
returned with the component of its text; ties need no rule, components take the smallest id, null if none of their rows has
one; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import sigtree
from loomspan.llm._families import _edges, family_links, groups
from loomspan.llm._shared import Scratch, components, mix64, spread

WORDS = 4
NUM, DEN = 85, 100
BANDS, ROWS = 24, 3
_ODD = np.random.default_rng(20240607).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None, lower: bool) -> np.ndarray:
    """A 64-bit hash of each run of other characters than ASCII white space; with `lower`, of A-Z lower-cased."""
    raw = (text or "").encode("utf-8", "replace")
    words = (raw.lower() if lower else raw).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams."""
    w = word_hashes(text, True)
    if len(w) < words:
        return mix64(np.array([xxhash.xxh3_64_intdigest(w.tobytes())], np.uint64)) if len(w) else w
    n = len(w) - words + 1
    h = w[:n]
    for k in range(1, words):
        h = mix64(h * _STEP + w[k : n + k])
    return np.unique(h)


def band_keys(tokens: np.ndarray) -> np.ndarray:
    """One key for each band: a hash of the least values of its multiplicative permutations."""
    least = np.empty(len(_ODD), np.uint64)
    for k, odd in enumerate(_ODD):
        least[k] = (tokens * odd).min()
    least = mix64(least.reshape(BANDS, ROWS))
    key = np.arange(BANDS, dtype=np.uint64) * _STEP
    for r in range(ROWS):
        key = mix64(key * _STEP + least[:, r])
    return key.astype(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(id, copy, n_shingles, h1, h2, keys, bitmap) of `docs(id, copy, text)`; two independent hashes stand for the set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[list] = [[], [], [], [], []]
                for text in part.column(2).to_pylist():
                    s = shingles(text, words)
                    raw = s.tobytes()
                    two = xxhash.xxh3_128_intdigest(raw)
                    keys = band_keys(s) if len(s) else None
                    for column, value in zip(rows, (len(s), (two >> 65), two & (2**63 - 1), keys, sigtree.bitmap(s, sigtree.bits_for(len(s))).tobytes() if len(s) else None), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in rows[:3]), pa.array(rows[3], pa.list_(pa.int64())), pa.array(rows[4], pa.binary())], names=["id", "copy", "n_shingles", "h1", "h2", "keys", "bitmap"])

    return docs.select("id", "copy", "text").mapInArrow(sign, "id long, copy long, n_shingles long, h1 long, h2 long, keys array<long>, bitmap binary")


def candidate_families(scratch: Scratch, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(id, family) of the classes (id, n_shingles, keys, bitmap) that the trees leave together."""
    keyed = classes.select("id", F.explode("keys").alias("key"))
    often = scratch.keep(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared_keys")
    routed = scratch.keep(keyed.join(often, "key"), "routed")
    rows = routed.join(classes.select(F.col("id").alias("i"), "n_shingles", "bitmap"), F.col("id") == F.col("i")).select("key", "id", "n_shingles", "bitmap")

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: set[tuple[int, int]] = set()
        for table in groups(batches, "key"):
            ids, sizes = table["id"].to_numpy(), table["n_shingles"].to_numpy()
            maps = sigtree.common_width([np.frombuffer(b, np.uint64) for b in table["bitmap"].to_pylist()], sizes)
            pairs |= {(int(ids[i]), int(ids[j])) for i, j in sigtree.links(sizes, maps, num, den)}
            if len(pairs) > 100_000:
                yield _edges(list(pairs))
                pairs = set()
        if pairs:
            yield _edges(list(pairs))

    edges = rows.repartition("key").sortWithinPartitions("key").mapInArrow(traverse, "a long, b long")
    return components(scratch, edges).withColumnRenamed("component_id", "family")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of `docs`."""
    scratch = Scratch(docs.sparkSession, "ngrams")
    # A text's hash tells rows of one id apart; a class of equal sets goes by the least row number, as ids can repeat.
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    signed = scratch.keep(signatures(texts, words).withColumn("row", F.monotonically_increasing_id()), "signed")
    by_set = signed.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("row").alias("rep"), F.min("id").alias("low"))
    by_set = scratch.keep(by_set, "classes")
    first = signed.join(by_set.select("rep"), F.col("row") == F.col("rep"), "left_semi")
    families = candidate_families(scratch, scratch.keep(first.select(F.col("row").alias("id"), "n_shingles", "keys", "bitmap"), "representatives"), num, den)
    families = scratch.keep(families, "families")
    scratch.drop("representatives", "shared_keys", "routed")
    wanted = signed.select(F.col("id").alias("i"), F.col("copy").alias("c"), "row").join(families.withColumnRenamed("id", "r"), F.col("row") == F.col("r")).select("i", "c", "row", "family")
    members = texts.join(wanted, F.col("id").eqNullSafe(F.col("i")) & (F.col("copy") == F.col("c"))).dropDuplicates(["row"]).select(F.col("row").alias("id"), "family", "text")
    links = family_links(scratch, scratch.keep(members, "members"), lambda t: shingles(t, words), num, den)
    linked = scratch.keep(components(scratch, links).join(by_set.select("rep", "low"), F.col("id") == F.col("rep")).select("rep", "low", F.col("component_id").alias("part")), "linked")
    least = linked.groupBy(F.col("part").alias("p")).agg(F.min("low").alias("least"))
    moved = scratch.keep(linked.join(least, F.col("part") == F.col("p")).select(F.col("rep").alias("i"), "least"), "moved")
    named = by_set.join(moved, F.col("rep") == F.col("i"), "left").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("n_shingles").alias("m"), F.coalesce("least", "low").alias("component_id"))
    named = scratch.keep(named, "named")
    scratch.drop_but("signed", "named")
    out = signed.select("id", "n_shingles", "h1", "h2").join(named, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("n_shingles") == F.col("m")), "left")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS grams
  FROM w),
s AS (SELECT min(doc_id) AS rep, grams, len(grams) AS n FROM (SELECT doc_id, list_sort(grams) AS grams FROM g) GROUP BY grams),
t AS (SELECT rep, n, unnest(grams) AS gram FROM s),
p AS (
  SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.gram = b.gram AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p UNION ALL SELECT rep, rep FROM s WHERE n > 0)
, c AS (SELECT 1)
SELECT d.doc_id, CAST(s.n AS BIGINT) AS n_shingles, CASE WHEN s.n = 0 THEN d.doc_id ELSE r.component_id END AS component_id
FROM (SELECT doc_id, list_sort(grams) AS grams FROM g) d JOIN s ON d.grams = s.grams
LEFT JOIN (
  WITH RECURSIVE reach(rep, low) USING KEY (rep) AS (
    SELECT rep, rep FROM s WHERE n > 0
    UNION
    SELECT e.a, min(r.low) FROM reach r JOIN e ON e.b = r.rep JOIN recurring.reach old ON old.rep = e.a WHERE r.low < old.low GROUP BY e.a)
  SELECT rep, low AS component_id FROM reach) r ON r.rep = s.rep
"""
