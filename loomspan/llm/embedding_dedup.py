"""Embedding near-dedup by iterative quantisation.

Rotations learnt on a bounded sample turn unit vectors into balanced binary codes: the first ones give the code that
candidates are compared by, the others the code that is cut into disjoint parts. Each part is a Hamming table of a
multi-index: vectors whose parts are equal and whose compared codes, which no table has seen, differ in few bits are
candidates. A list with few candidate pairs gives them all, and each pair's original vectors are compared in double
precision. A list with many (over four a vector) gives a spanning part of them; what such lists hold together is a family,
whose original vectors meet and are compared block by block.

Fit (the documented bound): centring, principal axes and rotations from the `SAMPLE` vectors of least hash. Every vector is
indexed. Pairs at the threshold are made for the sample's vectors, in random directions and in directions of the data; there
are as many tables as bring all but 0.05 % of them together, for the worse of both kinds, and candidates may differ in as
many bits as all but 0.05 % of them do. A part's width is the one for which tables and the lists of a label cost least; at no
bits, a label is one list. The compared code is independent of the tables and has 2 to `MOST_WORDS` rotations: as many as let
a vector have less than `STRANGERS` unrelated candidates in all its lists, by the distances of the sample's own vectors.

A list above `LONG_LIST` rows isn't compared: all its vectors are candidates of its first, and exact comparison decides.

Equal vectors of a label form one class and are not compared with each other. Links are counted, not listed; a spanning
part of them goes on to the components.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and null labels, link with
nothing; vectors of other lengths are of other classes and never compared; rows of one vec_id count as one vector each;
an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm._families import groups
from loomspan.llm._shared import Forest, Scratch, components, mix64

THRESHOLD = 0.93
SAMPLE = 8_192
ITERATIONS = 40
#: Candidates may differ in this share of the code's bits where a sample gives no pairs to measure it by; at random it is 50 %.
MOST_BITS = 0.28
MISS = 0.001
BLOCK = 4_096
#: Rows of a table's list that a task holds.
LONG_LIST = 65_536
#: Rotations of the compared code, and unrelated candidates that a vector may have on the mean.
MOST_WORDS, STRANGERS = 8, 0.1
#: Rotations are fitted to so many of the sample's vectors, and there are at most so many.
FIT_ROWS, MOST_ROTATIONS = 2_048, 64


def fit_rotation(sample: np.ndarray, bits: int, iterations: int = ITERATIONS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): sign((x - mean) @ projection) is the code. Alternates codes and the orthogonal map that fits them best."""
    mean = sample.mean(0)
    centred = sample - mean
    _, _, axes = np.linalg.svd(centred.T @ centred)
    axes = axes[:bits].T
    projected = centred @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((axes.shape[1],) * 2))[0]
    for _ in range(iterations):
        u, _, v = np.linalg.svd(np.where(projected @ rotation >= 0, 1.0, -1.0).T @ projected)
        rotation = (u @ v).T
    return mean, axes @ rotation


def threshold_pairs(sample: np.ndarray, threshold: float, least: int = 4_096, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors and partners at the threshold: in random directions, and in directions of other vectors; at least so many of each kind."""
    random = np.random.default_rng(seed)
    out: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    for _ in range(max(1, math.ceil(least / len(sample)))):
        for kind, to in enumerate((random.standard_normal(sample.shape), sample[random.permutation(len(sample))] - sample)):
            to = to - (to * sample).sum(1, keepdims=True) * sample
            size = np.sqrt((to * to).sum(1, keepdims=True))
            some = size[:, 0] > 1e-6
            out[kind].append((sample[some], threshold * sample[some] + math.sqrt(max(0.0, 1 - threshold * threshold)) * to[some] / size[some]))
    found = [tuple(np.concatenate([pair[k] for pair in kind]) for k in (0, 1)) for kind in out]
    return [pair for pair in found if len(pair[0])]


#: A row of a table costs as much as comparing it with so many others.
ROW_COST = 512


@dataclass
class Index:
    """sign((x - mean) @ projection): the first `words` * `bits` are the compared code, `tables` lists the columns of each table's part."""

    mean: np.ndarray
    projection: np.ndarray
    bits: int
    words: int
    tables: list[np.ndarray]
    most: int

    def on(self, units: np.ndarray) -> np.ndarray:
        return (units - self.mean) @ self.projection >= 0

    def code(self, on: np.ndarray) -> np.ndarray:
        """A word for each rotation of the compared code."""
        out = np.zeros((len(on), self.words, 64), np.uint8)
        out[:, :, : self.bits] = on[:, : self.words * self.bits].reshape(len(on), self.words, self.bits)
        return np.packbits(out, axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def index_for(sample: np.ndarray, bits: int, vectors_per_label: float, threshold: float, miss: float = MISS / 2) -> Index:
    """The index for labels of a size, fitted to a sample of unit vectors."""
    mean, first = fit_rotation(sample, bits)
    rotations = [first]
    pairs = threshold_pairs(sample, threshold)
    differ: list[list[np.ndarray]] = [[] for _ in pairs]
    compared = MOST_WORDS

    def rotation(k: int) -> None:
        """Fits rotation k and notes in which bits the pairs' codes differ."""
        while len(rotations) <= k:
            rotations.append(fit_rotation(sample[:FIT_ROWS], bits, 12, 100 + len(rotations))[1])
        for found, (x, y) in zip(differ, pairs, strict=True):
            while len(found) <= k:
                n = len(found)
                found.append(((x - mean) @ rotations[n] >= 0) != ((y - mean) @ rotations[n] >= 0))

    def needed(width: int) -> int | None:
        """Tables of a width until few enough pairs miss all; None if the rotations don't give as many."""
        left = [np.ones(len(x), bool) for x, _ in pairs]
        count = 0
        for k in range(compared, MOST_ROTATIONS):
            rotation(k)
            for at in range(0, bits - width + 1, width):
                for n, found in enumerate(differ):
                    left[n] &= found[k][:, at : at + width].any(1)
                count += 1
                if all(x.mean() <= miss for x in left):
                    return count
        return None

    best = (ROW_COST + vectors_per_label, 0, 1)
    for width in range(3, min(bits, 32) + 1) if pairs else ():
        if ROW_COST + vectors_per_label / 2.0**width >= best[0]:
            continue
        tables = needed(width)
        if tables is None:
            break
        best = min(best, (tables * (ROW_COST + vectors_per_label / 2.0**width), width, tables))
        if tables * ROW_COST > best[0]:
            break  # wider parts need more tables still
    rotation(compared - 1)
    _, width, count = best
    met = count * vectors_per_label / 2.0**width
    random = np.random.default_rng(13)
    one, two = (sample[random.integers(0, len(sample), 20_000)] for _ in range(2))
    apart = np.stack([(((one - mean) @ r >= 0) != ((two - mean) @ r >= 0)).sum(1) for r in rotations[:compared]])
    for words in (2, 4, MOST_WORDS):
        # As many bits as the pairs need; for a sample without pairs a share of all.
        most = max((int(np.quantile(np.sum([f.sum(1) for f in found[:words]], axis=0), 1 - miss, method="higher")) for found in differ), default=int(MOST_BITS * words * bits))
        far = apart[:words].sum(0)
        below = 0.5 * math.erfc((far.mean() - most - 0.5) / max(1e-9, far.std()) / math.sqrt(2))
        if met * below < STRANGERS:
            break
    each = bits // width if width else 1
    tables = [np.arange(width) + bits * (words + t // each) + width * (t % each) for t in range(count)] if width else [np.empty(0, np.int64)]
    used = rotations[:words] + (rotations[compared : compared + -(-count // each)] if width else [])
    return Index(mean, np.concatenate(used, axis=1), bits, words, tables, most)


def _vector(values) -> np.ndarray | None:
    """The vector in double precision, None if it can't link."""
    if values is None or len(values) == 0 or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64) + 0.0
    return x if np.isfinite(x).all() and x.any() else None


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(-1, keepdims=True)
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


def _classes(vectors: DataFrame) -> DataFrame:
    """(id, label, h1, h2, x): x the usable vector in double precision, h1 and h2 hashes of it, null where it can't link."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_vector(v) if label is not None else None for v, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            hashes = [None if x is None else xxhash.xxh3_128_intdigest(x.tobytes()) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([None if h is None else h >> 65 for h in hashes], pa.int64()), pa.array([None if h is None else h & (2**63 - 1) for h in hashes], pa.int64()), pa.array(found, pa.list_(pa.float64()))], names=["id", "label", "h1", "h2", "x"])

    return vectors.mapInArrow(sign, "id long, label string, h1 long, h2 long, x array<double>")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = scratch.keep(_classes(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col), F.col(label_col).cast("string").alias("label"))), "rows")
    usable = rows.where("x IS NOT NULL AND id IS NOT NULL")
    by_value = scratch.keep(usable.groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    reps = usable.dropDuplicates(["id"]).join(by_value.select("rep", "n"), F.col("id") == F.col("rep"), "left_semi")
    reps = scratch.keep(reps.join(by_value.select(F.col("rep").alias("r"), "n"), F.col("id") == F.col("r")).select("id", "label", "n", "x"), "representatives")
    links, counts = _links(scratch, reps, threshold)
    linked = scratch.keep(components(scratch, links), "components").withColumnRenamed("id", "i")
    classes = by_value.join(counts, F.col("rep") == F.col("c"), "left").join(linked, F.col("rep") == F.col("i"), "left")
    classes = scratch.keep(classes.select(F.col("label").alias("l"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "named")
    out = rows.select("id", "label", "h1", "h2").join(classes, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("label") == F.col("l")), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _links(scratch: Scratch, reps: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(a, b) spanning links and (c, others) counts of linked vectors in other classes."""
    spark = reps.sparkSession
    sample = [r.x for r in reps.orderBy(F.xxhash64("id")).limit(SAMPLE).select("x").collect()]
    if not sample:
        none = spark.createDataFrame([], "a long, b long")
        return none, none.select(F.col("a").alias("c"), F.col("b").alias("others"))
    dim = max({len(x) for x in sample}, key=[len(x) for x in sample].count)
    bits = min(64, dim)
    units = _unit(np.array([x for x in sample if len(x) == dim]))
    # The size of the label that a vector has on the mean: large labels make the long lists.
    size = reps.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]
    fitted = index_for(units, bits, size, threshold)

    names = [f"code{k}" for k in range(fitted.words)]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                vectors = part.column(2).to_pylist()
                lengths = [len(x) for x in vectors]
                ids, labels = part.column(0).to_numpy(), np.array([xxhash.xxh3_64_intdigest(f"{n}:{v}") for n, v in zip(lengths, part.column(1).to_pylist(), strict=True)], np.uint64)
                # Vectors of another length than the sample's have no code: all of a label and length share one key.
                same = np.array([n == dim for n in lengths])
                on = np.zeros((len(ids), fitted.projection.shape[1]), bool)
                if same.any():
                    on[same] = fitted.on(_unit(np.array([x for x, s in zip(vectors, same, strict=True) if s])))
                code = fitted.code(on)
                keys = []
                for t, chosen in enumerate(fitted.tables):
                    weights = np.uint64(1) << np.arange(len(chosen), dtype=np.uint64)
                    picked = (on[:, chosen] * weights).sum(1, dtype=np.uint64)
                    keys.append(mix64(mix64(labels + np.uint64(t)) ^ picked))
                n = len(fitted.tables)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(ids, n)), *(pa.array(np.tile(code[:, c], n).view(np.int64)) for c in range(fitted.words))], names=["key", "id", *names])

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 2 + fitted.words), np.int64)
        dense = lambda a, b: _spanning(a, b, np.ones(len(a), bool))
        star = None  # key and first id of a list too long to hold
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy() for k in range(2 + fitted.words)], axis=1)
            if star and len(rows):
                more = int(np.searchsorted(rows[:, 0] != star[0], True))
                yield from dense(np.full(more, star[1]), rows[:more, 1])
                rows = rows[more:]
                star = star if not len(rows) else None
            rows = np.concatenate([held, rows])
            last = int(np.flatnonzero(rows[:, 0] == rows[-1, 0])[0]) if len(rows) else 0
            yield from _spanning(*candidates(rows[:last, 0], rows[:last, 1], np.ascontiguousarray(rows[:last, 2:]).view(np.uint64), fitted.most))
            held = rows[last:]
            if len(held) > LONG_LIST:
                star = (held[0, 0], held[0, 1])
                yield from dense(np.full(len(held) - 1, star[1]), held[1:, 1])
                held = held[:0]
        yield from _spanning(*candidates(held[:, 0], held[:, 1], np.ascontiguousarray(held[:, 2:]).view(np.uint64), fitted.most))

    keyed = reps.select("id", "label", "x").mapInArrow(index, "key long, id long, " + ", ".join(f"{n} long" for n in names)).repartition("key").sortWithinPartitions("key", "id")
    edges = scratch.keep(keyed.mapInArrow(traverse, "a long, b long, dense boolean").distinct(), "candidates")
    families = components(scratch, edges.where("dense").select("a", "b"))
    families = scratch.keep(families.withColumnRenamed("id", "i").withColumnRenamed("component_id", "family"), "families")
    # Pairs outside families are few: each meets its two vectors.
    of = lambda c: families.select(F.col("i").alias(f"i{c}"), F.col("family").alias(f"f{c}"))
    pairs = edges.where("NOT dense").select("a", "b").join(of("a"), F.col("a") == F.col("ia"), "left").join(of("b"), F.col("b") == F.col("ib"), "left").where("fa IS NULL OR fb IS NULL OR fa <> fb").select("a", "b")
    vector = lambda c: reps.select(F.col("id").alias(f"{c}id"), F.col("n").alias(f"{c}n"), F.col("x").alias(f"{c}x"))
    pairs = pairs.join(vector("a"), F.col("a") == F.col("aid")).join(vector("b"), F.col("b") == F.col("bid")).select("a", "b", "an", "bn", "ax", "bx")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                a, b, an, bn, ax, bx = (c.to_pylist() for c in batch.slice(at, 4096).columns)
                near = [len(x) == len(y) and float(_unit(np.array(x)) @ _unit(np.array(y))) >= threshold for x, y in zip(ax, bx, strict=True)] if len({len(x) for x in ax + bx}) > 1 else ((_unit(np.array(ax)) * _unit(np.array(bx))).sum(1) >= threshold).tolist()
                rows = [row for i, ok in enumerate(near) if ok for row in ((a[i], b[i], None), (a[i], None, bn[i]), (b[i], None, an[i]))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["a", "b", "others"])

    verified = pairs.mapInArrow(verify, "a long, b long, others long")
    sizes = families.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = reps.join(families, F.col("id") == F.col("i")).join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    other = F.explode(F.expr("sequence(0, blocks - 1)"))
    members = members.withColumn("other", other).withColumn("task", F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "task"):
            found = compare_blocks(table["id"].to_numpy(), table["label"].to_pylist(), table["block"].to_numpy(), table["n"].to_numpy(), table["x"].to_pylist(), threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["a", "b", "others"])

    rows = members.select("task", "id", "label", "block", "n", "x").repartition("task").sortWithinPartitions("task")
    found = scratch.keep(rows.mapInArrow(compare, "a long, b long, others long").unionByName(verified), "found")
    return found.where("b IS NOT NULL").select("a", "b"), found.where("others IS NOT NULL").groupBy(F.col("a").alias("c")).agg(F.sum("others").alias("others"))


def _spanning(a: np.ndarray, b: np.ndarray, dense: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(dense)], names=["a", "b", "dense"])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits codes of some words each differ."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def candidates(keys: np.ndarray, ids: np.ndarray, codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of each run of equal keys, and whether they only span the run's: short runs all at once, others one by one."""
    if len(keys) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    starts = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
    sizes = np.diff(np.append(starts, len(keys)))
    short = np.repeat(sizes <= 3, sizes)
    found_a, found_b, dense = [], [], []
    for lag in (1, 2):
        at = np.flatnonzero(short[:-lag] & (keys[lag:] == keys[:-lag]))
        at = at[_apart(codes[at], codes[at + lag]) <= most]
        found_a.append(ids[at])
        found_b.append(ids[at + lag])
        dense.append(np.zeros(len(at), bool))
    for run in np.flatnonzero(sizes > 3).tolist():
        part = slice(starts[run], starts[run] + sizes[run])
        a, b = near_pairs(codes[part], most)
        if len(a) <= 4 * sizes[run]:
            found_a.append(ids[part][a])
            found_b.append(ids[part][b])
            dense.append(np.zeros(len(a), bool))
        else:  # many are near: a spanning part will do
            both = np.array(list(spread(ids[part], codes[part], most)), np.int64)
            found_a.append(both[:, 0])
            found_b.append(both[:, 1])
            dense.append(np.ones(len(both), bool))
    return np.concatenate(found_a), np.concatenate(found_b), np.concatenate(dense)


def near_pairs(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within `most` bits, or of more than four a code and no further ones."""
    found_a, found_b, count = [], [], 0
    step = max(1, (1 << 20) // (len(codes) * codes.shape[1]))
    for at in range(0, len(codes), step):
        a, b = np.nonzero(_apart(codes[at : at + step, None], codes[None, at + 1 :]) <= most)
        upper = b >= a
        found_a.append(a[upper] + at)
        found_b.append(b[upper] + at + 1)
        count += len(found_a[-1])
        if count > 4 * len(codes):
            break
    return np.concatenate(found_a), np.concatenate(found_b)


def spread(ids: np.ndarray, codes: np.ndarray, most: int) -> set[tuple[int, int]]:
    """Pairs that span what codes within `most` bits of each other hold together: each reached code seeks those not yet reached."""
    pairs, left = set(), np.arange(len(ids))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            k = queue.pop()
            near = _apart(codes[left], codes[k]) <= most
            for j in left[near].tolist():
                pairs.add((int(ids[k]), int(ids[j])))
                queue.append(j)
            left = left[~near]
    return pairs


def compare_blocks(ids: np.ndarray, labels: list, block: np.ndarray, n: np.ndarray, x: list, threshold: float) -> list[tuple]:
    """Links between two blocks of a family, or inside one: (a, b, null) for a spanning part, (a, null, number of linked vectors)."""
    names = {v: k for k, v in enumerate(dict.fromkeys(zip(labels, map(len, x), strict=True)))}
    group = np.array([names[v] for v in zip(labels, map(len, x), strict=True)])
    forest, others, out = Forest(len(ids)), np.zeros(len(ids), np.int64), []
    kinds = np.unique(block)
    for g in range(len(names)):
        first, second = (np.flatnonzero((group == g) & (block == k)) for k in (kinds[0], kinds[-1]))
        if not len(first) or not len(second):
            continue
        units = {id(part): _unit(np.array([x[i] for i in part])) for part in (first, second)}
        for at in range(0, len(first), 256):
            some = first[at : at + 256]
            close = units[id(first)][at : at + 256] @ units[id(second)].T >= threshold
            if kinds[0] == kinds[-1]:
                close &= some[:, None] != second[None, :]
                others[some] += close @ n[second]
            else:
                others[some] += close @ n[second]
                others[second] += n[some] @ close
            for row, i in zip(close, some.tolist(), strict=True):
                for j in second[row].tolist():
                    if forest.up[i] != forest.up[j] and forest.join(i, j):
                        out.append((int(ids[i]), int(ids[j]), None))
    return out + [(int(ids[i]), None, int(others[i])) for i in np.flatnonzero(others).tolist()]


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
v AS (
  SELECT * FROM e WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
    AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
c AS (
  WITH RECURSIVE reach(vec_id, low) USING KEY (vec_id) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION
    SELECT p.a, min(r.low) FROM reach r JOIN p ON p.b = r.vec_id JOIN recurring.reach o ON o.vec_id = p.a WHERE r.low < o.low GROUP BY p.a)
  SELECT * FROM reach)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.low AS component_id, c.vec_id = c.low AS kept
FROM c LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) n ON n.a = c.vec_id
"""
