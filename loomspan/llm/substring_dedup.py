"""Substring dedup by a compacted de Bruijn graph of token k-mers.

A window of 50 words is an edge between its first and last 49 words. Edges travel as paths: consecutive edges of a
document whose least 16-word hash is the same one word sequence, so an edge stands in a path of the same anchor in every
document. Paths of equal words compact by aggregation on the anchor; an anchor with one sequence only doesn't branch, and
its later occurrences are repeats as a whole. Where sequences of an anchor differ, the first occurrence of each opens into
single edges, which a join on the whole window settles. Repeats keep the coordinates of their first source. Neighbouring
repeats with one source and one distance to it join to long spans; a span's words are then read at its source's coordinates,
and it goes only if their digest is that of its own words. Nothing is sampled: every window stands in one path.

Hashes: an anchor's 64 bits, a path's 64 bits and the check's 64 bits, of independent bases.

Defined results: null, empty and blank texts have no words; below 50 words nothing is removed; a null id is neither source
nor repeat; rows of one id are told apart by a 32-bit hash of their texts (of different texts two in 4e9 pairs share one, and
no word beyond a text's end is taken then); none of them is a source of another, nor is a document of itself; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm._shared import Scratch, mix64, spread
from loomspan.llm.ngram_join import word_hashes

WINDOW = 50
ANCHOR = 16
#: Odd bases of the polynomial hashes: of anchors, of whole spans, and of their check.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


class Powers:
    """Powers of a base modulo 2^64 and of its inverse, grown as texts need them."""

    def __init__(self, base: int):
        self.bases = np.uint64(base), np.uint64(pow(base, -1, 2**64))
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tables[0]) < n:
            self.tables = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, b, np.uint64))]) for b in self.bases]
        return self.tables[0][:n], self.tables[1][:n]


class Spans:
    """Hashes of a text's word spans by three bases."""

    def __init__(self, words: np.ndarray, powers: list[Powers]):
        n = len(words)
        self.sums, self.inverse = [], []
        for k, p in enumerate(powers):
            up, down = p.upto(n + 1)
            own = mix64(words + np.uint64(k))
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up[:n])]))
            self.inverse.append(down)

    def hash(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[k][end] - self.sums[k][start]) * self.inverse[k][start])


def paths(words: np.ndarray, powers: list[Powers], window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Of each path: anchor, span hash, check hash, first edge, number of edges."""
    n = len(words)
    if n < window:
        empty = np.empty(0, np.int64)
        return (empty,) * 5
    spans = Spans(words, powers)
    at = np.arange(n - anchor + 1)
    small = spans.hash(0, at, at + anchor)
    least = np.lib.stride_tricks.sliding_window_view(small, window - anchor + 1).argmin(axis=1)
    least += np.arange(len(least))
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    count = np.diff(np.append(first, len(least)))
    end = first + count - 1 + window
    where = mix64((least[first] - first).astype(np.uint64) * np.uint64(_BASES[0]) + count.astype(np.uint64))
    return small[least[first]].view(np.int64), (spans.hash(1, first, end) ^ where).view(np.int64), spans.hash(2, first, end).view(np.int64), first, count


def _paths_of(docs: DataFrame, window: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [Powers(b) for b in _BASES]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [(doc, copy, paths(word_hashes(text, False), powers, window)) for doc, copy, text in zip(*(c.to_pylist() for c in part.columns), strict=True) if doc is not None]
                if not found:
                    continue
                sizes = [len(p[0]) for _, _, p in found]
                doc, copy = (np.repeat(np.array([f[k] for f in found], kind), sizes) for k, kind in ((0, np.int64), (1, np.int32)))
                columns = [np.concatenate([p[k] for _, _, p in found]) for k in range(5)]
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(copy), *(pa.array(c.astype(np.int64)) for c in columns[:3]), *(pa.array(c.astype(np.int32)) for c in columns[3:])], names=["doc", "copy", "anchor", "span", "check", "first", "edges"])

    return docs.select("doc", "copy", "text").mapInArrow(cut, "doc long, copy int, anchor long, span long, check long, first int, edges int")


def _edges_of(opened: DataFrame, window: int) -> DataFrame:
    """Single edges (e1, e2, doc, copy, first) of the paths listed in `opened(doc, copy, text, at)`."""

    def open_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [Powers(b) for b in _BASES]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                for doc, copy, text, lists in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    spans = Spans(word_hashes(text, False), powers)
                    starts = np.unique(np.concatenate([np.arange(x["first"], x["first"] + x["edges"]) for x in lists]))
                    starts = starts[starts + window < len(spans.sums[0])]
                    for column, value in zip(out, (spans.hash(1, starts, starts + window).view(np.int64), spans.hash(2, starts, starts + window).view(np.int64), np.full(len(starts), doc, np.int64), np.full(len(starts), copy, np.int32), starts.astype(np.int32)), strict=True):
                        column.append(value)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["e1", "e2", "doc", "copy", "first"])

    return opened.select("doc", "copy", "text", "at").mapInArrow(open_paths, "e1 long, e2 long, doc long, copy int, first int")


def repeats(scratch: Scratch, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Runs of repeated edges (doc, copy, first, edges, source_doc, source_copy, source_first) for `docs(doc, copy, text)`; sources have smaller ids."""
    path = scratch.keep(_paths_of(docs, window), "paths")
    by_anchor = path.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("span").alias("s1"), F.max("span").alias("s2"))
    shared = scratch.keep(by_anchor.where("low < high").select(F.col("anchor").alias("a"), (F.col("s1") < F.col("s2")).alias("branches")), "shared")
    met = scratch.keep(path.join(shared, F.col("anchor") == F.col("a")).drop("a"), "met")
    scratch.drop("paths", "shared")
    # One row for each path that several documents may take: where it stands first.
    firsts = met.groupBy("anchor", "span").agg(F.min(F.struct("doc", "copy", "first", "check", "edges")).alias("m"))
    firsts = scratch.keep(firsts.select(F.col("anchor").alias("a"), F.col("span").alias("s"), F.col("m.doc").alias("source_doc"), F.col("m.copy").alias("source_copy"), F.col("m.first").alias("source_first"), F.col("m.check").alias("c"), F.col("m.edges").alias("n")), "compacted")
    placed = met.join(firsts, (F.col("anchor") == F.col("a")) & (F.col("span") == F.col("s")))
    source = ["source_doc", "source_copy", "source_first"]
    whole = placed.where((F.col("doc") > F.col("source_doc")) & (F.col("check") == F.col("c")) & (F.col("edges") == F.col("n"))).select("doc", "copy", "first", "edges", *source)
    whole = scratch.keep(whole, "whole")
    first_ones = placed.where("branches AND doc = source_doc").groupBy(F.col("doc").alias("d"), F.col("copy").alias("k")).agg(F.collect_list(F.struct("first", "edges")).alias("at"))
    first_ones = scratch.keep(first_ones, "branching")
    scratch.drop("met", "compacted")
    edges = scratch.keep(_edges_of(docs.join(first_ones, (F.col("doc") == F.col("d")) & (F.col("copy") == F.col("k"))), window), "edges")
    by_edge = edges.groupBy("e1", "e2").agg(F.min(F.struct("doc", "copy", "first")).alias("m"), F.max("doc").alias("high")).where("m.doc < high")
    by_edge = scratch.keep(by_edge.select(F.col("e1").alias("x1"), F.col("e2").alias("x2"), F.col("m.doc").alias("source_doc"), F.col("m.copy").alias("source_copy"), F.col("m.first").alias("source_first")), "shared_edges")
    single = edges.join(by_edge, (F.col("e1") == F.col("x1")) & (F.col("e2") == F.col("x2"))).where("doc > source_doc").select("doc", "copy", "first", F.lit(1).alias("edges"), *source)
    single = scratch.keep(single, "single")
    scratch.drop("branching", "edges", "shared_edges")
    return whole.unionByName(single)


def joined(runs: np.ndarray) -> np.ndarray:
    """Rows (first, edges, source_doc, source_copy, source_first) with those that go on where another ends, at one source and distance, made one."""
    order = np.lexsort((runs[:, 0], runs[:, 4] - runs[:, 0], runs[:, 3], runs[:, 2]))
    first, edges, doc, copy, at = runs[order].T
    new = np.ones(len(order), bool)
    same = (doc[1:] == doc[:-1]) & (copy[1:] == copy[:-1]) & (at[1:] - first[1:] == at[:-1] - first[:-1])
    new[1:] = ~same | (first[1:] > (first + edges)[:-1])
    start = np.flatnonzero(new)
    out = runs[order][start]
    out[:, 1] = np.maximum.reduceat(first + edges, start) - out[:, 0]
    return out


def _digest(words: list[bytes], first: int, edges: int, window: int) -> int | None:
    """64 bits of the words of a span; None where the text ends before."""
    end = first + edges - 1 + window
    return xxhash.xxh3_64_intdigest(b" ".join(words[first:end]), 50) >> 1 if end <= len(words) else None


_SPAN = ["first", "edges", "source_doc", "source_copy", "source_first"]


def verified_spans(scratch: Scratch, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, copy, at): the repeated spans of each of `docs(doc, copy, text)`, longest possible, with the digest of the words at their sources."""
    listed = repeats(scratch, docs, window).groupBy("doc", "copy").agg(F.collect_list(F.struct(*_SPAN)).alias("at"))

    def join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, copy, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = joined(np.array([[x[n] for n in _SPAN] for x in at], np.int64))
                columns = [pa.array([doc] * len(spans), pa.int64()), pa.array([copy] * len(spans), pa.int32()), *(pa.array(spans[:, k], kind, safe=False) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "copy", *_SPAN])

    spans = scratch.keep(listed.mapInArrow(join_runs, "doc long, copy int, first int, edges int, source_doc long, source_copy int, source_first int"), "spans")
    scratch.drop("whole", "single")
    asked = spans.select("source_doc", "source_copy", "source_first", "edges").distinct().groupBy(F.col("source_doc").alias("d"), F.col("source_copy").alias("k")).agg(F.collect_list(F.struct("source_first", "edges")).alias("at"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for doc, copy, text, lists in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    words = (text or "").encode("utf-8", "replace").split()
                    rows += [(doc, copy, x["source_first"], x["edges"], _digest(words, x["source_first"], x["edges"], window)) for x in lists]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["sd", "sc", "sf", "se", "digest"])

    sources = docs.join(asked, (F.col("doc") == F.col("d")) & (F.col("copy") == F.col("k"))).select("doc", "copy", "text", "at").mapInArrow(read, "sd long, sc int, sf int, se int, digest long")
    sources = scratch.keep(sources.dropDuplicates(["sd", "sc", "sf", "se"]), "sources")
    same = (F.col("source_doc") == F.col("sd")) & (F.col("source_copy") == F.col("sc")) & (F.col("source_first") == F.col("sf")) & (F.col("edges") == F.col("se"))
    return spans.join(sources, same).groupBy(F.col("doc").alias("d"), F.col("copy").alias("k")).agg(F.collect_list(F.struct(*_SPAN, "digest")).alias("at"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) per row; kept words are joined by one space."""
    return _apply(docs, id_col, text_col, window, "kept_text")


def _apply(docs: DataFrame, id_col: str, text_col: str, window: int, result: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "substrings")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.hash(text_col).alias("copy"), F.col(text_col).alias("text"))
    spans = scratch.keep(verified_spans(scratch, rows, window), "verified")
    scratch.drop("spans", "sources")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                counts, removed, kept = [], [], []
                for text, at in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = (text or "").encode("utf-8", "replace").split()
                    gone, left = 0, words
                    if at:
                        change = np.zeros(len(words) + 1, np.int32)
                        for x in at:
                            own = _digest(words, x["first"], x["edges"], window)
                            if own is not None and own == x["digest"]:
                                change[x["first"]] += 1
                                change[x["first"] + x["edges"] - 1 + window] -= 1
                        stay = np.cumsum(change[:-1]) == 0
                        gone = int(len(words) - stay.sum())
                        left = [words[i] for i in np.flatnonzero(stay).tolist()]
                    text = b" ".join(left)
                    counts.append(len(words))
                    removed.append(gone)
                    kept.append(text.decode() if result == "kept_text" else hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", result])

    return rows.join(spans, (F.col("doc") == F.col("d")) & (F.col("copy") == F.col("k")), "left").select("doc", "text", "at").mapInArrow(remove, f"doc_id long, n_words long, n_removed long, {result} string")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return _apply(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "doc_id", "text", WINDOW, "kept_sha256")


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
k AS (
  SELECT doc_id, unnest(range(1, len(words) - 48)) AS i, words FROM w WHERE len(words) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS edge FROM k),
m AS (SELECT edge, min(doc_id) AS low FROM h GROUP BY edge HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT h.doc_id, h.i FROM h JOIN m ON h.edge = m.edge WHERE m.low < h.doc_id),
g AS (SELECT doc_id, list(i) AS starts FROM r GROUP BY doc_id),
p AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS pos, unnest(words) AS word FROM w),
c AS (
  SELECT p.doc_id, p.pos, p.word,
         coalesce(max(r.i) OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -99) > p.pos - 50 AS gone
  FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.i = p.pos),
o AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
         sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM c GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM w LEFT JOIN o ON o.doc_id = w.doc_id
"""
