"""Cross-entropy difference of two n-gram models.

A target and a background model, alike in order, smoothing and vocabulary, give every token of a document its loss; the
mean difference, target minus background, scores the document: below 0 it reads more like the target. The background is
counted over all documents, the target over those that are marked.

Every word and every bigram of the corpus is counted by itself, under a 64-bit hash. A task cuts its documents into chunks of
bounded text and sends each chunk's distinct n-grams with their counts to buckets, ranges of the hash whose number follows
the input; a bucket adds them up and answers each chunk that asked. A chunk then scores its documents by the answers, so no
task and no driver holds the model, and a common n-gram is one row for each chunk. What is asked is shuffled once and not
written; the answers and the chunks' documents, as places in their sorted words, are.

Bigram probabilities are Dirichlet-smoothed with the unigram's, those with one more count for each distinct word of the
corpus. Losses in nats.

Defined results: null, empty and blank texts have no tokens and null losses and score; without target documents the target
model is uniform; rows of one id are scored each; an empty table gives none; other columns are ignored; a null mark is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm._families import groups
from loomspan.llm._shared import Scratch, mix64
from loomspan.llm.ngram_join import word_hashes

SMOOTHING = 20.0
#: Class of what stands before a document's first word.
_START = 0
_KINDS = 2  # background, target
#: Characters of text in a chunk, and for each bucket.
CHUNK_CHARS = 8 << 20
BUCKET_CHARS = 16 << 20
#: Ids of target documents are broadcast up to so many (some 32 bytes each); beyond, the texts are joined by a shuffle.
BROADCAST_IDS = 1 << 20


def bigram_hashes(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each token: a 64-bit hash of the word before it (none at `starts`) and itself."""
    before = np.roll(words, 1)
    before[starts] = _START
    return mix64(mix64(before + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93) + words)


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on: what is small compresses well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplaned(raw: bytes, kind: type, n: int, at: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()


def _steps(ordered: np.ndarray) -> bytes:
    return _planes(np.diff(ordered, prepend=np.uint64(0)))


def _counted(keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, each key's place among them, and counts of all and of the marked."""
    distinct, place, every = np.unique(keys, return_inverse=True, return_counts=True)
    return distinct, place, every, np.bincount(place[marks], minlength=len(distinct))


def _chunks(marked: DataFrame, buckets: int, chunk_chars: int) -> DataFrame:
    """Rows of bucket -1 hold a chunk's documents as places in its sorted distinct words; the others what it asks of a bucket."""
    doc = marked.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        chunk = TaskContext.get().partitionId() << 32
        ids, marks, held, chars, kind = [], [], [], 0, None

        def close() -> Iterator[pa.RecordBatch]:
            lengths = np.array([len(w) for w in held], np.int64)
            words, target = np.concatenate([np.empty(0, np.uint64), *held]), np.repeat(np.array(marks, bool), lengths)
            starts = (np.cumsum(lengths) - lengths)[lengths > 0]
            ones = _counted(words, target)
            twos = _counted(bigram_hashes(words, starts), target)
            data = [press(np.int64(len(ones[0])).tobytes() + _steps(ones[0]) + _planes(ones[1].astype(np.uint32)))]
            to = [-1]
            of = [((k[0] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32) for k in (ones, twos)]
            ends = [np.searchsorted(o, np.arange(buckets + 1, dtype=np.uint64)) for o in of]
            for b in range(buckets):
                (a1, e1), (a2, e2) = ((int(e[b]), int(e[b + 1])) for e in ends)
                if e1 > a1 or e2 > a2:
                    to.append(b)
                    parts = [_steps(k[0][a:e]) for k, a, e in ((ones, a1, e1), (twos, a2, e2))] + [_planes(k[c][a:e].astype(np.uint32)) for c in (2, 3) for k, a, e in ((ones, a1, e1), (twos, a2, e2))]
                    data.append(press(np.array([e1 - a1, e2 - a2]).tobytes() + b"".join(parts)))
            none = [None] * (len(to) - 1)
            columns = [pa.array([chunk] * len(to), pa.int64()), pa.array(to, pa.int32()), pa.array(data, pa.binary()), pa.array([ids, *none], pa.list_(kind)), pa.array([lengths.tolist(), *none], pa.list_(pa.int64())), pa.array([marks, *none], pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "bucket", "data", "ids", "lengths", "marks"])

        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, text, mark in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    ids.append(i)
                    marks.append(bool(mark))
                    held.append(word_hashes(text, True))
                    chars += len(text or "")
                    if chars >= chunk_chars:
                        yield from close()
                        chunk, ids, marks, held, chars = chunk + 1, [], [], [], 0
        if ids:
            yield from close()

    return marked.select("doc_id", "text", "target").mapInArrow(cut, f"chunk long, bucket int, data binary, ids array<{doc}>, lengths array<long>, marks array<boolean>")


def _totals(asked: DataFrame) -> DataFrame:
    """Answers (chunk, bucket, data): the corpus counts of what each chunk asked, in its order; a row without chunk has the bucket's sums. Rows of documents (bucket -1) go on as they are."""
    doc = asked.schema["ids"].dataType.simpleString()
    schema = f"chunk long, bucket int, data binary, ids {doc}, lengths array<long>, marks array<boolean>, words long, every long, marked long"
    sums_only = ["words", "every", "marked"]

    def row(of: pa.Schema, **columns: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        kinds = {name: of.field(name).type for name in ("chunk", "bucket", "data", "ids", "lengths", "marks")} | dict.fromkeys(sums_only, pa.int64())
        return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(n, kind)) for name, kind in kinds.items()], names=list(kinds))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        undo, press = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        for table in groups(batches, "to"):
            bucket = table["bucket"][0].as_py()
            if bucket < 0:
                for part in table.to_batches():
                    yield row(part.schema, **{name: part.column(name) for name in ("chunk", "bucket", "data", "ids", "lengths", "marks")})
                continue
            chunks, answers, sums = table["chunk"].to_pylist(), [[] for _ in range(table.num_rows)], [0, 0, 0]
            raw = [undo(d) for d in table["data"].to_pylist()]
            sizes = np.array([np.frombuffer(r, np.int64, 2) for r in raw])
            for which in range(2):
                n, other, both = sizes[:, which], sizes[:, 0] * which, sizes.sum(1)
                keys = np.concatenate([np.cumsum(_unplaned(r, np.uint64, k, 16 + 8 * o)) for r, k, o in zip(raw, n.tolist(), other.tolist(), strict=True)])
                distinct, place = np.unique(keys, return_inverse=True)
                ends = np.cumsum(n)
                for kind in range(_KINDS):
                    counts = np.concatenate([_unplaned(r, np.uint32, k, 16 + 8 * b + 4 * (kind * b + o)) for r, k, o, b in zip(raw, n.tolist(), other.tolist(), both.tolist(), strict=True)])
                    total = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)  # exact below 2^53
                    if not which:
                        sums[0], sums[1 + kind] = len(distinct), int(total.sum())
                    found = total[place]
                    for answer, end, k in zip(answers, ends.tolist(), n.tolist(), strict=True):
                        answer.append(found[end - k : end])
            for at in range(0, len(chunks), 1024):
                some = answers[at : at + 1024]
                data = [press(s.tobytes() + b"".join(map(_planes, a))) for s, a in zip(sizes[at : at + 1024], some, strict=True)]
                yield row(table.schema, chunk=pa.array(chunks[at : at + 1024], pa.int64()), bucket=pa.array([bucket] * len(some), pa.int32()), data=pa.array(data, table.schema.field("data").type))
            yield row(table.schema, bucket=pa.array([bucket], pa.int32()), **{name: pa.array([v], pa.int64()) for name, v in zip(sums_only, sums, strict=True)})

    to = F.when(F.col("bucket") < 0, -1 - F.col("chunk")).otherwise(F.col("bucket").cast("long"))
    return asked.withColumn("to", to).repartition("to").sortWithinPartitions("to").mapInArrow(add, schema)


def score_documents(marked: DataFrame, smoothing: float = SMOOTHING, chars: int | None = None, chunk_chars: int = CHUNK_CHARS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, score) per row of `marked(doc_id, text, target)`, by counts of real words and bigrams.

    A document's own counts are left out of the models that counted it, so none is scored by having been learnt.
    `chars`: characters of all texts, if known; they set the number of buckets only.
    """
    scratch = Scratch(marked.sparkSession, "lm")
    chars = chars or marked.agg(F.sum(F.length("text"))).first()[0] or 0
    answers = scratch.keep(_totals(_chunks(marked, max(1, -(-chars // bucket_chars)), chunk_chars)), "answers")
    sums = answers.where("chunk IS NULL").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "every", "marked"))).first()
    vocabulary, sizes = sums[0], sums[1:]
    doc = marked.schema["doc_id"].dataType.simpleString()
    kept = answers.where("chunk IS NOT NULL").select("chunk", "bucket", "data", "ids", "lengths", "marks")

    def own_counts(document: np.ndarray, place: np.ndarray) -> np.ndarray:
        _, inverse, times = np.unique(document << 32 | place, return_inverse=True, return_counts=True)
        return times[inverse]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        undo = zstandard.ZstdDecompressor().decompress
        for table in groups(batches, "chunk"):
            raw = [undo(d) for d in table["data"].to_pylist()]
            ids, lengths, marks = table["ids"].chunk(0)[0].values, np.array(table["lengths"][0].as_py(), np.int64), np.array(table["marks"][0].as_py(), bool)
            n = int(np.frombuffer(raw[0], np.int64, 1)[0])
            place = _unplaned(raw[0], np.uint32, int(lengths.sum()), 8 + 8 * n).astype(np.int64)
            starts = (np.cumsum(lengths) - lengths)[lengths > 0]
            document = np.repeat(np.arange(len(lengths)), lengths)
            words = np.cumsum(_unplaned(raw[0], np.uint64, n, 8))[place]
            pair = np.unique(bigram_hashes(words, starts), return_inverse=True)[1]
            found: list[list[np.ndarray]] = [[], [], [], []]  # words and bigrams: background, target
            for r in raw[1:]:
                at = 16
                for k, size in enumerate(np.repeat(np.frombuffer(r, np.int64, 2), _KINDS).tolist()):
                    found[k].append(_unplaned(r, np.int64, size, at))
                    at += 8 * size
            own, own_pair = own_counts(document, place), own_counts(document, pair)
            losses = []
            for kind in range(_KINDS):
                less = np.ones(len(lengths), np.int64) if not kind else marks.astype(np.int64)
                out = less[document]
                one = (np.concatenate([np.empty(0, np.int64), *found[kind]])[place] if len(place) else place) - out * own
                two = (np.concatenate([np.empty(0, np.int64), *found[2 + kind]])[pair] if len(pair) else pair) - out * own_pair
                before = np.roll(one, 1)
                before[starts] = 0
                whole = (sizes[kind] + vocabulary - less * lengths)[document]
                token = -np.log((two + smoothing * (one + 1.0) / whole) / (np.maximum(before, two) + smoothing))
                losses.append(np.bincount(document, weights=token, minlength=len(lengths)) / np.maximum(lengths, 1))
            empty = lengths == 0
            background, target = losses
            columns = [pa.array(lengths), *(pa.array(x, mask=empty) for x in (target, background, target - background))]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    return kept.repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(run, f"doc_id {doc}, n_tokens long, loss_target double, loss_background double, score double")


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Target: documents that `labels` calls of good quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("d")).distinct()
    good = F.broadcast(good) if good.count() <= BROADCAST_IDS else good.hint("merge")
    marked = docs.select("doc_id", "text").join(good, F.col("doc_id") == F.col("d"), "left").select("doc_id", "text", F.col("d").isNotNull().alias("target"))
    return score_documents(marked, chars=docs.agg(F.sum(F.length("text"))).first()[0])
