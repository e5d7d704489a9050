"""Cross-file retrieval: candidates of a repository, scores, top k, neighbours and context text.

Candidates never leave a repository. Queries meet them in blocks: a task holds an inverted index, or a matrix, of at most
`BLOCK` (word sets: `SET_BLOCK`) chunks of one repository, streams queries past it and gives the best k of each; a large repository has many blocks,
and a large set of queries many slices of `SLICE`, so neither meets in one task. The best of all blocks follow by a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import python_code, scores
from loomspan.functions import text as tx
from loomspan.tables import Scratch, mix64

BLOCK = 8_192
SLICE = 65_536
#: Chunks of a block of word sets, which travel as codes: each query goes to each block, so few blocks keep the disk small.
SET_BLOCK = 65_536
#: Words that have a code of 2 bytes; one in so many files is asked for them, and at most so many chunks. Words that are bits in a block.
CODES, CODE_SAMPLE, CODE_ROWS = 65_536, 64, 32_768
BITS, FIRST_BITS = 256, 128
#: Of every 16th set, as many bounds tell how great a bound the first compared sets have.
LEADERS = 8

#: Name -> score of arrays (words in common, words of the query, words of the chunk); register to extend.
SET_SCORERS: dict[str, Callable] = {
    "jaccard_sim": lambda shared, query, chunk: shared / np.maximum(query + chunk - shared, 1),
    "containment": lambda shared, query, chunk: shared / max(query, 1) + 0.0 * chunk,
}


def word_ids(text: Column) -> Column:
    """The word set as 64-bit hashes: sets of numbers intersect several times faster than sets of strings."""
    return F.array_distinct(F.transform(tx.word_tokens(text), lambda w: F.xxhash64(w)))


def pairs(queries: DataFrame, chunks: DataFrame, salts: int = 1, cross_file_only: bool = True) -> DataFrame:
    """Each query with the chunks of its repository's other files. queries: task_id, repo, filepath, ...; chunks: repo, filepath, ..."""
    right = chunks.select(*(F.col(c).alias(f"chunk_{c}") for c in chunks.columns))
    if salts > 1:
        queries = queries.withColumn("salt", F.pmod(F.xxhash64("task_id"), F.lit(salts)))
        right = right.withColumn("chunk_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    on = (F.col("repo") == F.col("chunk_repo")) & ((F.col("salt") == F.col("chunk_salt")) if salts > 1 else F.lit(True))
    if cross_file_only:
        on = on & (F.col("filepath") != F.col("chunk_filepath"))
    return queries.join(right, on).drop("salt", "chunk_salt", "chunk_repo")


def top_k(scored: DataFrame, k: int, order: list[Column], key: str = "task_id", threshold: float = 0.0) -> DataFrame:
    """The k best rows of each key with `rank`; a threshold of 0 is off. Spark keeps k rows a key below the shuffle."""
    if threshold:
        scored = scored.where(F.col("score") >= threshold)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def _parts_of(rows: DataFrame, most: int, name: str) -> DataFrame:
    """(repo, name): how many parts of at most about `most` rows a repository's rows make."""
    return rows.groupBy("repo").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias(name))


def _numbers(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def in_blocks(queries: DataFrame, chunks: DataFrame, best, result: str, block: int = BLOCK, slice_rows: int = SLICE, counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Rows of `best(chunks, queries)` for each block of a repository's chunks and each slice of its queries.

    queries: repo, q (struct); chunks: repo, c (struct). `best` gets a block's structs as an Arrow array, and an iterator of arrays of
    queries; it yields record batches of the schema `result`. counted: the same rows with repo only, where counting these is dear.
    """
    ask, hold = counted or (queries, chunks)
    blocks, slices = _parts_of(hold, block, "blocks"), _parts_of(ask, slice_rows, "slices")
    sizes = blocks.join(slices, "repo").select(F.col("repo").alias("r"), "blocks", "slices")
    place = lambda rows, n: rows.join(sizes, F.col("repo") == F.col("r")).withColumn("own", F.pmod(F.xxhash64(*rows.columns[1:]), F.col(n)).cast("int"))
    c = place(chunks, "blocks").select("repo", F.col("own").alias("block"), _numbers(F.col("slices")).alias("slice"), "c")
    q = place(queries, "slices").select("repo", _numbers(F.col("blocks")).alias("block"), F.col("own").alias("slice"), "q")
    return _met(c.unionByName(q, allowMissingColumns=True).select(F.xxhash64("repo", "block", "slice").alias("task"), F.col("q").isNotNull().alias("asks"), "c", "q"), best, result)


def _met(both: DataFrame, best, result: str) -> DataFrame:
    """Rows of `best` for each task. both: task, asks, c or q (structs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches sorted by task, chunks before queries; a task's rows are held: a block and a slice."""
        held: list[pa.Array] = []
        asked: list[pa.Array] = []
        now = None

        def answer() -> Iterator[pa.RecordBatch]:
            if held and asked:
                whole = [pa.concat_arrays(held)]
                held.clear()
                yield from best(whole.pop(), iter(asked))
            asked.clear()

        for batch in batches:
            tasks, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((tasks[1:] != tasks[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(tasks)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if tasks[a] != now:
                    yield from answer()
                    held, now = [], tasks[a]
                if asks[a]:
                    asked.append(batch.column(3).slice(a, b - a))
                else:
                    held.append(batch.column(2).slice(a, b - a))
        yield from answer()

    return both.repartition("task").sortWithinPartitions("task", "asks").mapInArrow(run, result)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list array and where each row's begin, and the last ends."""
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _best_k(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest, the first ones of equals; in their order."""
    if len(score) > k:
        least = np.partition(score, -k)[-k]
        above = np.flatnonzero(score > least)
        chosen = np.concatenate([above, np.flatnonzero(score == least)[: k - len(above)]])
    else:
        chosen = np.arange(len(score))
    return chosen[np.lexsort((chosen, -score[chosen]))]


def _codebook(sets: DataFrame) -> np.ndarray:
    """Sorted hashes of the most frequent words in the sets of a bounded sample of files. It only shortens what travels: other words keep their hash."""
    some = sets.where(F.pmod(F.xxhash64("filepath"), F.lit(CODE_SAMPLE)) == 0).select("words").limit(CODE_ROWS)
    counts = some.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return np.sort(np.array([r.word for r in counts.orderBy(F.desc("n"), "word").limit(CODES).collect()], np.int64))


def _coded(sets: DataFrame, name: str, book: np.ndarray) -> DataFrame:
    """(repo, name): a struct of the other columns, the number of words, codes of the book's words (2 bytes each) and hashes of the others."""
    kept = [c for c in sets.columns if c not in ("repo", "words")]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, starts = _flat(batch.column("words"))
            place = np.searchsorted(book, values)
            known = book[np.minimum(place, len(book) - 1)] == values if len(book) else np.zeros(len(values), bool)
            before = np.append(0, np.cumsum(known))[starts]
            binary = lambda data, at: pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
            columns = [*(batch.column(c) for c in kept), pa.array(np.diff(starts), pa.int32()), binary(place[known].astype(np.uint16), before * 2), binary(values[~known], (starts - before) * 8)]
            yield pa.RecordBatch.from_arrays([batch.column("repo"), pa.StructArray.from_arrays(columns, [*kept, "size", "codes", "others"])], names=["repo", name])

    kinds = {f.name: f.dataType.simpleString() for f in sets.schema}
    fields = ", ".join([*(f"{c}: {kinds[c]}" for c in kept), "size: int, codes: binary, others: binary"])
    return sets.mapInArrow(code, f"repo {kinds['repo']}, {name} struct<{fields}>")


def _numbers_of(sets: pa.Array, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in the binary field of structs, and where each row's begin, and the last ends."""
    data = sets.field(name)
    _, at, values = data.buffers()
    starts = np.frombuffer(at, np.int32)[data.offset : data.offset + len(data) + 1]
    return np.frombuffer(values or b"", np.uint8)[starts[0] : starts[-1]].view(kind), (starts - starts[0]) // np.dtype(kind).itemsize


class SetBlock:
    """Word sets of a block in an order that breaks ties, and the best of them for a query's set.

    The block's `BITS` most frequent words are bits of each set, all others have postings. Postings and the first bits give the words
    in common with each set but for the later bits; with as many of these as both have, that bounds the score, which must not fall as
    words in common grow. Only sets whose bound comes up to the k-th score of some with great bounds are compared by their later bits, and
    scored in double precision.
    """

    def __init__(self, sets: pa.Array, order: list[int], files: list[str], score: Callable) -> None:
        self.score, n = score, len(order)
        rank = np.empty(n, np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        self.sizes = sets.field("size").to_numpy()[order].astype(np.float64)
        self.rough_sizes = self.sizes.astype(np.float32)
        codes, starts = _numbers_of(sets, "codes", np.uint16)
        # Code and place in one number, sorted where it stands, as a block's words are most of a worker's memory.
        shift = (n - 1).bit_length()
        kind = np.uint32 if shift <= 16 else np.uint64
        keys = codes.astype(kind)
        keys <<= kind(shift)
        keys |= np.repeat(rank.astype(kind), np.diff(starts))
        keys.sort()
        keys &= kind((1 << shift) - 1)
        self.owner = keys.astype(np.int32, copy=False) if kind is np.uint64 else keys.view(np.int32)
        counts = sum((np.bincount(codes[a : a + (1 << 20)], minlength=CODES) for a in range(0, len(codes), 1 << 20)), np.zeros(CODES, np.int64))
        self.first = np.append(0, np.cumsum(counts))
        frequent = np.argsort(-counts, kind="stable")[:BITS]
        self.bit = np.full(CODES, -1, np.int64)
        self.bit[frequent] = np.arange(len(frequent))
        self.bits = np.zeros((BITS // 64, n), np.uint64)
        for k, word in enumerate(frequent.tolist()):
            self.bits[k // 64, self.owner[self.first[word] : self.first[word + 1]]] |= np.uint64(1 << k % 64)
        self.n_later = np.bitwise_count(self.bits[FIRST_BITS // 64 :]).sum(0).astype(np.float32)
        others, starts = _numbers_of(sets, "others", np.int64)
        by = np.argsort(others, kind="stable")
        self.others, self.other_owner = others[by], np.repeat(rank, np.diff(starts))[by]
        self.of_file: dict[str, list[int]] = {}
        for at, i in enumerate(order):
            self.of_file.setdefault(files[i], []).append(at)
        self.most = max(map(len, self.of_file.values()))
        self.empty: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def best_of_empty(self, own: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """For a query without words: one list for all, long enough to leave out any file."""
        if k not in self.empty:
            value = self.score(np.zeros(len(self.sizes)), 0.0, self.sizes)
            chosen = _best_k(value, k + self.most)
            self.empty[k] = chosen, value[chosen]
        chosen, value = self.empty[k]
        left = ~np.isin(chosen, own)
        return chosen[left][:k], value[left][:k]

    def best(self, asked: pa.Array, files: list[str], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and scores of each query's k best sets of other files."""
        sizes = asked.field("size").to_numpy()
        codes, starts = _numbers_of(asked, "codes", np.uint16)
        others, other_starts = _numbers_of(asked, "others", np.int64)
        low, high = (np.searchsorted(self.others, others, side) for side in ("left", "right"))
        for n, own in enumerate(files):
            own = self.of_file.get(own, [])
            if not sizes[n]:
                yield self.best_of_empty(own, k)
                continue
            mine = codes[starts[n] : starts[n + 1]]
            bit = self.bit[mine]
            posted, bit = mine[bit < 0], bit[bit >= 0]
            mask = np.zeros(BITS // 64, np.uint64)
            np.bitwise_or.at(mask, bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
            found = [self.owner[a:b] for a, b in zip(self.first[posted].tolist(), self.first[posted.astype(np.int64) + 1].tolist(), strict=True) if a < b]
            found += [self.other_owner[a:b] for a, b in zip(low[other_starts[n] : other_starts[n + 1]].tolist(), high[other_starts[n] : other_starts[n + 1]].tolist(), strict=True) if a < b]
            shared = np.bincount(np.concatenate(found), minlength=len(self.sizes)).astype(np.float32) if found else np.zeros(len(self.sizes), np.float32)
            for w in range(FIRST_BITS // 64):
                shared += np.bitwise_count(self.bits[w] & mask[w])
            size, later = float(sizes[n]), np.float32((bit >= FIRST_BITS).sum())
            exact = lambda at: self.score(sum((np.bitwise_count(self.bits[w, at] & mask[w]) for w in range(FIRST_BITS // 64, BITS // 64)), shared[at].astype(np.float64)), size, self.sizes[at])  # noqa: E731, B023
            bound = self.score(shared + np.minimum(self.n_later, later), size, self.rough_sizes)
            bound[own] = -1.0
            # What is surely reached: by the sets whose bounds are about the greatest, as every 16th tells.
            some = bound[::16]
            some = np.flatnonzero(bound >= max(0.0, np.partition(some, -LEADERS)[-LEADERS] if len(some) > LEADERS else 0.0))
            least = np.partition(exact(some), -k)[-k] if len(some) >= k else 0.0
            able = np.flatnonzero(bound >= max(0.0, least - 1e-5 * max(1.0, abs(least))))
            value = exact(able)
            chosen = _best_k(value, k)
            yield able[chosen], value[chosen]


def rank_sets(queries: DataFrame, chunks: DataFrame, k: int, scorer: str = "jaccard_sim", threshold: float = 0.0, ties: str = "path", block: int = SET_BLOCK, slice_rows: int = SLICE, shown: Column | None = None) -> DataFrame:
    """Top k chunks of the repository's other files by a score of word sets: task_id, chunk_filepath, chunk_chunk_no, chunk_text, score, rank.

    queries: task_id, repo, filepath, query; chunks: repo, filepath, chunk_no, text. Either may bring its word set as `words` (`word_ids`).
    ties: "path" (file, then chunk number) or "text_desc" (chunk text, descending). shown: what is given as chunk_text, such as a digest.
    """
    words = lambda rows, text: F.col("words") if "words" in rows.columns else word_ids(F.col(text))
    q = queries.select("repo", "task_id", "filepath", words(queries, "query").alias("words"))
    c = chunks.select("repo", "filepath", F.col("chunk_no").cast("int").alias("chunk_no"), (F.col("text") if shown is None else shown).alias("text"), words(chunks, "text").alias("words"))
    book, score = _codebook(c), SET_SCORERS[scorer]

    def best(held: pa.Array, asked: Iterator[pa.Array]) -> Iterator[pa.RecordBatch]:
        path, number, text = (held.field(n) for n in ("filepath", "chunk_no", "text"))
        paths, numbers = path.to_pylist(), number.to_pylist()
        order = sorted(range(len(held)), key=lambda i: (paths[i], numbers[i]))
        if ties == "text_desc":
            texts = text.to_pylist()
            order.sort(key=lambda i: texts[i] or "", reverse=True)
        sets, place = SetBlock(held, order, paths, score), np.array(order)
        del held
        for whole in asked:
            for at in range(0, len(whole), 1024):
                some = whole.slice(at, 1024)
                chosen = list(sets.best(some, some.field("filepath").to_pylist(), k))
                value = np.concatenate([v for _, v in chosen])
                kept = value >= (threshold or 0.0)
                which = pa.array(place[np.concatenate([p for p, _ in chosen])[kept]])
                task = pa.array(np.repeat(np.arange(len(some)), [len(p) for p, _ in chosen])[kept])
                columns = [some.field("task_id").take(task), path.take(which), number.take(which), text.take(which), pa.array(value[kept])]
                yield pa.RecordBatch.from_arrays(columns, names=["task_id", "chunk_filepath", "chunk_chunk_no", "chunk_text", "score"])

    task, given = queries.schema["task_id"].dataType.simpleString(), c.schema["text"].dataType.simpleString()
    parts = q.select("repo"), c.select("repo")
    found = in_blocks(_coded(q, "q", book), _coded(c, "c", book), best, f"task_id {task}, chunk_filepath string, chunk_chunk_no int, chunk_text {given}, score double", block, slice_rows, parts)
    order = [F.desc("score"), *([F.desc("chunk_text")] if ties == "text_desc" else []), F.col("chunk_filepath"), F.col("chunk_chunk_no")]
    return top_k(found, k, order)


K1, B, EPSILON = 1.5, 0.75, 0.25
#: Chunks of a block of counted words: each query goes to each block, so few blocks keep the disk small.
TERM_BLOCK, TERM_SLICE = 32_768, 131_072
#: Words of files whose counts one task adds up.
COUNTED = 8_000_000
#: Repositories whose sizes go to all tasks; those of more are joined.
MANY = 65_536
#: Words in so large a share of a block's chunks, and at most so many, are rows of a matrix; the others have postings.
DENSE, DENSE_WORDS = 0.09, 384
#: Queries that a block answers at once. Blocks of at most so many texts score each of them as it stands.
AT_ONCE, PLAIN = 128, 256
#: What 32 bits may change in a score, as a part of it and besides.
ROUGH, ROUGH_LEAST = 1e-4, 4e-6


def bm25(candidates: DataFrame, query_terms: DataFrame, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """BM25 (Okapi) of each task's own candidates: (task_id, chunk_id, score); candidates without a query term score 0.

    candidates: task_id, chunk_id, tokens. query_terms: task_id, term, weight: a repeated term counts again, and line
    weights are summed into a term's weight beforehand, as the score is linear in it. Terms in over half of the candidates
    get epsilon times the mean inverse document frequency.
    """
    per = candidates.groupBy("task_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.size("tokens").cast("double")).alias("avg_len"))
    counted = candidates.select("task_id", "chunk_id", F.size("tokens").cast("double").alias("len"), F.explode("tokens").alias("term")).groupBy("task_id", "chunk_id", "len", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    df = counted.groupBy("task_id", "term").agg(F.count(F.lit(1)).cast("double").alias("df")).join(per, "task_id")
    idf = df.withColumn("raw", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = idf.groupBy("task_id").agg(F.avg("raw").alias("mean"))
    idf = idf.join(mean, "task_id").select("task_id", "term", "avg_len", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    weights = query_terms.groupBy("task_id", "term").agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    part = F.col("weight") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    hits = counted.join(idf.join(weights, ["task_id", "term"]), ["task_id", "term"]).groupBy("task_id", "chunk_id").agg(F.sum(part).alias("score"))
    return candidates.select("task_id", "chunk_id").join(hits, ["task_id", "chunk_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))

def _mixed(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """One number for each word and owner."""
    return mix64(words.view(np.uint64) + (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _owners(starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of all spans, one after the other."""
    sizes = ends - starts
    kind = np.int32 if len(ends) and max(int(ends.max()), int(sizes.sum())) < 1 << 31 else np.int64
    places = np.repeat((starts - (np.cumsum(sizes) - sizes)).astype(kind), sizes)
    places += np.arange(len(places), dtype=kind)
    return places


def _binary(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of so many numbers each."""
    at = np.append(0, np.cumsum(counts)) * data.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _chunks_of(files: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of arrays (chunk_no, words): where each row's chunks begin, the chunks' numbers, all words, and where each chunk's begin."""
    files = files.fill_null([]) if files.null_count else files
    offsets = files.offsets.to_numpy()
    inner = files.values.slice(offsets[0], offsets[-1] - offsets[0])
    words, starts = _flat(inner.field("words"))
    return offsets - offsets[0], inner.field("chunk_no").to_numpy(), words, starts


def _file_counts(offsets: np.ndarray, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, word, number of the row's chunks with the word, and the sorted `_mixed` of row and word."""
    chunk = _owners(starts)
    _, first = np.unique(_mixed(words, chunk), return_index=True)
    words, file = words[first], _owners(offsets)[chunk[first]]
    keys, first, times = np.unique(_mixed(words, file), return_index=True, return_counts=True)
    return file[first], words[first], times, keys


def _packed(known: np.ndarray, n: int, owner: np.ndarray, codes: np.ndarray, others: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    """Rows of codes, of hashes of other words, and of each of the values: codes' first."""
    order = np.lexsort((np.where(known, codes, 0), ~known, owner))
    owner, known = owner[order], known[order]
    return [
        _binary(codes[order][known].astype(np.uint16), np.bincount(owner[known], minlength=n)),
        _binary(others[order][~known], np.bincount(owner[~known], minlength=n)),
        *(_binary(v[order], np.bincount(owner, minlength=n)) for v in values),
    ]


def _codes(book: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the book, and whether the word stands there."""
    place = np.searchsorted(book, words)
    return place, (book[np.minimum(place, len(book) - 1)] == words if len(book) else np.zeros(len(words), bool))


_STAT = "kind int, repo long, a binary, b binary, c binary"
_FILE, _HISTOGRAM, _WORD = range(3)
#: Rows that a block gets: its chunks, and of the repository in how many chunks words are, and files' mean inverse frequencies.
_CHUNK, _COUNTS, _MEANS = range(3)


_DEALT = "bucket int, r binary, f binary, n binary, sizes binary, words binary, times binary"
_FILES = -1


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Each file's words, with the number of its chunks that have them, in buckets by the word (`_DEALT`: many files a row).

    rows: r and f (hashes of repository and file), chunks, asked. Bucket `_FILES` has the files: chunks in n, queries in sizes, tokens in words.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _DEALT.split(", ")]
        for batch in batches:
            r, f = (batch.column(x).to_numpy() for x in range(2))
            offsets, _, words, starts = _chunks_of(batch.column(2))
            n, length, asked = np.diff(offsets), np.diff(starts[offsets]), batch.column(3).to_numpy().astype(np.int32)
            whole = [_binary(x, np.array([len(r)])) for x in (r, f, n.astype(np.int64), asked, length.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([_FILES], pa.int32()), *whole, pa.array([b""])], names=names)
            file, words, times, _ = _file_counts(offsets, words, starts)
            if not len(words):
                continue
            bucket = ((words.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            key = (bucket << 32) | file
            order = np.argsort(key, kind="stable")
            key, words, times = key[order], words[order], times[order].astype(np.int32)
            entry = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(entry, len(key))).astype(np.int32)
            of, file = key[entry] >> 32, key[entry] & 0xFFFFFFFF
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            entries, counts = np.diff(np.append(first, len(of))), np.add.reduceat(sizes, first)
            columns = [*(_binary(x, entries) for x in (r[file], f[file], n[file].astype(np.int64), sizes)), _binary(words, counts), _binary(times, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(of[first], pa.int32()), *columns], names=names)

    return rows.select("r", "f", "chunks", "asked").mapInArrow(deal, _DEALT)


def _word_statistics(dealt: DataFrame, sizes: DataFrame, buckets: int) -> DataFrame:
    """Counts of words in packed rows (`_STAT`), each of one kind.

    `_FILE`: hashes of files, what leaving the file out adds to the sum of all words' inverse frequencies, and how many words it takes out.
    `_HISTOGRAM`: numbers of a repository's chunks, and how many words are in so many. `_WORD`: words in over one chunk, and in how many.
    sizes: r, n_repo; they go to each bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        now = None

        def counted() -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            whole = pa.Table.from_batches(rows)
            rows.clear()
            sized = whole.filter(pc.is_null(whole["f"]))
            whole = whole.filter(pc.is_valid(whole["f"]))
            if not len(whole):
                return
            part = lambda rows, at, kind: np.concatenate([np.frombuffer(x, kind) for x in rows.column(at).to_pylist()])
            r, f, n, sizes, words, times = (part(whole, at, kind) for at, kind in enumerate((np.int64, np.int64, np.int64, np.int32, np.int64, np.int32), 1))
            known, chunks = part(sized, 1, np.int64), part(sized, 3, np.int64)
            by = np.argsort(known)
            n = chunks[by][np.searchsorted(known[by], r)] - n
            del whole, sized
            entry = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            _, first, word = np.unique(_mixed(words, r[entry]), return_index=True, return_inverse=True)
            df = np.bincount(word, weights=times, minlength=len(first)).astype(np.int64)
            every = df[word]
            rest, left = every - times, n[entry]
            raw = lambda x: np.log(np.maximum(left - x + 0.5, 0.5)) - np.log(x + 0.5)
            more = np.bincount(entry, weights=np.where(rest > 0, raw(rest), 0.0) - raw(every), minlength=len(sizes))
            gone = np.bincount(entry, weights=rest == 0, minlength=len(sizes)).astype(np.int32)
            found = [(_FILE, 0, f.tobytes(), more.tobytes(), gone.tobytes())]
            repo = r[entry[first]]
            order = np.lexsort((df, repo))
            repo, df, words = repo[order], df[order].astype(np.int32), words[first[order]]
            edges = [*np.flatnonzero(np.append(True, repo[1:] != repo[:-1])).tolist(), len(repo)]
            for a, z in zip(edges, edges[1:], strict=False):
                value, times = np.unique(df[a:z], return_counts=True)
                found.append((_HISTOGRAM, int(repo[a]), value.tobytes(), times.astype(np.int32).tobytes(), None))
                often = a + int(np.searchsorted(df[a:z], 2))
                found.append((_WORD, int(repo[a]), words[often:z].tobytes(), df[often:z].tobytes(), None))
            for row in found:
                yield pa.RecordBatch.from_pylist([dict(zip(("kind", "repo", "a", "b", "c"), row, strict=True))], pa.schema([("kind", pa.int32()), ("repo", pa.int64()), *((x, pa.binary()) for x in "abc")]))

        for batch in batches:
            of = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, z in zip(edges, edges[1:], strict=False):
                if a < z:
                    if of[a] != now:
                        yield from counted()
                        now = of[a]
                    rows.append(batch.slice(a, z - a))
        yield from counted()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_binary(batch.column(x).to_numpy(), np.array([len(batch)])) for x in range(2)], names=["r", "n"])

    packed = sizes.select("r", "n_repo").mapInArrow(pack, "r binary, n binary")
    each = packed.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "r", "n")
    every = dealt.where(F.col("bucket") != _FILES).unionByName(each, allowMissingColumns=True)
    return every.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(count, _STAT)


def _unpacked(stats: DataFrame, kind: int, kinds: list[type], result: str) -> DataFrame:
    """The packed rows of a kind, one by one, with their repository."""
    names = [x.split()[0] for x in result.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                columns = [np.frombuffer(row[x], t) for x, t in zip("abcde", kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), row["repo"])), *map(pa.array, columns)], names=names)

    return stats.where(F.col("kind") == kind).mapInArrow(rows, result)


class TermBlock:
    """Counted words of a block's texts, and the best of them for a query.

    Equal texts are one, at their first place. The rough score, in 32 bits and with the mean length of the first query, is a product with the matrix
    of frequent words and a sum over the postings of the others; what comes up to the k-th best but for the error is scored in double precision.
    """

    def __init__(self, held: pa.Array, book: np.ndarray, mean_length: float, k1: float, b: float, epsilon: float, digits: int, plain: int = PLAIN) -> None:
        self.k1, self.b, self.epsilon, self.digits, self.plain, self.mean_length = k1, b, epsilon, digits, plain, mean_length
        kinds = held.field("kind").to_numpy()
        of_kind = lambda k: held.filter(pa.array(kinds == k))
        rows = of_kind(_CHUNK)
        paths, numbers = rows.field("filepath").to_pylist(), rows.field("chunk_no").to_pylist()
        self.order = sorted(range(len(rows)), key=lambda i: (paths[i], numbers[i]))
        codes, code_at = _numbers_of(rows, "codes", np.uint16)
        others, other_at = _numbers_of(rows, "others", np.int64)
        times, time_at = _numbers_of(rows, "times", np.int32)
        seen: dict[bytes, int] = {}
        firsts: list[int] = []
        self.members: list[list[int]] = []
        of_path: dict[str, dict[int, int]] = {}
        for place, i in enumerate(self.order):
            digest = hashlib.blake2b(b"".join(x.tobytes() for x in (code_at[i + 1 : i + 2] - code_at[i], codes[code_at[i] : code_at[i + 1]], others[other_at[i] : other_at[i + 1]], times[time_at[i] : time_at[i + 1]])), digest_size=16).digest()
            at = seen.setdefault(digest, len(firsts))
            if at == len(firsts):
                firsts.append(i)
                self.members.append([])
            self.members[at].append(place)
            mine = of_path.setdefault(paths[i], {})
            mine[at] = mine.get(at, 0) + 1
        self.n, self.paths = len(firsts), [paths[i] for i in self.order]
        #: A file's chunks, and the texts that stand in no other.
        self.own = {p: (sum(mine.values()), np.array([at for at, n in mine.items() if n == len(self.members[at])], np.int64)) for p, mine in of_path.items()}
        del seen, of_path, paths, numbers

        # By text: codes, then the other words, as the counts are.
        pick = np.array(firsts, np.int64)
        n_codes, n_others = np.diff(code_at)[pick], np.diff(other_at)[pick]
        self.starts = np.append(0, np.cumsum(n_codes + n_others))
        self.ids = np.empty(self.starts[-1], np.int32)
        self.ids[_spans(self.starts[:-1], self.starts[:-1] + n_codes)] = codes[_spans(code_at[:-1][pick], code_at[1:][pick])]
        self.others, inverse = np.unique(others[_spans(other_at[:-1][pick], other_at[1:][pick])], return_inverse=True)
        self.ids[_spans(self.starts[:-1] + n_codes, self.starts[1:])] = inverse + CODES
        del inverse
        self.times = times[_spans(time_at[:-1][pick], time_at[1:][pick])]
        owner = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.starts))
        self.sizes = np.bincount(owner, weights=self.times, minlength=self.n)
        n_words = CODES + len(self.others)
        self.weight_of = np.zeros(n_words)
        counts = np.bincount(self.ids, minlength=n_words)
        self.df = (counts > 0).astype(np.int32)
        for x in of_kind(_COUNTS).to_pylist():
            words, df = np.frombuffer(x["others"], np.int64), np.frombuffer(x["times"], np.int32)
            at = self.place(book, words)
            self.df[at[at >= 0]] = df[at >= 0]
        means = of_kind(_MEANS).to_pylist()
        file, mean = (np.concatenate([np.empty(0, t), *(np.frombuffer(x[name], t) for x in means)]) for name, t in (("others", np.int64), ("times", np.float64)))
        by = np.argsort(file)
        self.files, self.means = file[by], mean[by]
        self.matrix = None
        if self.n <= plain:
            return

        # By word.
        by = np.argsort(self.ids, kind="stable")
        self.owner = owner[by]
        del owner
        self.impact = self.times[by].astype(np.float32)
        del by
        self.impact *= np.float32(k1 + 1) / (self.impact + (k1 * (1 - b + b * self.sizes / mean_length)).astype(np.float32)[self.owner])
        self.first = np.append(0, np.cumsum(counts))
        frequent = np.argsort(-counts, kind="stable")[:DENSE_WORDS]
        frequent = frequent[counts[frequent] > DENSE * self.n]
        self.row = np.full(n_words, -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.width = -(-self.n // 64) * 64
        self.matrix = np.zeros((max(len(frequent), 1), self.width), np.float32)
        for k, word in enumerate(frequent.tolist()):
            self.matrix[k, self.owner[self.first[word] : self.first[word + 1]]] = self.impact[self.first[word] : self.first[word + 1]]

    def place(self, book: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Numbers of words in this block, -1 for others."""
        code, known = _codes(book, words)
        at = self.other_place(words)
        return np.where(known, code, at)

    def other_place(self, words: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.others, words)
        same = self.others[np.minimum(at, len(self.others) - 1)] == words if len(self.others) else np.zeros(len(words), bool)
        return np.where(same, at + CODES, -1)

    def scores(self, texts: np.ndarray, ids: np.ndarray, weights: np.ndarray, mean_length: float) -> np.ndarray:
        self.weight_of[ids] = weights
        at = _spans(self.starts[texts], self.starts[texts + 1])
        owner = np.repeat(np.arange(len(texts)), np.diff(self.starts)[texts])
        weight = self.weight_of[self.ids[at]]
        self.weight_of[ids] = 0.0
        hit = np.flatnonzero(weight)
        owner, times = owner[hit], self.times[at[hit]].astype(np.float64)
        share = weight[hit] * times * (self.k1 + 1) / (times + self.k1 * (1 - self.b + self.b * self.sizes[texts][owner] / mean_length))
        return np.round(np.bincount(owner, weights=share, minlength=len(texts)), self.digits) + 0.0

    def weighed(self, asked: pa.Array, means: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of this block, their weights in the score, and where each query's begin."""
        codes, code_at = _numbers_of(asked, "codes", np.uint16)
        others, other_at = _numbers_of(asked, "others", np.int64)
        levels, level_at = _numbers_of(asked, "levels", np.float64)
        level, starts = _numbers_of(asked, "level", np.int32)
        less, _ = _numbers_of(asked, "less", np.int32)
        n_codes = np.diff(code_at)
        ids = np.empty(len(level), np.int64)
        ids[_spans(starts[:-1], starts[:-1] + n_codes)] = codes
        ids[_spans(starts[:-1] + n_codes, starts[1:])] = self.other_place(others)
        query = _owners(starts)
        df = (self.df[ids] - less).astype(np.float64)
        kept = np.flatnonzero((ids >= 0) & (df > 0))
        ids, query, df, weight = ids[kept], query[kept], df[kept], levels[level_at[query] + level][kept]
        raw = np.log(np.maximum(asked.field("n").to_numpy()[query] - df + 0.5, 0.5)) - np.log(df + 0.5)
        weight = weight * np.where(raw < 0, self.epsilon * means[query], raw)
        return ids, weight, np.append(0, np.cumsum(np.bincount(query, minlength=len(asked))))

    def best(self, asked: pa.Array, k: int) -> Iterator[tuple[list[int], list[float]]]:
        """Places and scores of each query's k best chunks of other files."""
        # A file without a mean leaves no word to its queries.
        at = np.searchsorted(self.files, file := asked.field("file").to_numpy()).clip(0, max(len(self.files) - 1, 0))
        means = np.where(self.files[at] == file, self.means[at], 0.0) if len(self.files) else np.zeros(len(asked))
        ids, weights, starts = self.weighed(asked, means)
        lengths, paths = asked.field("avg_len").to_numpy(), asked.field("filepath").to_pylist()
        nothing = np.empty(0, np.int64)
        if self.matrix is not None:
            row, query = self.row[ids], _owners(starts)
            posted, dense = row < 0, np.zeros((len(asked), len(self.matrix)), np.float32)
            dense[query[~posted], row[~posted]] = weights[~posted]
            rough = np.empty((len(asked), self.width), np.float32)
            for a in range(0, self.width, 4096):
                np.matmul(dense, self.matrix[:, a : a + 4096], out=rough[:, a : a + 4096])
        for q, path in enumerate(paths):
            n_own, own = self.own.get(path, (0, nothing))
            a, z = starts[q], starts[q + 1]
            off = abs(lengths[q] / self.mean_length - 1)
            texts = None
            if a == z:
                texts = np.arange(min(self.n, k + n_own + len(own)))
                value = np.zeros(len(texts))
            elif self.matrix is not None and means[q] >= 0 and off < 0.2:
                score = rough[q]
                mine = posted[a:z]
                word, weight = ids[a:z][mine], weights[a:z][mine]
                low, high = self.first[word], self.first[word + 1]
                if len(word):
                    spans = [slice(x, y) for x, y in zip(low.tolist(), high.tolist(), strict=True)]
                    share = np.concatenate([self.impact[x] for x in spans])
                    share *= np.repeat(weight.astype(np.float32), high - low)
                    score[: self.n] += np.bincount(np.concatenate([self.owner[x] for x in spans]), weights=share, minlength=self.n)
                score[self.n :] = -np.inf
                score[own] = -np.inf
                groups = score.reshape(64, -1)
                most = groups.max(0)
                least = float(np.partition(most, -k)[-k]) if len(most) >= k else -np.inf
                least -= least * (ROUGH + 4 * off) + ROUGH_LEAST
                if least > ROUGH_LEAST:
                    at = np.flatnonzero(most >= least)
                    some, group = np.nonzero(groups[:, at] >= least)
                    texts = np.sort(some * groups.shape[1] + at[group])
                    value = self.scores(texts, ids[a:z], weights[a:z], lengths[q])
            if texts is None:
                texts = np.arange(self.n)
                value = self.scores(texts, ids[a:z], weights[a:z], lengths[q])
            if len(own):
                texts, value = texts[left := ~np.isin(texts, own)], value[left]
            if len(texts) > k:
                # Of equal scores as many texts, in order of their first places, as surely hold the first k chunks.
                least = np.partition(value, -k)[-k]
                chosen = np.append(np.flatnonzero(value > least), np.flatnonzero(value == least)[: k + n_own])
                texts, value = texts[chosen], value[chosen]
            found = []
            for text, score in zip(texts.tolist(), value.tolist(), strict=True):
                found += [(-score, x) for x in self.members[text][: k + n_own] if self.paths[x] != path]
            found.sort()
            yield [x for _, x in found[:k]], [-x for x, _ in found[:k]]


def rank_words(rows: DataFrame, k: int, digits: int = 6, k1: float = K1, b: float = B, epsilon: float = EPSILON, block: int = TERM_BLOCK, slice_rows: int = TERM_SLICE) -> DataFrame:
    """Top k of `bm25` where the candidates are all chunks of the repository's other files: task_id, filepath, chunk_no, score, rank.

    rows: repo, filepath, chunks (array of structs chunk_no, words), asked (array of structs task_id, terms, weights); one row a file, words and terms
    as hashes; n_asked spares asked where queries are only counted. Rows are read twice. First, words are counted in buckets, over the whole table: counts of a repository less those of the own
    file give each task's document frequencies, a histogram of them with what the own file's words change its mean inverse frequency. Then
    queries travel with the weights and the own file's counts of their words only, as codes where a small job's book has them, and meet the
    chunks in blocks, to which each word's count comes once.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "bm25")
    keys = F.xxhash64("repo").alias("r"), F.xxhash64("repo", "filepath").alias("f")
    sets = rows.select("filepath", F.array_distinct(F.flatten(F.transform("chunks", lambda c: c["words"]))).alias("words"))
    book = _codebook(sets)
    usual = sets.where(F.pmod(F.xxhash64("filepath"), F.lit(CODE_SAMPLE)) == 0).agg(F.avg(F.size("words"))).first()[0] or 256
    buckets = max(spark.sparkContext.defaultParallelism, int(rows.count() * usual / COUNTED) + 1)
    dealt = scratch.keep(_dealt(rows.select(*keys, "chunks", (F.col("n_asked") if "n_asked" in rows.columns else F.size("asked")).alias("asked")), buckets), "dealt", "zstd")
    files = _unpacked(dealt.where(F.col("bucket") == _FILES).select(F.lit(_FILES).alias("kind"), F.lit(0).cast("long").alias("repo"), F.col("r").alias("a"), F.col("f").alias("b"), F.col("n").alias("c"), F.col("sizes").alias("d"), F.col("words").alias("e")), _FILES, [np.int64, np.int64, np.int64, np.int32, np.int64], "repo long, r long, f long, n_file long, asked int, len long")
    files = scratch.keep(files.drop("repo"), "files")
    sizes = files.groupBy("r").agg(F.sum("n_file").alias("n_repo"), F.sum("len").alias("len_repo"), F.sum("asked").alias("asked")).where("n_repo > 0 AND asked > 0")
    part = lambda n, most, name: F.ceil(F.col(n) / F.lit(most)).cast("int").alias(name)
    sizes = scratch.keep(sizes.select("r", "n_repo", "len_repo", part("n_repo", block, "blocks"), part("asked", slice_rows, "slices")), "sizes")
    stats = scratch.keep(_word_statistics(dealt, files.groupBy("r").agg(F.sum("n_file").alias("n_repo")), buckets), "stats", "zstd")
    scratch.drop("dealt")

    # The mean over all words of the repository, once for each number of chunks left; then what a left-out file's own words change.
    # A word of more chunks than are left stands in that file, which takes out what was put in for it.
    raw = lambda df: F.ln(F.greatest(F.col("n") - df + 0.5, F.lit(0.5))) - F.ln(df + 0.5)
    histogram = _unpacked(stats, _HISTOGRAM, [np.int32, np.int32], "r long, df int, terms int").groupBy("r", "df").agg(F.sum("terms").alias("terms"))
    files = files.where("asked > 0").join(sizes, "r").select("r", "f", (F.col("n_repo") - F.col("n_file")).cast("double").alias("n"))
    every = files.select("r", "n").distinct().join(histogram, "r").groupBy("r", "n").agg(F.sum(F.col("terms") * raw(F.col("df"))).alias("raws"), F.sum("terms").alias("terms"))
    change = _unpacked(stats, _FILE, [np.int64, np.float64, np.int32], "r long, f long, more double, gone int").groupBy("f").agg(F.sum("more").alias("more"), F.sum("gone").alias("gone"))
    left = files.join(every, ["r", "n"]).join(change, "f", "left").withColumn("left", F.col("terms") - F.coalesce("gone", F.lit(0)))
    mean = left.where("left > 0").select("r", "f", ((F.col("raws") + F.coalesce("more", F.lit(0.0))) / F.col("left")).alias("mean"))
    means = scratch.keep(mean, "means")
    scratch.drop("files")

    row = "kind int, filepath string, chunk_no int, codes binary, others binary, times binary"
    task = rows.schema["asked"].dataType.elementType["task_id"].dataType.simpleString()
    query = f"task_id {task}, filepath string, file long, n long, len long, codes binary, others binary, levels binary, level binary, less binary"
    names, query_names = ([x.split()[0] for x in fields.split(", ")] for fields in (row, query))
    result = f"r long, c struct<{row.replace(' ', ': ').replace(',:', ',')}>, q struct<{query.replace(' ', ': ').replace(',:', ',')}>"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, numbers, words, starts = _chunks_of(batch.column("chunks"))
            own_times, own_keys = _file_counts(offsets, words, starts)[2:]
            own = np.diff(offsets), np.diff(starts[offsets])
            chunk, file, n = _owners(starts), _owners(offsets), len(numbers)
            _, first, times = np.unique(_mixed(words, chunk), return_index=True, return_counts=True)
            # Words in an order of their own, so that equal texts have equal rows.
            words, chunk = words[first], chunk[first]
            by = np.argsort(words, kind="stable")
            words, chunk, times = words[by], chunk[by], times[by].astype(np.int32)
            place, known = _codes(book, words)
            columns = [pa.array(np.zeros(n, np.int32)), batch.column("filepath").take(pa.array(file)), pa.array(numbers, pa.int32()), *_packed(known, n, chunk, place, words, times)]
            held = pa.StructArray.from_arrays(columns, names)

            asked = batch.column("asked")
            at = asked.offsets.to_numpy()
            inner, file_of = asked.values.slice(at[0], at[-1] - at[0]), _owners(at)
            n_asked = len(inner)
            words, starts = _flat(inner.field("terms"))
            weights, _ = _flat(inner.field("weights"))
            _, first, inverse = np.unique(_mixed(words, owner := _owners(starts)), return_index=True, return_inverse=True)
            words, owner, weights = words[first], owner[first], np.bincount(inverse, weights=weights, minlength=len(first))
            mine = _mixed(words, file_of[owner])
            at = np.searchsorted(own_keys, mine)
            same = own_keys[np.minimum(at, len(own_keys) - 1)] == mine if len(own_keys) else np.zeros(len(mine), bool)
            less = np.zeros(len(mine), np.int32)
            less[same] = own_times[at[same]]
            # Few weights differ in a query.
            by = np.lexsort((weights, owner))
            new = np.append(True, (weights[by][1:] != weights[by][:-1]) | (owner[by][1:] != owner[by][:-1])) if len(by) else np.zeros(0, bool)
            levels, n_levels = weights[by][new], np.bincount(owner[by][new], minlength=n_asked)
            level = np.empty(len(by), np.int32)
            level[by] = np.cumsum(new) - 1 - (np.cumsum(n_levels) - n_levels)[owner[by]]
            place, known = _codes(book, words)
            codes, others, level, less = _packed(known, n_asked, owner, place, words, level, less)
            whole = [batch.column(x).take(pa.array(file_of)) for x in ("filepath", "f")]
            columns = [inner.field("task_id"), *whole, *(pa.array(x[file_of], pa.int64()) for x in own), codes, others, _binary(levels, n_levels), level, less]
            asks = pa.StructArray.from_arrays(columns, query_names)
            yield pa.RecordBatch.from_arrays([batch.column("r").take(pa.array(file)), held, pa.nulls(n, asks.type)], names=["r", "c", "q"])
            yield pa.RecordBatch.from_arrays([batch.column("r").take(pa.array(file_of)), pa.nulls(n_asked, held.type), asks], names=["r", "c", "q"])

    def code_means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repo, of = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            order, n = np.argsort(of, kind="stable"), np.bincount(of, minlength=len(repo))
            columns = [pa.array(repo), pa.array(np.full(len(repo), _MEANS, np.int32)), *(_binary(batch.column(x).to_numpy()[order], n) for x in (1, 2))]
            yield pa.RecordBatch.from_arrays(columns, names=["r", "kind", "a", "b"])

    coded = rows.select(*keys, "filepath", "chunks", "asked").mapInArrow(code, result)
    dfs = stats.where(F.col("kind") == _WORD).select(F.col("repo").alias("r"), F.lit(_COUNTS).alias("kind"), "a", "b")
    shared = dfs.unionByName(means.select("r", "f", "mean").mapInArrow(code_means, "r long, kind int, a binary, b binary"))
    fields = {"kind": F.col("kind"), "others": F.col("a"), "times": F.col("b")}
    kinds = dict(x.split() for x in row.split(", "))
    shared = shared.select("r", F.struct(*(fields.get(n, F.lit(None).cast(kinds[n])).alias(n) for n in names)).alias("c"))

    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one = lambda column, n: F.array(F.pmod(F.xxhash64(column), F.col(n)).cast("int"))
    asks, whole = F.col("q").isNotNull(), F.coalesce(F.col("c.kind"), F.lit(0)) != 0
    place = F.when(asks | whole, every("blocks")).otherwise(one("c", "blocks")), F.when(asks, one("q", "slices")).otherwise(every("slices"))
    both = coded.unionByName(shared, allowMissingColumns=True).join(F.broadcast(sizes) if sizes.count() <= MANY else sizes, "r")
    left = F.col("n_repo") - F.col("q.n")
    q = F.when(asks, F.col("q").withField("avg_len", F.coalesce(F.nullif((F.col("len_repo") - F.col("q.len")) / F.nullif(left, F.lit(0)), F.lit(0.0)), F.lit(1.0))).withField("n", left.cast("double")))
    both = both.select("r", F.explode(place[0]).alias("block"), place[1].alias("slices"), asks.alias("asks"), "c", q.alias("q")).select("r", "block", F.explode("slices").alias("slice"), "asks", "c", "q")

    def best(held: pa.Array, some_asked: Iterator[pa.Array]) -> Iterator[pa.RecordBatch]:
        texts = None
        for some in some_asked:
            if texts is None:
                texts = TermBlock(held, book, float(np.median(some.field("avg_len").to_numpy())), k1, b, epsilon, digits)
                chunk = held.filter(pa.array(held.field("kind").to_numpy() == _CHUNK))
                path, number, order = chunk.field("filepath"), chunk.field("chunk_no"), np.array(texts.order, np.int64)
                del held, chunk
            for a in range(0, len(some), AT_ONCE):
                part = some.slice(a, AT_ONCE)
                found = list(texts.best(part, k))
                which = pa.array(order[np.array([x for places, _ in found for x in places], np.int64)])
                task = pa.array(np.repeat(np.arange(len(part)), [len(places) for places, _ in found]))
                yield pa.RecordBatch.from_arrays([part.field("task_id").take(task), path.take(which), number.take(which), pa.array([x for _, values in found for x in values], pa.float64())], names=["task_id", "filepath", "chunk_no", "score"])

    found = _met(both.select(F.xxhash64("r", "block", "slice").alias("task"), "asks", "c", "q"), best, f"task_id {task}, filepath string, chunk_no int, score double")
    return top_k(found, k, [F.desc("score"), F.col("filepath"), F.col("chunk_no")])


def word_hashes(text: Column) -> Column:
    return F.transform(tx.word_tokens(text), lambda w: F.xxhash64(w))


def rank_bm25(query_terms: DataFrame, tasks: DataFrame, chunks: DataFrame, k: int, digits: int = 6, k1: float = K1, b: float = B, epsilon: float = EPSILON, block: int = TERM_BLOCK, slice_rows: int = TERM_SLICE) -> DataFrame:
    """`rank_words` of other forms: query_terms (task_id, term, weight), tasks (task_id, repo, filepath), chunks (repo, filepath, chunk_no, tokens)."""
    each = F.struct(F.col("chunk_no").cast("int").alias("chunk_no"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("words"))
    held = chunks.groupBy("repo", "filepath").agg(F.collect_list(each).alias("chunks"))
    terms = query_terms.groupBy("task_id").agg(F.collect_list(F.struct(F.xxhash64("term").alias("term"), F.col("weight").cast("double").alias("weight"))).alias("t"))
    part = lambda name, kind: F.coalesce(F.transform("t", lambda x: x[name]), F.array().cast(f"array<{kind}>")).alias(name + "s")
    asked = tasks.select("task_id", "repo", "filepath").join(terms, "task_id", "left").select("repo", "filepath", F.struct("task_id", part("term", "bigint"), part("weight", "double")).alias("q"))
    asked = asked.groupBy("repo", "filepath").agg(F.collect_list("q").alias("asked"))
    rows = held.join(asked, ["repo", "filepath"], "full")
    rows = rows.select("repo", "filepath", *(F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c) for c in ("chunks", "asked")))
    return rank_words(rows, k, digits, k1, b, epsilon, block, slice_rows)


def with_neighbours(chunks: DataFrame) -> DataFrame:
    """chunks with next_text and previous_text of the same file, the own text where there is none."""
    w = Window.partitionBy("repo", "filepath").orderBy("chunk_no")
    return chunks.withColumns({"next_text": F.coalesce(F.lead("text").over(w), F.col("text")), "previous_text": F.coalesce(F.lag("text").over(w), F.col("text"))})


def files_within(queries: DataFrame, files: DataFrame, distance: int = 100, most: int = 1000) -> DataFrame:
    """(task_id, repo, filepath, distance, place): the nearest other files of the repository, by distance, then path.

    Distances are between directories, and each directory orders the files near it once, for all tasks in it.
    """
    folder = lambda c: F.regexp_replace(c, "[^/]*$", "")
    f = files.select("repo", "filepath").distinct().withColumn("folder", folder(F.col("filepath")))
    asked = queries.select("task_id", "repo", F.col("filepath").alias("own"), folder(F.col("filepath")).alias("from"))
    here, there = asked.select("repo", "from").distinct(), f.select("repo", "folder").distinct()
    # A name behind each folder stands for its files: all are as many separators away.
    apart = here.join(there, "repo").withColumn("distance", tx.path_distance(F.concat("from", F.lit("\x01a")), F.concat("folder", F.lit("\x01b")))).where(F.col("distance").between(0, distance))
    order = Window.partitionBy("repo", "from").orderBy("distance", "filepath")
    near = apart.join(f, ["repo", "folder"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most + 1).select("repo", "from", "filepath", "distance", "place")
    mine = asked.join(near.select("repo", "from", F.col("filepath").alias("own"), F.col("place").alias("own_place")), ["repo", "from", "own"], "left")
    each = mine.join(near, ["repo", "from"]).where("filepath <> own")
    place = F.col("place") - F.when(F.col("own_place") < F.col("place"), 1).otherwise(0)
    return each.withColumn("place", place).where(F.col("place") <= most).select("task_id", "repo", "filepath", "distance", "place")


def first_candidates(near: DataFrame, chunks: DataFrame, most: int = 1000) -> DataFrame:
    """The first chunks in file order of each task's files, with `place`: near is of `files_within`.

    Counts of files are added up first; only the files that hold the first chunks meet their chunks.
    """
    numbered = chunks.withColumn("nth", F.row_number().over(Window.partitionBy("repo", "filepath").orderBy("chunk_no")))
    sizes = chunks.groupBy("repo", "filepath").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("task_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    each = near.select("task_id", "repo", "filepath", "place").join(sizes, ["repo", "filepath"]).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < most)
    placed = each.drop("place", "n").join(numbered, ["repo", "filepath"]).withColumn("place", (F.col("before") + F.col("nth")).cast("int"))
    return placed.where(F.col("place") <= most).drop("before", "nth")


def distinct_texts(selected: DataFrame, text: str = "text") -> DataFrame:
    """Of equal texts of a task the one of best rank."""
    w = Window.partitionBy("task_id", text).orderBy("rank")
    return selected.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


#: The lines that head a context and each of its fragments.
CONTEXT_HEAD = "Here are some relevant code fragments from other files of the repo:"
FRAGMENT_HEAD = "the below code fragment can be found in:"


def context_text(selected: DataFrame, sign: Column | str = "#") -> DataFrame:
    """(task_id, crossfile_context): the fragments by rank, each line a comment. selected: task_id, rank, filepath, text."""
    s = F.lit(sign) if isinstance(sign, str) else sign
    body = F.regexp_replace(F.col("text"), r"^\n+|\n+$", "")
    lines = F.transform(F.split(body, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"), lambda x: F.concat(s, F.lit(" "), x))
    part = F.concat(s, F.lit(f" {FRAGMENT_HEAD}\n"), s, F.lit(" "), F.col("filepath"), F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n\n"))
    parts = selected.select("task_id", "rank", part.alias("part"), s.alias("sign"))
    joined = parts.groupBy("task_id", "sign").agg(F.array_sort(F.collect_list(F.struct("rank", "part"))).alias("p"))
    return joined.select("task_id", F.concat(F.col("sign"), F.lit(f" {CONTEXT_HEAD}\n\n"), F.array_join(F.transform("p", lambda x: x["part"]), "")).alias("crossfile_context"))


#: Name -> score of (query text, chunk text) columns, for given pairs; register to extend.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {
    "jaccard_sim": lambda q, c: scores.jaccard(word_ids(q), word_ids(c)),
    "containment": lambda q, c: scores.containment(word_ids(q), word_ids(c)),
    "edit_similarity": scores.edit_similarity,
    "weighted_ngram_match_score": lambda q, c: python_code.weighted_ngram_match(c, q),
}
#: Names that `attach_context` ranks by BM25: weight of the query's lines (none: the whole query).
BM25 = {"bm25": None, "bm25_lines": 0, "bm25_weighted_v1": 1, "bm25_weighted_v2": 2}


def having_context(tasks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(task_id) of the tasks whose repository has a chunk in another file, by counts of files."""
    f = chunks.select("repo", "filepath").distinct()
    counts = f.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    own = f.withColumn("own", F.lit(1))
    each = tasks.select("task_id", "repo", "filepath").join(counts, "repo").join(own, ["repo", "filepath"], "left")
    return each.where(F.col("n") > F.coalesce("own", F.lit(0))).select("task_id")


def retrieval_status(tasks: DataFrame, files: DataFrame, contexts: DataFrame) -> DataFrame:
    """(task_id, status): project_not_found, file_not_found_in_project, no_crossfile_context or success."""
    repos = files.select("repo").distinct().withColumn("has_repo", F.lit(True))
    own = files.select("repo", "filepath").distinct().withColumn("has_file", F.lit(True))
    found = contexts.select("task_id").distinct().withColumn("has_context", F.lit(True))
    each = tasks.select("task_id", "repo", "filepath").join(repos, "repo", "left").join(own, ["repo", "filepath"], "left").join(found, "task_id", "left")
    status = F.when(F.col("has_repo").isNull(), "project_not_found").when(F.col("has_file").isNull(), "file_not_found_in_project").when(F.col("has_context").isNull(), "no_crossfile_context").otherwise("success")
    return each.select("task_id", status.alias("status"))


def _unit_rows(lists: pa.Array) -> np.ndarray:
    values, _ = _flat(lists)
    rows = values.astype(np.float64).reshape(len(lists), -1)
    size = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, size, out=np.full_like(rows, np.nan), where=size > 0)


def rank_vectors(queries: DataFrame, docs: DataFrame, k: int, block: int = BLOCK, slice_rows: int = SLICE) -> DataFrame:
    """Top k by cosine of vectors of one length: task_id, doc_id, score, rank. queries: task_id, repo, vector; docs: doc_id, repo, vector; same ids are passed over.

    Unit vectors meet in blocks by matrix products; the cosines of the best are then taken row by row, so equal vectors tie, and
    ties go to the smaller id. A zero vector's cosine is null, last in order.
    """
    q = queries.select("repo", F.struct("task_id", "vector").alias("q"))
    d = docs.select("repo", F.struct("doc_id", "vector").alias("c"))

    def best(held: pa.Array, asked: Iterator[pa.Array]) -> Iterator[pa.RecordBatch]:
        ids = held.field("doc_id").to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        ids, matrix = ids[order], _unit_rows(held.field("vector"))[order]
        for whole in asked:
            for at in range(0, len(whole), 256):
                some = whole.slice(at, 256)
                tasks, own = some.field("task_id"), _unit_rows(some.field("vector"))
                rough = np.nan_to_num(own @ matrix.T, nan=-2.0)
                rows: list[list] = [[], [], []]
                for n, task in enumerate(tasks.to_pylist()):
                    value = np.where(ids == task, -9.0, rough[n])
                    least = np.partition(value, -k)[-k] if len(value) > k else -8.0
                    able = np.flatnonzero((value >= least - 1e-9) & (value > -8.0))
                    exact = (matrix[able] * own[n]).sum(1)
                    chosen = _best_k(np.nan_to_num(exact, nan=-2.0), k)
                    for column, more in zip(rows, ([task] * len(chosen), ids[able[chosen]].tolist(), exact[chosen].tolist()), strict=True):
                        column += more
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], tasks.type), pa.array(rows[1], held.field("doc_id").type), pa.array(rows[2], pa.float64(), from_pandas=True)], names=["task_id", "doc_id", "score"])

    kinds = [t.schema[n].dataType.simpleString() for t, n in ((queries, "task_id"), (docs, "doc_id"))]
    found = in_blocks(q, d, best, f"task_id {kinds[0]}, doc_id {kinds[1]}, score double", block, slice_rows)
    return top_k(found, k, [F.desc_nulls_last("score"), F.col("doc_id")])
