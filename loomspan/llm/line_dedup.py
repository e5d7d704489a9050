"""Fuzzy line dedup by MinHash.

A line's 8-character shingles give one MinHash value for each of 40 bins of one permutation; 10 bands of 4 bins route the
line, with a sketch of a bit for each bin. Lines that share a band and whose sketches can't rule out the
similarity are candidates; families of candidates meet with their texts, which a filter of fixed size picks as lines are
listed, and there exact Jaccard decides and a union-find links. Spark joins the links to components; of each component's lines the first by document and line number stays.

Equal lines have one id (a 63-bit hash of the trimmed line), so a line that stands in a third of all documents travels
once for each task that read it. A pair at the threshold 0.8 misses all bands with a chance of 0.5 %, at 0.9 of 2e-5.

A line under 8 characters is one shingle, which no other line has: equal ones repeat, and it needs no bands.

Defined results: blank lines are no lines to compare and stay; a null text stays null;
rows of one id and one text are copies of one row: what goes from one goes from the other; rows of one id with different
texts are documents of their own, their lines ordered by line number, then by a hash of the text; so no ties are left; an
empty table gives none; with a null id nothing goes. Other columns are kept by `without_lines`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm._families import BLOCK, family_links, groups
from loomspan.llm._shared import Scratch, components, mix64, spread

CHARS = 8
NUM, DEN = 80, 100
BANDS, ROWS = 10, 4
BINS = BANDS * ROWS
#: Of the sketch's bits so many may differ. Expected at the threshold: 4 (standard deviation 1.9); at random: 20 (3.2).
MOST_DIFFERENT = 13
#: Characters hashed at a time; arrays of this length stay in the cache.
CHUNK = 1 << 17
_B = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint32(0xFFFFFFFF)


def _rolled(codes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of 8 code points, by doubling."""
    h = mix64(codes.astype(np.uint64) + _B)
    base = int(_B)
    for k in (1, 2, 4):
        h = h[:-k] * np.uint64(base) + h[k:]
        base = base * base % 2**64
    return mix64(h)


def char_shingles(line: str) -> np.ndarray:
    """Sorted distinct hashes of the trimmed line's runs of 8 characters; a shorter line is one."""
    line = line.strip()
    codes = np.frombuffer(line.encode("utf-32-le", "replace"), np.uint32)
    if len(codes) < CHARS:
        return np.array([xxhash.xxh3_64_intdigest(line.encode("utf-8", "replace"))], np.uint64) if len(codes) else np.empty(0, np.uint64)
    return np.unique(_rolled(codes))


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "replace")) & (2**63 - 1)


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """Number and trimmed text of each line that isn't blank."""
    return [(k, line) for k, line in enumerate(map(str.strip, (text or "").split("\n"))) if line]


def sketches(lines: list[str], wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (line, band) and a sketch of 40 bits for each line, of 8 characters or more; `wide` adds ten bands that deal the bins otherwise."""
    n = len(lines)
    least = np.full(n * BINS, _EMPTY, np.uint32)
    lengths = np.array([len(x) for x in lines])
    at = 0
    while at < n:
        to = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:] + 1), CHUNK)))
        h = _rolled(np.frombuffer("\n".join(lines[at:to]).encode("utf-32-le", "replace"), np.uint32))
        own = np.repeat(np.arange(at, to), lengths[at:to] + 1)[: len(h)]
        starts = np.cumsum(np.concatenate([[0], lengths[at:to] + 1]))
        inside = np.arange(len(h)) + CHARS <= (starts[1:] - 1)[own - at]
        cell = own * BINS + (((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(least, cell[inside], h[inside].astype(np.uint32))
        at = to
    least = least.reshape(n, BINS)
    filled = least.astype(np.uint64)
    empty = least == _EMPTY
    for step in range(1, BINS):  # an empty bin takes the next full one's value, marked by the distance
        if not empty.any():
            break
        ahead = np.roll(least, -step, axis=1)
        use = empty & (ahead != _EMPTY)
        filled[use] = ahead[use].astype(np.uint64) + (np.uint64(step) << np.uint64(32))
        empty &= ~use
    mixed = mix64(filled + np.arange(BINS, dtype=np.uint64) * _B)
    keys = np.zeros((n, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64) * _B
    for r in range(ROWS):
        keys = mix64(keys * _B + mixed[:, r::ROWS])
    if wide:
        more = np.zeros((n, BANDS), np.uint64) + np.arange(BANDS, 2 * BANDS, dtype=np.uint64) * _B
        for r in range(ROWS):
            more = mix64(more * _B + mixed[:, r * BANDS : (r + 1) * BANDS])
        keys = np.concatenate([keys, more], axis=1)
    bits = ((mixed >> np.uint64(40)) & np.uint64(1)) << np.arange(BINS, dtype=np.uint64)
    return keys.view(np.int64), bits.sum(1, dtype=np.uint64).view(np.int64)


#: A band's row in a bucket: the low half of its key, the line's id, the sketch's 40 bits.
_BAND = np.dtype([("key", "<u4"), ("id", "<i8"), ("low", "<u4"), ("high", "u1")])
#: A key's high bits name its bucket: 4,096 buckets, whose rows a task holds one bucket at a time. Rows a task packs at once.
BUCKET_BITS = 12
PACKED = 1 << 19


def _packed(keys: np.ndarray, ids: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
    """(bucket, rows) of band keys (line, band): a bucket's rows as bytes, so that JVM and shuffle see few rows."""
    flat = keys.view(np.uint64).ravel()
    bucket = (flat >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    line, words = order // BANDS, words.view(np.uint64)
    rows = np.empty(len(flat), _BAND)
    rows["key"], rows["id"] = flat[order].astype(np.uint32), ids[line]
    rows["low"], rows["high"] = words[line].astype(np.uint32), (words[line] >> np.uint64(32)).astype(np.uint8)
    counts = np.bincount(bucket, minlength=1 << BUCKET_BITS)
    some = np.flatnonzero(counts)
    ends = (np.append(0, np.cumsum(counts[some])) * _BAND.itemsize).astype(np.int32)
    blobs = pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(rows.view(np.uint8))])
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), blobs], names=["bucket", "rows"])


def _bands(docs: DataFrame) -> DataFrame:
    """(bucket, rows) of the bands of each line that a task sees for the first time."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                new: dict[int, str] = {}
                for text in batch.column(0).slice(at, 512).to_pylist():
                    for _, line in lines_of(text):
                        if len(line) >= CHARS and (k := line_id(line)) not in seen:
                            seen.add(k)
                            new[k] = line
                if new:
                    keys, words = sketches(list(new.values()))
                    held.append((keys, np.fromiter(new, np.int64, len(new)), words))
                if sum(keys.size for keys, _, _ in held) > PACKED:
                    yield _packed(*map(np.concatenate, zip(*held, strict=True)))
                    held.clear()
        if held:
            yield _packed(*map(np.concatenate, zip(*held, strict=True)))

    return docs.select("text").mapInArrow(cut, "bucket int, rows binary")


def near_in_band(ids: np.ndarray, words: np.ndarray) -> set[tuple[int, int]]:
    """Pairs that span what sketches hold together: each reached line seeks those not yet reached."""
    ids, first = np.unique(ids, return_index=True)
    bits = words[first].view(np.uint64)
    pairs, left = set(), np.arange(len(ids))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            k = queue.pop()
            near = np.bitwise_count(bits[left] ^ bits[k]) <= MOST_DIFFERENT
            for j in left[near].tolist():
                pairs.add((int(ids[k]), int(ids[j])))
                queue.append(j)
            left = left[~near]
    return pairs


def _pairs_of_bucket(rows: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs (pair, 2) of the lines that share a band and whose sketches can't rule out the similarity."""
    rows = rows[np.lexsort((rows["id"], rows["key"]))]
    key, ids = rows["key"], rows["id"]
    rows = rows[np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]))]
    key, ids = rows["key"], np.ascontiguousarray(rows["id"])
    words = rows["low"].astype(np.uint64) | (rows["high"].astype(np.uint64) << np.uint64(32))
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    two = starts[sizes == 2]  # most bands that meet hold two lines
    near = two[np.bitwise_count(words[two] ^ words[two + 1]) <= MOST_DIFFERENT]
    yield np.stack([ids[near], ids[near + 1]], axis=1)
    for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        if found := near_in_band(ids[at : at + n], words[at : at + n]):
            yield np.array(list(found), np.int64)


def _candidates(bands: DataFrame) -> DataFrame:
    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def distinct() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(held), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"])

        for table in groups(batches, "bucket"):
            held += _pairs_of_bucket(np.frombuffer(b"".join(table["rows"].to_pylist()), _BAND))
            if sum(map(len, held)) > 100_000:
                yield distinct()
                held.clear()
        if held:
            yield distinct()

    return bands.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(traverse, "a long, b long")


#: Bits of the filter that finds the lines of families, at most: 4 MB. Beyond some millions of lines it lets more lines through, which a join drops.
FILTER_BITS = 25


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit for each value of the ids' (column i) low bits, as 64-bit words."""
    bits = 1 << min(FILTER_BITS, max(16, (16 * ids.count()).bit_length()))
    found = ids.groupBy(F.expr(f"shiftrightunsigned(i & {bits - 1}L, 6)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(i & 63 AS INT)))").alias("word")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found["at"].to_numpy()] = found["word"].to_numpy()
    return words.view(np.uint64)


def _may_hold(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    low = ids & (len(words) * 64 - 1)
    return (words[low >> 6] >> (low & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _occurrences(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(doc, line, copy, id, text) of each line; a task gives the text of a line that `wanted` may hold, once."""

    def list_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [(doc, k, copy, line) for doc, copy, text in zip(*(c.to_pylist() for c in part.columns), strict=True) if doc is not None for k, line in lines_of(text)]
                if not rows:
                    continue
                doc, line, copy, text = zip(*rows, strict=True)
                ids = np.fromiter(map(line_id, text), np.int64, len(text))
                shown: list[str | None] = [None] * len(text)
                for k in np.flatnonzero(_may_hold(wanted, ids)).tolist():
                    if (i := int(ids[k])) not in seen:
                        seen.add(i)
                        shown[k] = text[k]
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(line, pa.int32()), pa.array(copy, pa.int64()), pa.array(ids), pa.array(shown, pa.string())], names=["doc", "line", "copy", "id", "text"])

    return docs.select("doc", "copy", "text").mapInArrow(list_lines, "doc long, line int, copy long, id long, text string")


def _keys(members: DataFrame) -> DataFrame:
    """(key, id) of twice the bands for each line of members(id, text): by these alone a pair at 0.8 is missed with some 3e-5."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys, _ = sketches(part.column(1).to_pylist(), wide=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), keys.shape[1]))], names=["key", "id"])

    return members.select("id", "text").mapInArrow(cut, "key long, id long")


def line_links(scratch: Scratch, members: DataFrame, num: int, den: int, most: int = BLOCK) -> DataFrame:
    """Links (a, b) of the lines of families; `members` (id, family, text) is read more than once.

    Chance candidates chain families of one size to ever larger ones as a corpus grows, and to compare a family's blocks
    with each other grows with its square. So a family above `most` is taken apart again: its lines meet by bands, of groups
    with the same lines one. A line is in twenty groups at most, so the work grows with the lines.
    """
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    large = scratch.keep(sizes.where(F.col("n") > most).select("family"), "chained")
    if not large.limit(1).count():
        return family_links(scratch, members, char_shingles, num, den)
    whole = family_links(scratch, members.join(large, "family", "left_anti"), char_shingles, num, den)
    apart = scratch.keep(members.join(large, "family", "left_semi").select("id", "text"), "apart")
    keys = scratch.keep(_keys(apart), "keys")
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("same")).where("n > 1").groupBy("n", "same").agg(F.min("key").alias("key"))
    # A line stands in several groups, so its place in one has an id of its own.
    places = scratch.keep(keys.join(met.select("key"), "key").select(F.xxhash64("key", "id").alias("place"), "key", "id"), "band_places")
    grouped = scratch.keep(places.join(apart, "id").select(F.col("place").alias("id"), F.col("key").alias("family"), "text"), "band_members")
    found = scratch.keep(family_links(scratch, grouped, char_shingles, num, den), "band_links")
    name = lambda end: places.select(F.col("place").alias(f"{end}_place"), F.col("id").alias(f"{end}_id"))
    named = found.join(name("a"), F.col("a") == F.col("a_place")).join(name("b"), F.col("b") == F.col("b_place"))
    return whole.unionByName(named.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))


def repeated_lines(scratch: Scratch, docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc, copy, lines): the numbers of the lines that go from each of `docs(doc, text)`; copy is the text's hash."""
    docs = docs.select("doc", F.xxhash64("text").alias("copy"), "text")
    candidates = _candidates(_bands(docs.where("doc IS NOT NULL")))
    families = scratch.keep(components(scratch, candidates).select(F.col("id").alias("i"), F.col("component_id").alias("family")), "families")
    lines = scratch.keep(_occurrences(docs, _filter_of(families)), "lines")
    # First and last place of each line, by partial sums before any join: a line may stand in a third of all documents.
    place = F.struct("doc", "line", "copy")
    places = scratch.keep(lines.groupBy("id").agg(F.min(place).alias("m"), F.max(place).alias("last")), "places")
    texts = lines.where("text IS NOT NULL").select("id", "text").dropDuplicates(["id"])
    members = scratch.keep(texts.join(families, F.col("id") == F.col("i")).select("id", "family", "text"), "members")
    links = line_links(scratch, members, num, den)
    linked = scratch.keep(components(scratch, links).select(F.col("id").alias("i"), F.col("component_id").alias("part")), "linked")
    scratch.drop("members", "families")
    # The place that stays: of a component's lines the first one, of a line without links its own; then one join with all lines.
    joined = places.join(linked, F.col("id") == F.col("i"))
    first = joined.groupBy(F.col("part").alias("p")).agg(F.min("m").alias("stays"))
    stays = linked.join(first, F.col("part") == F.col("p")).select("i", "stays")
    stays = stays.unionByName(places.where("m <> last").join(linked, F.col("id") == F.col("i"), "left_anti").select(F.col("id").alias("i"), F.col("m").alias("stays")))
    stays = scratch.keep(stays, "stays")
    return lines.join(stays.hint("shuffle_hash"), F.col("id") == F.col("i")).where(place != F.col("stays")).groupBy("doc", "copy").agg(F.collect_set("line").alias("lines"))


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """`docs` with the text less its repeated lines, and __lines and __removed (numbers of lines before and gone)."""
    scratch = Scratch(docs.sparkSession, "lines")
    names = docs.columns
    plain = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    gone = scratch.keep(repeated_lines(scratch, plain, num, den).select(F.col("doc").alias("d"), F.col("copy").alias("c"), F.col("lines").alias("gone")), "gone")
    scratch.drop("stays", "places", "lines")
    # The caller's columns travel as one struct, so that none of their names meets ours. What goes is hashed, so texts are not sorted.
    rows = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"))
    text = F.col("row").getField(text_col)
    both = rows.join(gone.hint("shuffle_hash"), (F.col("row").getField(id_col).cast("long") == F.col("d")) & (F.xxhash64(text) == F.col("c")), "left")
    lines = F.split(text, "\n")
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.filter(lines, lambda x, k: ~F.array_contains(F.col("gone"), k)), "\n"))
    return both.select(*(kept.alias(n) if n == text_col else F.col("row").getField(n).alias(n) for n in names), F.coalesce(F.size(lines), F.lit(0)).alias("__lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("__removed"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256): lines of the text, how many go, and the digest of what stays."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return without_lines(docs).select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.col("__removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
