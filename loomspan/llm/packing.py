"""Best-fit packing of token sequences by the sum-of-squares rule.

Every document is tokenised whole; only one longer than a sequence is cut. The pieces are dealt at random over groups of
a bounded size, and each group packs its own, longest first: a piece goes where the sum over gaps g of N(g)^2 becomes
smallest, N(g) being the number of open sequences with g free places (a new sequence is one of the choices; ties go to
the smallest gap left). What a group leaves open is a few sequences, against the thousands that it fills.

Defined results: a null text is an empty one; an empty text is the end token alone, one piece of length 1; repeated rows
are packed as separate documents, dealt to groups each by itself; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm._shared import Scratch, small_batches, spread

CAPACITY = 4096
END_ID = 1
#: Pieces that one group packs on average. Groups are dealt by a hash, so their sizes differ by a few hundredths.
GROUP_PIECES = 16_384
#: Words, and letter runs, whose ids a worker remembers; either memory starts anew when it is full.
REMEMBERED_WORDS = 500_000
REMEMBERED_RUNS = 700_000
_ENDS = ".,;:!?|"
#: Stands between words that are encoded together; its ids come from no other text.
_MARK = "\u00a7"


#: Texts of which a tokenizer must have the same ids word by word as whole.
_PROBE = [
    "The Quick brown FOX, jumps over 12 lazy dogs! It's 3.14 (or so); see http://a.b/c?d=e&f#g.",
    "Größe ÉTÉ ñandú čeština Ελλάδα ΟΔΟΣ İstanbul ﬁn ½ ª º ŉ",
    " two  spaces\tand\ttabs\n\nlines \r\n end ",
    "日本語 テスト。 한국어 العربية עברית हिन्दी ไทย 😀👍🏽 e\u0301 a\u0308",
    "don't we'll 'tis || x|y a_b snake_case CamelCase x=1; y+=2 // # \u00a7 a\u00a7b",
    "",
]


def _shown_bytes() -> dict[int, str]:
    """Byte-level BPE's characters for bytes: printable ones stand for themselves, the others for U+0100 and up, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


_SHOWN = _shown_bytes()


class WordTokenizer:
    """Token ids of whole texts from ids of their words.

    The vocabulary's splitter never joins characters across ASCII white space, so a text's ids are those of its words
    one after the other; most words come again and are looked up. A word of Latin letters with closing punctuation is a
    run of letters and a run of signs for the splitter; its letters go to the model directly, in lower case and with the
    splitter's characters for bytes. Other new words are encoded many at a time. `tests/llm` compares with encoding whole texts.

    All this is so for one kind of vocabulary. So a tokenizer first encodes `_PROBE` both ways; where they differ, or a way
    fails, every text is encoded whole (`by_words` is False).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.mark = self._encode(_MARK).tobytes()
        self.tokenize = self.tokenizer.model.tokenize
        self.by_words = True
        try:
            self.by_words = all(a.tolist() == self._encode(t).tolist() for t, a in zip(_PROBE, self.ids(_PROBE), strict=True))
        except (ValueError, KeyError, TypeError, AttributeError):
            self.by_words = False
        self.known.clear()
        self.runs.clear()

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _run(self, letters: str) -> bytes:
        found = self.runs.get(letters)
        if found is None:
            shown = letters if letters.isascii() else letters.encode().decode("latin-1").translate(_SHOWN)
            ids = [t.id for t in self.tokenize(shown)]
            found = self.runs[letters] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def _learn(self, words: set[bytes]) -> None:
        known, rest = self.known, []
        for w in words:
            text = w.decode()
            letters = text.rstrip(_ENDS)
            # Letters before U+0130 have one lower-case form and no other composition.
            if letters.isalpha() and (letters.isascii() or max(letters) < "\u0130"):
                signs = text[len(letters) :]
                end = b""
                if signs:
                    end = known.get(raw := signs.encode())
                    if end is None:
                        end = known[raw] = self._encode(signs).tobytes()
                known[w] = self._run(letters.lower()) + end
            else:
                rest.append(w)
        for at in range(0, len(rest), 100):
            some = rest[at : at + 100]
            texts = [w.decode() for w in some]
            joined = f" {_MARK} ".join(texts)
            parts = _split(self._encode(joined).tobytes(), self.mark) if len(joined) < 10_000 and not any(_MARK in x or "<|" in x for x in texts) else []
            if len(parts) != len(some):
                parts = [self._encode(x).tobytes() for x in texts]
            known.update(zip(some, parts, strict=True))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_words:
            return [self._encode(t) for t in texts]
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
        if len(self.runs) > REMEMBERED_RUNS:
            self.runs.clear()
        split = [t.encode("utf-8", "replace").split() for t in texts]
        get = self.known.get
        out = []
        for words in split:
            found = list(map(get, words))
            if None in found:
                self._learn({w for w, f in zip(words, found, strict=True) if f is None})
                found = list(map(get, words))
            out.append(np.frombuffer(b"".join(found), "<u4"))
        return out


def _split(ids: bytes, mark: bytes) -> list[bytes]:
    """Parts between marks that stand at a whole id."""
    parts, start, at = [], 0, 0
    while (at := ids.find(mark, at)) >= 0:
        if at % 4:
            at += 1
            continue
        parts.append(ids[start:at])
        at = start = at + len(mark)
    return [*parts, ids[start:]]


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end token, cut at `capacity`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                out: list[list] = [[], [], [], [], [], []]
                for doc, ids in zip(some.column(0).to_pylist(), tokenizer.ids([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    ids = np.append(ids, np.array([end_id], "<u4"))
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        for column, value in zip(out, (doc, piece, start, len(part), zlib.crc32(part.tobytes()), part if with_ids else None), strict=True):
                            column.append(value)
                columns = [pa.array(out[0], some.schema.field(0).type), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:5])]
                if with_ids:
                    columns.append(pa.array(out[5], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the given order, by the sum-of-squares rule."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; a full bin counts for nothing
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for at, n in enumerate(lengths.tolist()):
        left = capacity - n
        # Moving a bin from gap n+k to gap k changes the sum by 2 (N(k) - N(n+k) + 1); for k = 0 by 1 - 2 N(n).
        change = 2 * (count[: left + 1] - count[n:] + 1)
        change[0] = 1 - 2 * count[n]
        change[count[n:] == 0] = 1 << 40
        best = int(change.argmin())
        if left == 0 or (2 * count[left] + 1) < change[best]:
            number, gap, used = used, capacity, used + 1
        else:
            gap = n + best
            number = open_bins[gap].pop()
            count[gap] -= 1
        bins[at], offsets[at] = number, capacity - gap
        if gap > n:
            open_bins[gap - n].append(number)
            count[gap - n] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """`pieces` with sequence_id and offset. It needs length (1 to capacity), doc_id, piece and no other column of these names."""
    scratch = Scratch(pieces.sparkSession, "pack")
    kept = scratch.keep(pieces, "pieces")
    groups = max(1, round(kept.count() / group_pieces))
    kept = kept.withColumn("group_id", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        table = pa.Table.from_batches(table).combine_chunks()
        names = table.column_names
        table = table.sort_by([("group_id", "ascending"), ("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        group = table["group_id"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for a, b in zip(edges, edges[1:], strict=False):
            part = table.slice(a, b - a)
            bins, offsets = sum_of_squares(part["length"].to_numpy(), capacity)
            part = part.append_column("sequence_id", pa.array((int(group[a]) << 32) + bins)).append_column("offset", pa.array(offsets)).select([n for n in names if n != "group_id"] + ["sequence_id", "offset"])
            yield from part.combine_chunks().to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return kept.repartition(groups, "group_id").mapInArrow(fill, schema)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(token_pieces(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), public_tokenizers.path("word_bpe_49k.json")))
