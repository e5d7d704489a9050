import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomspan.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["It's don't <|endoftext|> <|startoftext|>. a§b § x§ ÇA Σας ΟΔΟΣ ça va a<| <|! 12a3 ...!! x's|| İstanbul é ẞ ABC'RE.", "", "  ", "  a\x85b\x1c c", "§", "§ §", "é combining é, ﬁ ﬀ", "ª º µ ß ŉ", "　日本語 テスト。", "don't, we'll! 'tis", "a" * 3000, None]


def test_ids_are_those_of_whole_texts(texts):
    words, whole = packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    for t in [*ODD, *texts(3)]:
        assert words.ids([t or ""])[0].tolist() == whole.encode(t or "", add_special_tokens=False).ids


def test_sum_of_squares_against_all_choices():
    r = random.Random(2)
    lengths = np.array([r.randint(1, 12) for _ in range(200)])
    bins, offsets = packing.sum_of_squares(lengths, 12)
    gaps = {}
    for n, b, at in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        def cost(choice, n=n):
            after = {**gaps, choice: gaps.get(choice, 12) - n}
            open_gaps = [g for g in after.values() if g > 0]
            return sum(open_gaps.count(g) ** 2 for g in set(open_gaps))

        new = max(gaps, default=-1) + 1
        best = min(cost(c) for c in [new, *(c for c, g in gaps.items() if g >= n)])
        assert gaps.get(b, 12) >= n and at == 12 - gaps.get(b, 12)
        assert cost(b) == best
        gaps[b] = gaps.get(b, 12) - n


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_operator(spark, make_docs, texts):
    whole = Tokenizer.from_file(PATH)
    some = [*texts(4), *ODD, "word " * 9000]
    docs = make_docs(some).withColumns({"length": F.lit("clash"), "piece": F.lit(1), "offset": F.lit(2)})
    docs = docs.unionByName(docs.where("doc_id < 3"))
    rows = packing.pack(packing.token_pieces(docs, PATH), group_pieces=64).collect()
    n = check(rows, 4096)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, {})[r.piece] = r
    total = 0
    for i, t in enumerate(some):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids) * (2 if i < 3 else 1)
        pieces = [got[i][k] for k in range(len(got[i]))]
        assert [p.length for p in pieces] == [min(4096, len(ids) - s) for s in range(0, len(ids), 4096)]
        assert [p.ids_crc32 for p in pieces] == [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces]
    assert n <= -(-total // 4096) + 4
    assert len(rows) == sum(map(len, got.values())) + sum(len(got[i]) for i in range(3))
    assert packing.pack(packing.token_pieces(docs.limit(0), PATH)).count() == 0
    ids = packing.token_pieces(docs.where("doc_id = 0"), PATH, with_ids=True).first()
    assert zlib.crc32(np.array(ids.ids, "<u4").tobytes()) == ids.ids_crc32


def test_other_vocabularies_are_encoded_whole():
    """A tokenizer that isn't of the kind read word by word gives the ids of whole texts all the same."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    words, whole = packing.WordTokenizer(path), Tokenizer.from_file(path)
    assert packing.WordTokenizer(PATH).by_words and not words.by_words
    for t in [*ODD, "two  spaces and Capitals"]:
        assert words.ids([t or ""])[0].tolist() == whole.encode(t or "", add_special_tokens=False).ids


def test_many_repeated_rows_are_dealt_to_all_groups(spark):
    """Copies of one row don't meet in one group."""
    docs = spark.createDataFrame([(1, "the same words in each row")] * 400, "doc_id long, text string")
    rows = packing.pack(packing.token_pieces(docs, PATH), group_pieces=50).collect()
    groups = {}
    for r in rows:
        groups[r.sequence_id >> 32] = groups.get(r.sequence_id >> 32, 0) + 1
    assert len(rows) == 400 and max(groups.values()) < 120
    check(rows, 4096)
