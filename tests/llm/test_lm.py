import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import lm_scoring as lm


def test_target_reads_like_target(spark):
    import random

    r = random.Random(1)
    a, b = [f"alpha{i}" for i in range(50)], [f"beta{i}" for i in range(50)]
    rows = [(i, " ".join(r.choice(a if i % 2 else b) for _ in range(200)), i % 2 == 1 and i < 60) for i in range(120)]
    marked = spark.createDataFrame(rows, "doc_id long, text string, target boolean")
    got = {x.doc_id: x.score for x in lm.score_documents(marked).collect()}
    assert max(got[i] for i in range(1, 120, 2)) < min(got[i] for i in range(0, 120, 2))


def test_twice_the_same_document(spark):
    one = spark.createDataFrame([(1, "a b", False), (1, "a b", False)], "doc_id long, text string, target boolean")
    assert [np.isfinite(x.score) for x in lm.score_documents(one).collect()] == [True, True]


def test_long_texts_and_clashing_columns(spark):
    """A text longer than a chunk and a bucket, beside short ones, with columns of the operator's own names."""
    some = {0: "long words come again " * 4000 + " ".join(f"only{k}" for k in range(3000)), 1: "long words", 2: None, 3: ""}
    clash = {n: F.lit("clash") for n in ("chunk", "bucket", "data", "ids", "to", "words", "every")}
    docs = spark.createDataFrame([(i, t, i == 1) for i, t in some.items()], "doc_id long, text string, target boolean").withColumns(clash)
    want = real_plain(some, {1})
    got = {r.doc_id: r for r in lm.score_documents(docs, chunk_chars=2000, bucket_chars=5000).collect()}
    assert set(got) == set(some) and got[2].score is None and got[3].score is None
    for i in (0, 1):
        assert got[i].loss_target == pytest.approx(want[i][0], rel=1e-9) and got[i].loss_background == pytest.approx(want[i][1], rel=1e-9)


def test_marks_by_broadcast_and_by_shuffle(spark, sf_dir, monkeypatch):
    one = {r.doc_id: r.score for r in lm.op6_lm_scoring(spark, sf_dir).collect()}
    monkeypatch.setattr(lm, "BROADCAST_IDS", 0)
    other = {r.doc_id: r.score for r in lm.op6_lm_scoring(spark, sf_dir).collect()}
    assert other == pytest.approx(one, abs=1e-12, nan_ok=True)


def test_query(spark, sf_dir):
    assert lm.op6_lm_scoring(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def real_plain(docs, target, smoothing=lm.SMOOTHING):
    """Scores by dictionaries of the words and pairs themselves, each document left out of its models."""
    import brute

    parts = {i: brute.words(t, True) for i, t in docs.items()}
    pairs = {i: list(zip([None, *w], w, strict=False)) for i, w in parts.items()}
    vocabulary = len({w for x in parts.values() for w in x})
    ones, twos = [Counter(), Counter()], [Counter(), Counter()]
    for i in docs:
        for kind in (0, 1) if i in target else (0,):
            ones[kind].update(parts[i])
            twos[kind].update(pairs[i])
    sizes = [sum(c.values()) for c in ones]
    out = {}
    for i in docs:
        own, own_pairs, losses = Counter(parts[i]), Counter(pairs[i]), []
        for kind in (1, 0):
            less = int(kind == 0 or i in target)
            loss = 0.0
            for v, w in pairs[i]:
                one, two = ones[kind][w] - less * own[w], twos[kind][v, w] - less * own_pairs[v, w]
                before = ones[kind][v] - less * own[v] if v is not None else 0
                loss -= math.log((two + smoothing * (one + 1) / (sizes[kind] - less * len(parts[i]) + vocabulary)) / (max(before, two) + smoothing))
            losses.append(loss / len(parts[i]) if parts[i] else None)
        out[i] = losses
    return out


def test_real_words_and_bigrams(spark, make_docs, texts):
    """More distinct words than 2^16: each has its own count, in any number of chunks and buckets."""
    some = texts(1) + [" ".join(f"w{k}x{j}" for j in range(7000)) for k in range(11)] + [" ".join(f"w{k}x{j}" for j in range(0, 7000, 2)) for k in range(11)]
    marked = make_docs(some).withColumn("target", F.col("doc_id") % 3 == 0).repartition(5)
    want = real_plain(dict(enumerate(some)), {i for i in range(len(some)) if i % 3 == 0})
    for sizes in ({}, {"chunk_chars": 5000, "bucket_chars": 90_000}):
        got = {r.doc_id: r for r in lm.score_documents(marked, **sizes).collect()}
        assert set(got) == set(want)
        for i, (a, b) in want.items():
            if a is None:
                assert (got[i].n_tokens, got[i].loss_target, got[i].score) == (0, None, None)
            else:
                assert got[i].loss_target == pytest.approx(a, rel=1e-9) and got[i].loss_background == pytest.approx(b, rel=1e-9)
                assert got[i].score == pytest.approx(a - b, abs=1e-9)


def test_query_counts_real_words(spark, sf_dir):
    """The query's scores are those of real words; rows without an id and repeated ones stay."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    want = real_plain(docs, good & set(docs))
    got = {r.doc_id: r for r in lm.op6_lm_scoring(spark, sf_dir).collect()}
    assert all(got[i].score == pytest.approx(a - b, abs=1e-9) for i, (a, b) in want.items() if a is not None)
    odd = spark.createDataFrame([(None, "a b", True), (None, "a c", None), (1, None, True), (1, "a b", False)], "doc_id long, text string, target boolean")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in lm.score_documents(odd).collect()) == [(0, 2), (0, 2), (1, 0), (1, 2)]
    assert lm.score_documents(odd.limit(0)).count() == 0
