import math

import brute
import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from loomspan.llm import langid, packing, stages


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "mixing", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).schema.simpleString() == docs.schema.simpleString()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0


def plain_run(docs: dict, accepted: set) -> dict:
    """doc_id -> text before mixing: line dedup among accepted documents, then the first of each group."""
    docs = {i: docs[i] for i in accepted}
    gone = brute.lines_removed(docs)
    kept = {}
    for i, t in docs.items():
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        if not gone[i] or left.strip(" \t\n\r\f\v"):
            kept[i] = left
    part = brute.ngram_components(kept, n=5, num=80)
    return {i: t for i, t in kept.items() if part[i][1] == i}


def test_run_against_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r.doc_id: r.text for r in table.collect()}
    source = {r.doc_id: r.source for r in table.collect()}
    dictionaries = langid.train_dictionaries(table.where(~langid.held_out("doc_id")))
    model = langid.Compressors(dictionaries)
    accepted = {i for i, t in docs.items() if (p := model.predict(t))[0] != "und" and p[2] >= langid.REJECT_MARGIN}
    assert 0.9 * len(docs) < len(accepted) <= len(docs)
    want = plain_run(docs, accepted)

    before = table
    for _, stage in corpus_pipeline.STAGES[:3]:
        before = stage(spark, before, sf_dir)
    assert {r.doc_id: r.text for r in before.collect()} == want

    mixed = stages.mixed(spark, before, sf_dir).collect()
    size = {i: len(brute.words(t)) for i, t in want.items()}
    whole = sum(size.values())
    names = sorted({source[i] for i in want})
    weights = {n: k % 3 + 1 for k, n in enumerate(names)}
    of = {n: sum(size[i] for i in want if source[i] == n) for n in names}
    target, open_names = {}, set(names)
    while True:
        left = whole - sum(target.values())
        level = left / sum(weights[n] for n in open_names)
        full = {n for n in open_names if 3 * of[n] <= level * weights[n]}
        if not full:
            break
        target |= {n: 3.0 * of[n] for n in full}
        open_names -= full
    target |= {n: level * weights[n] for n in open_names}
    taken = dict.fromkeys(names, 0)
    for r in mixed:
        n = len(brute.words(r.text))
        taken[r.source] += n
        assert n == size[r.doc_id] and r.text == want[r.doc_id] or brute.words(r.text) == brute.words(want[r.doc_id])[:n]
    assert taken == {n: math.floor(t + 1e-9) for n, t in target.items()}

    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    tokenizer = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(p.length for p in pieces) == sum(len(x) + 1 for x in tokenizer.ids([r.text for r in mixed]))
    places = {}
    for p in pieces:
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 4096


def test_clean_documents_stay(spark, sf_dir):
    """Long documents that share no line and no shingle set with others pass the filtering stages unchanged."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r.doc_id: r.text for r in table.collect()}
    gone = brute.lines_removed(docs)
    clean = {i for i, t in docs.items() if not gone[i] and len(brute.words(t)) > 100 and len(set(brute.words(t))) > 60}
    out = table
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, out, sf_dir)
    left = {r.doc_id: r.text for r in out.collect()}
    kept = [i for i in clean if left.get(i) == docs[i]]
    assert len(kept) >= 0.99 * len(clean)


def test_null_texts_and_repeated_rows(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = table.limit(3).withColumn("text", F.lit(None).cast("string"))
    rows = table.unionByName(odd).unionByName(table.limit(2))
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf_dir)
    assert rows.count() > 0


def test_groups_by_five_words_and_0_8(spark, make_docs):
    """A copy with a block of new text at Jaccard 0.82 of 5-word shingles goes."""
    words = [f"w{k}" for k in range(400)]
    some = [" ".join(words), " ".join(words + [f"n{k}" for k in range(87)]), " ".join(words + [f"m{k}" for k in range(140)])]
    assert {i: c for i, (_, c) in brute.ngram_components(dict(enumerate(some)), n=5, num=80).items()} == {0: 0, 1: 0, 2: 2}
    assert sorted(r.doc_id for r in stages.one_of_each_group(spark, make_docs(some), "").collect()) == [0, 2]


def test_null_and_repeated_ids(spark):
    """Rows without an id, and rows of one id with other texts, are documents of their own in the join and the mix."""
    text = lambda k, n: " ".join(f"t{k}w{j}" for j in range(n))
    rows = [(None, text(1, 30)), (None, text(2, 40)), (3, text(3, 50)), (4, text(4, 20)), (4, text(5, 70)), (5, text(2, 40)), (3, text(3, 50)), (None, text(6, 25)), (None, text(6, 25))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = [rows[0], *rows[2:8]]
    key = lambda r: (r[0] or 0, r[1])
    kept = stages.one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(want, key=key)
    mixed = stages.mixed(spark, docs, "")
    assert mixed.columns == docs.columns and sorted(((r.doc_id, r.text) for r in mixed.collect()), key=key) == sorted(rows, key=key)


def test_mix_is_written_by_more_tasks_when_it_is_larger(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    few = stages.mixed(spark, docs, sf_dir)
    monkeypatch.setattr(stages, "TASK_BYTES", 1 << 10)
    many = stages.mixed(spark, docs, sf_dir)
    assert many.rdd.getNumPartitions() > few.rdd.getNumPartitions()
    assert sorted((r.doc_id, r.text) for r in many.collect()) == sorted((r.doc_id, r.text) for r in few.collect())
