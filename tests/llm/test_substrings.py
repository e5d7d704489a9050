import brute
import duckdb
from pyspark.sql import functions as F
from sql_compare import assert_same, connect

from loomspan.llm import substring_dedup


def test_same_as_sql(spark, sf_dir):
    assert_same(substring_dedup.op4_substring_dedup(spark, sf_dir), connect(sf_dir), substring_dedup.OP4_SQL)


def digest(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def apply(docs):
    return substring_dedup._apply(docs, "doc_id", "text", 50, "kept_sha256")


def test_against_brute_force(spark, make_docs, texts):
    for seed in (1, 2):
        some = texts(seed)
        docs = make_docs(some).withColumns({"doc": F.lit(1), "at": F.lit(2), "anchor": F.lit(3)})
        want = brute.without_repeats(dict(enumerate(some)))
        assert sum(w[1] for w in want.values()) > 500
        assert digest(apply(docs)) == want


def test_branches_and_periods(spark, make_docs):
    """One anchor with many continuations, periodic texts, and windows that overlap an edit at every place."""
    base = [f"w{i}" for i in range(130)]
    some = [" ".join(base)]
    some += [" ".join(base[:k] + [f"edit{k}"] + base[k + 1 :]) for k in range(0, 130, 7)]
    some += [" ".join(["x", "y"] * n) for n in (24, 25, 26, 60)] + ["z " * 200, "z " * 49, "z " * 50]
    some += [" ".join(base[30:79]), " ".join(base[30:80]), None, ""]
    assert digest(apply(make_docs(some))) == brute.without_repeats(dict(enumerate(some)))


def test_large_group_and_repeated_rows(spark, make_docs):
    passage = " ".join(f"p{i}" for i in range(60))
    some = [f"a{i} b{i} {passage} c{i}" for i in range(300)]
    docs = make_docs(some)
    want = brute.without_repeats(dict(enumerate(some)))
    assert digest(apply(docs.unionByName(docs.where("doc_id < 5")))) == want
    null_id = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r.n_removed for r in apply(null_id).collect()] == [0, 0, 0]
    assert apply(docs.limit(0)).count() == 0
    kept = substring_dedup.without_repeats(docs).where("doc_id = 7").first()
    assert kept.kept_text == "a7 b7 c7"


def test_sql_with_nulls(spark, make_docs, texts, tmp_path):
    make_docs(texts(3)).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert_same(substring_dedup.op4_substring_dedup(spark, str(tmp_path)), con, substring_dedup.OP4_SQL)


def test_rows_of_one_id(spark, make_docs):
    """Rows of one id with different texts are judged each by itself, and are no sources of each other."""
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(1, passage), (1, f"{passage} and so on"), (2, "short"), (2, f"a b c {passage} d"), (2, " ".join(f"u{i}" for i in range(200))), (None, passage), (2, f"a b c {passage} d")]
    got = sorted(((r.doc_id or 0, r.n_words, r.n_removed) for r in apply(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(0, 80, 0), (1, 80, 0), (1, 83, 0), (2, 1, 0), (2, 84, 80), (2, 84, 80), (2, 200, 0)]


def test_runs_join_to_spans():
    import numpy as np

    runs = np.array([[5, 3, 1, 0, 15], [8, 2, 1, 0, 18], [10, 4, 2, 0, 0], [0, 2, 1, 0, 10], [9, 1, 1, 0, 19], [20, 1, 1, 0, 31], [100, 5, 0, 0, 50], [30, 1, 1, 0, 40]])
    assert substring_dedup.joined(runs).tolist() == [[100, 5, 0, 0, 50], [0, 2, 1, 0, 10], [5, 5, 1, 0, 15], [30, 1, 1, 0, 40], [20, 1, 1, 0, 31], [10, 4, 2, 0, 0]]


def test_a_span_whose_source_reads_otherwise_stays(spark, make_docs, monkeypatch):
    """Coordinates are read: with wrong digests at the sources nothing goes."""
    passage = " ".join(f"p{i}" for i in range(60))
    docs = make_docs([passage, f"x {passage}"])
    assert [n for _, n, _ in sorted((r.doc_id, r.n_removed, 0) for r in apply(docs).collect())] == [0, 60]
    whole = substring_dedup.verified_spans
    monkeypatch.setattr(substring_dedup, "verified_spans", lambda *a: whole(*a).withColumn("at", F.transform("at", lambda x: x.withField("digest", x["digest"] + 1))))
    assert sum(r.n_removed for r in apply(docs).collect()) == 0
