"""Operators on small tables with known results."""

import json

import pytest
from pyspark.sql import functions as F

from loomspan.functions import text as tx
from loomspan.operators import benchmark, chunking, evaluation, labels, queries, retrieval, sampling
from loomspan.plans import experiments
from loomspan.sources import jsonl
from loomspan.streaming import predictions


@pytest.fixture(scope="module")
def files(spark):
    rows = [("r", f"r/{name}.py", "\n".join(f"{name} line{i} tok{i % 3}" for i in range(n))) for name, n in (("a", 12), ("b", 7), ("c", 1))] + [("r", "r/blank.py", "\n \n"), ("q", "q/d.py", "alone")]
    return spark.createDataFrame(rows, "repo string, filepath string, content string").withColumn("lines", tx.nonblank_lines(F.col("content")))


def test_windows(files):
    found = chunking.windows(files.select("repo", "filepath", "lines"), 10, 5).where("filepath = 'r/a.py'").orderBy("chunk_no").collect()
    assert [(r.chunk_no, r.start_i, r.end_i, len(r.text.split("\n"))) for r in found] == [(0, 0, 10, 10), (1, 5, 15, 7), (2, 10, 20, 2)]
    assert chunking.windows(files.select("repo", "filepath", "lines"), 10, 5).where("filepath = 'r/blank.py'").count() == 0


def test_window_without_words_is_not_numbered(spark):
    f = spark.createDataFrame([("r", "f", ["!!", "word"])], "repo string, filepath string, lines array<string>")
    assert [(r.chunk_no, r.start_i) for r in chunking.windows(f, 1, 1).collect()] == [(0, 1)]


def test_configs(spark):
    assert chunking.window_configs()[:3] == [(10, 10), (10, 5), (20, 10)]
    assert chunking.window_configs(True)[4] == (44, 22)
    got = spark.range(1, 12).select(chunking.config_for(F.col("id")).alias("a"), chunking.function_config_for(F.col("id")).alias("b")).collect()
    assert got[3].a == 40 and got[9].a is None and got[9].b == 50


def test_bm25_against_the_formula(spark):
    import math

    docs = {"x": ["a", "a", "b"], "y": ["b", "c"], "z": ["c", "d", "e", "f"]}
    cand = spark.createDataFrame([("t", k, v) for k, v in docs.items()], "task_id string, chunk_id string, tokens array<string>")
    terms = spark.createDataFrame([("t", "a", 1.0), ("t", "b", 1.0), ("t", "b", 1.0), ("t", "none", 1.0)], "task_id string, term string, weight double")
    got = {r.chunk_id: r.score for r in retrieval.bm25(cand, terms).collect()}
    n, avg = 3, 3
    idf = {w: math.log(n - sum(w in d for d in docs.values()) + 0.5) - math.log(sum(w in d for d in docs.values()) + 0.5) for w in "abcdef"}
    mean = sum(idf.values()) / 6
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    for k, d in docs.items():
        want = sum(q * idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w, q in (("a", 1), ("b", 2)))
        assert got[k] == pytest.approx(want)


def test_ties_threshold_and_blocks(spark):
    q = spark.createDataFrame([("t", "r", "own", "a b")], "task_id string, repo string, filepath string, query string")
    c = spark.createDataFrame([("r", "f1", 0, "a b"), ("r", "f2", 0, "b a"), ("r", "own", 0, "a b"), ("r", "f3", 0, "zz"), ("s", "f4", 0, "a b")], "repo string, filepath string, chunk_no int, text string")
    got = retrieval.rank_sets(q, c, 9).orderBy("rank").collect()
    assert [r.chunk_filepath for r in got] == ["f1", "f2", "f3"] and got[2].score == 0
    assert [r.chunk_filepath for r in retrieval.rank_sets(q, c, 9, ties="text_desc", block=1, slice_rows=1).orderBy("rank").collect()] == ["f2", "f1", "f3"]
    assert retrieval.rank_sets(q, c, 9, threshold=0.5).count() == 2


def test_context(spark):
    sel = spark.createDataFrame([("t", 2, "f2", "\nx\n"), ("t", 1, "f1", "a\r\nb")], "task_id string, rank int, filepath string, text string")
    got = retrieval.context_text(sel, "//").first().crossfile_context
    head = "// Here are some relevant code fragments from other files of the repo:\n\n"
    part = "// the below code fragment can be found in:\n// {}\n{}\n\n"
    assert got == head + part.format("f1", "// a\n// b") + part.format("f2", "// x")


def test_distinct_texts_keeps_the_best(spark):
    sel = spark.createDataFrame([("t", 1, "x"), ("t", 2, "y"), ("t", 3, "x")], "task_id string, rank int, text string")
    assert sorted(r["rank"] for r in retrieval.distinct_texts(sel).collect()) == [1, 2]


def test_attach_context(spark, files):
    tasks = spark.createDataFrame([("t1", "r", "r/a.py", "b line1 tok1", "g", "b line2 tok2"), ("t2", "q", "q/d.py", "p", "g", "")], "task_id string, repo string, filepath string, prompt string, groundtruth string, right_context string")
    for kind in ("last_n_lines", "groundtruth", "first_n_lines", "left_last_and_right_first"):
        got = {r.task_id: r.crossfile_context for r in experiments.attach_context(tasks, files, query_type=kind).collect()}
        assert "# r/b.py" in got["t1"] and "# r/a.py" not in got["t1"] and got["t2"] == ""


def test_training_examples(files):
    rows = experiments.training_examples(files.select("repo", "filepath", "lines")).collect()
    assert rows
    for r in rows:
        lines = next(f.lines for f in files.collect() if f.filepath == r.filepath)
        assert r.prompt + r.groundtruth + r.right_context == "\n".join(lines)
    assert [x.task_id for x in sorted(rows)] == [x.task_id for x in sorted(experiments.training_examples(files.select("repo", "filepath", "lines")).collect())]


def test_benchmark_tasks(spark):
    f = spark.createDataFrame([("r", "r/x.py", ["def f():", "    a = 1", "    return a", "z"])], "repo string, filepath string, lines array<string>")
    p = spark.createDataFrame([("r", "r/x.py", "t", 1, 2), ("r", "r/x.py", "u", None, 2)], "repo string, filepath string, task_id string, line_no int, n_lines int")
    got = benchmark.completion_tasks(p, f, "line").collect()
    assert [(r.prompt, r.groundtruth, r.right_context) for r in got] == [("def f():\n    ", "a = 1\n    return a", "\nz")]
    assert benchmark.violations(benchmark.completion_tasks(p, f, "line")).count() == 0
    api = benchmark.completion_tasks(p, f, "api").first()
    assert api.right_context == "z"


def test_repository_names(spark):
    rows = spark.createDataFrame([("some--tool_x",), ("none",), (None,)], "n string").withColumn("repo", benchmark.canonical_repository(F.col("n")))
    listed = spark.createDataFrame([("some_tool_x",), ("other_y",), (None,), ("some_tool_x",)], "repo string")
    assert {r.n: r.url for r in benchmark.with_urls(rows, listed).collect()} == {"some--tool_x": "https://github.com/some/tool_x", "none": None, None: None}


def test_labels(spark):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "task_id string")
    base = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.9)], "task_id string, es double")
    aug = spark.createDataFrame([("a", 0.5), ("b", 0.7), ("c", 0.7)], "task_id string, es double")
    got = {r.task_id: (r.positive, r.neg_retrieval) for r in experiments.label(tasks, base, aug).collect()}
    assert got == {"a": (False, False), "b": (True, False), "c": (False, True)}
    rows = experiments.label(tasks, base.unionByName(spark.createDataFrame([("z", 1.0)], "task_id string, es double")), aug)
    rows = rows.withColumns({"prompt": F.lit("a\nb"), "right_context": F.lit(""), "groundtruth": F.lit("x")})
    stats = labels.label_stats(rows, base).first()
    assert (stats.left_mean, stats.left_std, stats.n_improved, stats.improved_ratio) == (2.0, 0.0, 1, pytest.approx(1 / 3))


def test_split_is_disjoint(spark):
    rows = spark.range(2000).select(F.concat(F.lit("o/r"), F.col("id") % 200, F.lit("/f")).alias("task_id"))
    got = sampling.group_split(rows, sampling.repo_key(F.col("task_id")), 0.2)
    assert got.groupBy(sampling.repo_key(F.col("task_id"))).agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert {r.split for r in got.select("split").distinct().collect()} == {"train", "valid", "test"}


def test_shards_lose_nothing(spark):
    got = sampling.shards(spark.range(10).select(F.col("id").cast("string").alias("repo")), "repo", 4)
    assert {r.shard: r["count"] for r in got.groupBy("shard").count().collect()} == {1: 4, 2: 4, 3: 2}


def test_kmeans(spark):
    rows = spark.createDataFrame([("g", i, [float(i // 5 * 10), float(i % 5) / 10]) for i in range(20)], "group string, doc_id long, vector array<double>")
    got = {r.doc_id: r.cluster for r in sampling.kmeans(rows, 0.2).collect()}
    assert len(got) == 20 and len(set(got.values())) == 4
    assert all(got[i] == got[i // 5 * 5] for i in range(20))


def test_evaluation(spark):
    preds = spark.createDataFrame([("a", "x = 1\n\ny\nz"), ("b", "foo")], "task_id string, pred string")
    truth = spark.createDataFrame([("a", "x = 1\ny"), ("b", "bar"), ("c", "q")], "task_id string, target string")
    per_row, means = experiments.evaluate(preds, truth)
    assert {r.task_id: (r.em, r.id_em) for r in per_row.collect()} == {"a": (1, 1), "b": (0, 0)}
    m = means.first()
    assert (m.em, m.total) == (50.0, 2)
    assert [r.task_id for r in evaluation.missing(truth, preds).collect()] == ["c"]


def test_routing_and_batches(spark):
    rows = spark.createDataFrame([(0.2, "p", "c"), (0.3, "p", "c")], "retrieval_prob double, pred_plain string, pred_context string")
    assert [r.pred for r in evaluation.route(rows, 0.2).collect()] == ["p", "c"]
    assert [r.pred for r in evaluation.route(rows, 0.2, "as_coded").collect()] == ["c", "p"]
    batch = spark.createDataFrame([(0, True, True, 1), (0, True, False, 4), (0, False, True, 1), (1, False, False, 1)], "batch int, has_cfc boolean, pred_cfc boolean, rank int")
    got = {r.batch: (r.precision, r.recall, r.f1, r.mrr) for r in evaluation.batch_retrieval_metrics(batch).collect()}
    assert got == {0: (0.5, 0.5, 0.5, 0.625), 1: (0.0, 0.0, 0.0, 0.0)}


def test_training_rows(spark):
    ids = {"fim_prefix": 1, "fim_middle": 2, "fim_suffix": 3, "cfc_info": 10, "end_cfc_info": 11, "end_rc": 11, "neg_cfc_info": 12}
    row = [("t", [7] * 9, [8] * 9, [5], [6, 6], True, False), ("####CLM_DATA", [7] * 40, [], [], [], False, False)]
    df = spark.createDataFrame(row, "task_id string, lc array<int>, rc array<int>, tgt array<int>, cfc array<int>, positive boolean, neg_retrieval boolean")
    got = {r.task_id: r.token_ids for r in labels.training_rows(df, ids, 20).collect()}
    assert got["t"] == [1] + [7] * 8 + [3] + [8] * 4 + [11, 10, 6, 6, 2, 5]
    assert got["####CLM_DATA"] == [7] * 20


def test_files_round_trip(spark, tmp_path):
    record = {"repo_name": "o/r", "stars_count": 1, "files": [{"filepath": "x.py", "content": "a\n\nb", "metadata": {"functions": [[[0, 0], [2, 1]]]}}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/raw.jsonl").write_text(json.dumps(record) + "\n")
    got = jsonl.repository_files(jsonl.read(spark, str(tmp_path / "in"), jsonl.REPOSITORY)).first()
    assert (got.filepath, got.lines, got.spans[0].end_row) == ("o/r/x.py", ["a", "b"], 2)
    origin = jsonl.with_origin(spark, str(tmp_path / "in"), jsonl.REPOSITORY).first()
    assert (origin.origin, origin.origin_index, origin.content.repo_name) == ("in/raw.jsonl", 0, "o/r")
    jsonl.write_shards(sampling.shards(spark.createDataFrame([("a", 1), ("b", 2)], "repo string, v int"), "repo", 1), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("shard=*")) == ["shard=1", "shard=2"]
    (tmp_path / "src/d").mkdir(parents=True)
    (tmp_path / "src/d/m.py").write_text("x = 1")
    assert [(r.path, r.content) for r in jsonl.source_tree(spark, str(tmp_path / "src")).collect()] == [("d/m.py", "x = 1")]
    assert jsonl.output_path("d/tasks.jsonl", "rg1") == "d/tasks.rg1.jsonl"


def test_context_string(spark):
    got = spark.createDataFrame([("plain",), ('{"text": "t"}',)], "c string").select(jsonl.context_string(F.col("c"))).collect()
    assert [r[0] for r in got] == ["plain", "t"]


def test_dispatch():
    assert experiments.prompt_kind("rcfcl_rg1", True) == "right_cfc_left_fim"
    assert experiments.prompt_kind("baseline", False) == "left"
    with pytest.raises(KeyError):
        experiments.prompt_kind("cfcrl_rg1", True)
    assert len(experiments.sweeps()) == 18
    assert queries.neighbour_mode("first_n_lines") == "previous"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"task_id": "a", "pred": "x", "done_at": "2024-01-01T00:01:00"}\n{"task_id": "b", "pred": "y", "done_at": "2024-01-01T00:02:00"}\n')
    truth = spark.createDataFrame([("a", "x"), ("b", "z")], "task_id string, target string")
    query = predictions.windowed(predictions.scored(spark, str(tmp_path / "in"), truth)).writeStream.outputMode("complete").format("memory").queryName("means").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert [(r.em, r.n) for r in spark.table("means").collect()] == [(0.5, 2)]


def test_generation_hook(spark):
    from loomspan.operators import generation

    prompts = spark.createDataFrame([(str(k), f"p{k}") for k in range(5)], "task_id string, prompt string")
    got = generation.generate(prompts, lambda: lambda batch: [t.upper() for t in batch], batch=2)
    assert {r.task_id: r.pred for r in got.collect()} == {str(k): f"P{k}" for k in range(5)}
    twice = got.unionByName(got)
    assert generation.one_per_task(twice, [F.col("sample_latency")]).count() == 5
    assert generation.warm_up(twice, 3).count() == 3
    assert experiments.run_name("a/b/", "d", 2e-5, 128, 2048, seed=1) == "b_d_lr2e-05_bs128_len2048_seed1"


def test_bm25_of_a_repository_is_bm25_of_its_candidates(spark, files):
    chunks = chunking.windows(files.select("repo", "filepath", "lines"), 3, 2).withColumn("tokens", tx.word_tokens(F.col("text"))).drop("text", "start_i", "end_i")
    tasks = files.select(F.col("filepath").alias("task_id"), "repo", "filepath")
    terms = files.select(F.col("filepath").alias("task_id"), F.explode(tx.word_tokens(F.col("content"))).alias("term"), F.lit(0.5).alias("weight"))
    near = retrieval.pairs(tasks, chunks).select("task_id", F.struct("chunk_filepath", "chunk_chunk_no").alias("chunk_id"), F.col("chunk_tokens").alias("tokens"))
    plain = retrieval.top_k(retrieval.bm25(near, terms).withColumn("score", F.round("score", 6)), 4, [F.desc("score"), F.col("chunk_id")])
    want = {(r.task_id, r["rank"]): (*r.chunk_id, r.score) for r in plain.collect()}
    got = {(r.task_id, r["rank"]): (r.filepath, r.chunk_no, r.score) for r in retrieval.rank_bm25(terms, tasks, chunks, 4, block=2, slice_rows=2).collect()}
    assert want and got == want


def _most_rows(plan) -> int:
    """The greatest number of rows that a node of an executed plan gave."""
    inner = [getattr(plan, name)() for name, kind in (("executedPlan", "AdaptiveSparkPlan"), ("plan", "QueryStage")) if kind in plan.nodeName()]
    children = plan.children()
    below = [*inner, *(children.apply(k) for k in range(children.size()))]
    rows = plan.metrics().get("numOutputRows")
    return max([rows.get().value() if rows.isDefined() else 0, *map(_most_rows, below)])


def test_bm25_statistics_grow_with_words(spark):
    """No file meets each of its repository's document frequencies: rows stay below a few times the words."""
    rows = [("r", f"r/{k}", 0, [f"own{k}", *(f"in{j}" for j in range(1, 61) if k < j)]) for k in range(400)]
    chunks = spark.createDataFrame(rows, "repo string, filepath string, chunk_no int, tokens array<string>")
    tasks = chunks.select(F.col("filepath").alias("task_id"), "repo", "filepath")
    terms = tasks.select("task_id", F.lit("in3").alias("term"), F.lit(1.0).alias("weight"))
    found = retrieval.rank_bm25(terms, tasks, chunks, 2)
    assert len(found.collect()) == 800
    assert 0 < _most_rows(found._jdf.queryExecution().executedPlan()) <= 2 * sum(len(r[3]) for r in rows)


def test_bm25_rows_follow_files(spark):
    """Words, queries' terms and counts travel packed, a row for many: rows stay below a few times the files."""
    rows = [("r", f"r/{k}", 0, [f"own{k}", *(f"in{j}" for j in range(1, 61) if k < j)]) for k in range(400)]
    chunks = spark.createDataFrame(rows, "repo string, filepath string, chunk_no int, tokens array<string>")
    terms = chunks.where("filepath < 'r/3'").select(F.col("filepath").alias("task_id"), F.explode("tokens").alias("term"), F.lit(1.0).alias("weight"))
    found = retrieval.rank_bm25(terms, chunks.select(F.col("filepath").alias("task_id"), "repo", "filepath"), chunks, 2)
    assert len(found.collect()) == 800
    assert 0 < _most_rows(found._jdf.queryExecution().executedPlan()) <= 4 * len(rows)


def test_bm25_rough_scores_lose_no_chunk(spark):
    """A block above `PLAIN` texts, with equal texts in several files and within one, frequent and rare words, and queries without a word."""
    import random

    deal = random.Random(5)
    texts = [[f"w{int(deal.random() ** 3 * 300)}" for _ in range(deal.randint(1, 25))] for _ in range(330)]
    rows = [("r", f"f{k // 2 % 150:03d}", k % 2 + 2 * (k // 300), texts[k] if k % 9 else texts[0]) for k in range(330)]
    chunks = spark.createDataFrame(rows, "repo string, filepath string, chunk_no int, tokens array<string>")
    tasks = chunks.select("repo", "filepath").distinct().select(F.col("filepath").alias("task_id"), "repo", "filepath")
    terms = chunks.where("chunk_no = 0 AND filepath > 'f004'").select(F.col("filepath").alias("task_id"), F.explode("tokens").alias("term"), (F.lit(1.0) / (F.length("filepath") + F.pmod(F.xxhash64("filepath"), F.lit(3)))).alias("weight"))
    near = retrieval.pairs(tasks, chunks).select("task_id", F.struct("chunk_filepath", "chunk_chunk_no").alias("chunk_id"), F.col("chunk_tokens").alias("tokens"))
    plain = retrieval.top_k(retrieval.bm25(near, terms).withColumn("score", F.round("score", 6)), 5, [F.desc("score"), F.col("chunk_id")])
    want = {(r.task_id, r["rank"]): (*r.chunk_id, r.score) for r in plain.collect()}
    got = {(r.task_id, r["rank"]): (r.filepath, r.chunk_no, r.score) for r in retrieval.rank_bm25(terms, tasks, chunks, 5).collect()}
    assert len(want) == 750 and got == want


def test_blocks_and_slices_find_what_all_pairs_find(spark, files):
    """Blocks of 2 chunks and slices of 3 queries give the best of all pairs, by sets and by vectors."""
    from loomspan.functions import scores

    chunks = chunking.windows(files.select("repo", "filepath", "lines"), 3, 2).select("repo", "filepath", "chunk_no", "text")
    asked = files.select(F.col("filepath").alias("task_id"), "repo", "filepath", F.col("content").alias("query"))
    for name in ("jaccard_sim", "containment"):
        score = scores.jaccard if name == "jaccard_sim" else scores.containment
        every = retrieval.pairs(asked, chunks).withColumn("score", F.coalesce(score(retrieval.word_ids(F.col("query")), retrieval.word_ids(F.col("chunk_text"))), F.lit(0.0)))
        want = {(r.task_id, r["rank"]): (r.chunk_filepath, r.chunk_chunk_no, r.score) for r in retrieval.top_k(every, 4, [F.desc("score"), F.col("chunk_filepath"), F.col("chunk_chunk_no")]).collect()}
        got = {(r.task_id, r["rank"]): (r.chunk_filepath, r.chunk_chunk_no, r.score) for r in retrieval.rank_sets(asked, chunks, 4, name, block=2, slice_rows=3).collect()}
        assert want and got == want
    vectors = spark.createDataFrame([(k, "r", [float(k % 5), float(k % 3), 1.0]) for k in range(30)] + [(30, "r", [0.0, 0.0, 0.0])], "task_id long, repo string, vector array<double>")
    docs = vectors.withColumnRenamed("task_id", "doc_id")
    one = {(r.task_id, r["rank"]): r.doc_id for r in retrieval.rank_vectors(vectors, docs, 3).collect()}
    assert one == {(r.task_id, r["rank"]): r.doc_id for r in retrieval.rank_vectors(vectors, docs, 3, block=4, slice_rows=7).collect()}
    assert one[0, 1] == 15 and one[15, 1] == 0


def _exchanged(plan) -> int:
    """Bytes that the shuffles of an executed plan wrote."""
    inner = [getattr(plan, name)() for name, kind in (("executedPlan", "AdaptiveSparkPlan"), ("plan", "QueryStage")) if kind in plan.nodeName()]
    children = plan.children()
    below = [*inner, *(children.apply(k) for k in range(children.size()))]
    size = plan.metrics().get("dataSize") if plan.nodeName() == "Exchange" else None
    return (size.get().value() if size is not None and size.isDefined() else 0) + sum(map(_exchanged, below))


def test_selected_chunks_travel_without_their_texts(spark, tmp_path):
    """dedupe_selected compares digests: neither chunks nor the ten chunks of each query carry texts through a shuffle."""
    from sql_compare import assert_same, connect

    from loomspan.queries import QUERIES, SQL

    docs = [(k, "\n".join(f"w{k % 7} x{(k + j) % 5} " * 300 for j in range(12)), "en", f"src{k % 2}") for k in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).toPandas().to_parquet(tmp_path / "documents.parquet")
    found = QUERIES["dedupe_selected"](spark, str(tmp_path))
    assert assert_same(found, connect(str(tmp_path)), SQL["dedupe_selected"]) > 60
    assert len(found.collect()) > 60
    assert 0 < _exchanged(found._jdf.queryExecution().executedPlan()) < sum(len(d[1]) for d in docs) / 4


@pytest.mark.parametrize("name, ties, sample", [("jaccard_sim", "path", 1), ("containment", "path", 3), ("jaccard_sim", "text_desc", 1_000_000)])
def test_bounds_lose_no_chunk(spark, monkeypatch, name, ties, sample):
    """Bits, codes, bounds and leaders give what all pairs give: skewed words, equal sets, small sets and queries without words."""
    import random

    monkeypatch.setattr(retrieval, "CODE_SAMPLE", sample)
    rng = random.Random(5)
    some = lambda n: {f"w{int(3000 ** rng.random())}" for _ in range(n)}
    chunks = [("r", f"f{k // 3:04}", k % 3, " ".join(sorted(some(rng.choice([1, 4, 30, 90]))))) for k in range(3000)]
    asked = [(f"t{k}", "r", f"f{k:04}", "" if k % 9 == 0 else "none" if k % 9 == 1 else chunks[3 * k][3] if k % 9 == 2 else " ".join(some(rng.choice([3, 60])))) for k in range(90)]
    q = spark.createDataFrame(asked, "task_id string, repo string, filepath string, query string")
    c = spark.createDataFrame(chunks, "repo string, filepath string, chunk_no int, text string")
    got = {}
    for r in retrieval.rank_sets(q, c, 10, name, ties=ties).orderBy("task_id", "rank").collect():
        got.setdefault(r.task_id, []).append((r.chunk_filepath, r.chunk_chunk_no, r.score))
    sets = [(p, n, t, set(t.split())) for _, p, n, t in chunks]
    for task, _, own, text in asked:
        mine = set(text.split())
        rated = [((x := len(mine & w)) / (max(len(mine | w), 1) if name == "jaccard_sim" else max(len(mine), 1)), t, p, n) for p, n, t, w in sets if p != own]
        rated.sort(key=lambda r: r[2:])
        if ties == "text_desc":
            rated.sort(key=lambda r: r[1], reverse=True)
        rated.sort(key=lambda r: -r[0])
        assert got[task] == [(p, n, s) for s, _, p, n in rated[:10]], task


def test_files_within_and_first_candidates(spark):
    paths = ["r/a/x", "r/a/y", "r/b/x", "r/b/c/x", "r/z"]
    f = spark.createDataFrame([("r", p) for p in paths] + [("s", "s/x")], "repo string, filepath string")
    tasks = f.select(F.col("filepath").alias("task_id"), "repo", "filepath")
    near = retrieval.files_within(tasks, f, distance=2, most=3)
    got = {}
    for r in near.orderBy("task_id", "place").collect():
        got.setdefault(r.task_id, []).append((r.filepath, r.distance))
    assert got["r/a/x"] == [("r/a/y", 0), ("r/z", 1), ("r/b/x", 2)] and "s/x" not in got
    assert got["r/b/c/x"] == [("r/b/x", 1), ("r/z", 2)]
    chunks = spark.createDataFrame([("r", p, k) for p in paths for k in (0, 2)], "repo string, filepath string, chunk_no int")
    found = retrieval.first_candidates(near, chunks, 3).where("task_id = 'r/a/x'").orderBy("place").collect()
    assert [(r.filepath, r.chunk_no, r.place) for r in found] == [("r/a/y", 0, 1), ("r/a/y", 2, 2), ("r/z", 0, 3)]


@pytest.mark.parametrize("scorer", ["jaccard_sim", "containment", "edit_similarity", "weighted_ngram_match_score", "bm25", "bm25_lines", "bm25_weighted_v1", "cosine_similarity"])
def test_every_ranking_function(files, scorer):
    tasks = files.where("size(lines) > 1").select(F.col("filepath").alias("task_id"), "repo", "filepath", F.col("content").alias("prompt"), F.lit("a line2 tok2").alias("groundtruth"), F.lit("").alias("right_context"))
    encode = lambda: lambda texts: [[float(len(t)), float(t.count("a")), 1.0] for t in texts]
    got = {r.task_id: r.crossfile_context for r in experiments.attach_context(tasks, files, scorer=scorer, encode=encode).collect()}
    assert set(got) == {"r/a.py", "r/b.py"} and all("fragment can be found in" in t for t in got.values())


def test_valid_prefix_and_first_statement():
    from loomspan.functions import python_code as pc

    def plain(prompt, completion):
        for i in range(len(completion), -1, -1):
            if pc._parses(prompt + completion[:i]):
                return "parseable", completion[:i].rstrip()
        return "not_parseable", completion

    cases = ["a = b\nc = 3 = d\ne", "x = (a b\ny", "if a:\n    b\nc(", "s = 'abc\nd = 1", 'x = """a\nb\n', "print a\nb = 1", "a\n  b\n c", "", "1 +", "def f(:\n  pass", "a = [1,\n2,\n3\nb = 1", "é = ü\n3x = 1", "a\x00b\nc", "for x in y:\n    pass\nelse\n", "f(a, b=1, c)", "class A:\n    def m(self):\n        return 1\n    x =", "\tif x:\n", "x = {1: 2, 3}\ny = 1"]
    for code in cases:
        for prompt in ("", "v = 1\n", "if q:\n    w = 2\n"):
            assert pc._valid_prefix(prompt, code) == plain(prompt, code), (prompt, code)
    assert pc._first_statement("v = ", "[a,\nb]\nc = 1") == "[a,\nb]" and pc._first_statement("", "in is\nx") == "in is\nx"
    import time

    began = time.time()
    pc._valid_prefix("", "\n".join(f"a{k} = b" for k in range(3000)) + "\n3 = c\n" + "d = e\n" * 3000)
    assert time.time() - began < 5
