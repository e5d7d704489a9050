"""Experiments: which prompt an experiment uses, where its files lie, sweeps, and the three pipelines."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import scores
from loomspan.functions import text as tx
from loomspan.operators import chunking, evaluation, generation, labels, queries, retrieval, sampling

#: Experiment -> model type.
MODEL_TYPES = {"baseline": "codelm", "rg1": "codelm_cfc", "oracle": "codelm_cfc", "repocoder": "codelm_cfc", "lrcontext": "codelm_leftright_context"}
#: Model type and whether fill-in-the-middle marks are used -> prompt kind.
PROMPTS = {
    ("codelm", False): "left",
    ("codelm", True): "left_fim",
    ("codelm_cfc", False): "cfc_left",
    ("codelm_cfc", True): "cfc_fim",
    ("codelm_leftright_context", False): "right_left",
    ("codelm_leftright_context", True): "left_right_fim",
    ("codelm_right_cfc_left", False): "right_cfc_left",
    ("codelm_right_cfc_left", True): "right_cfc_left_fim",
}
#: Retrieval settings by task: window, stride, query lines, top k.
RETRIEVAL = {"line": (10, 5, 10, 10), "api": (10, 5, 10, 10), "function": (20, 10, 20, 5)}
#: Retrieval thresholds by task.
THRESHOLDS = {"line": 0.2, "api": 0.2, "multilingual": 0.2, "function": 0.15}
GENERATED = {"line": 50, "api": 50, "function": 256}


def model_type(experiment: str) -> str:
    if experiment.startswith("rcfcl_"):
        return "codelm_right_cfc_left"
    if experiment.startswith("cfcrl_"):
        return "codelm_cfc_right_left"
    return MODEL_TYPES[experiment]


def prompt_kind(experiment: str, fim: bool) -> str:
    """Raises KeyError for a model type that no evaluator takes."""
    return PROMPTS[model_type(experiment), fim]


def paths(root: str, experiment: str, retriever: str, task: str, language: str = "python") -> dict[str, str]:
    base = f"{root}/exp={experiment}/retriever={retriever}/task={task}/lang={language}"
    return {"prompts": f"{base}/prompts", "output": f"{base}/output"}


def sweeps() -> list[dict]:
    """Retrieval runs: sparse, weighted n-grams, dense; each by task and by both main query types."""
    return [{"ranking": r, "task": t, "query_type": q} for r, t, q in product(("jaccard_sim", "weighted_ngram_match_score", "cosine_similarity"), ("line", "api", "function"), ("last_n_lines", "groundtruth"))]


def attach_context(tasks: DataFrame, files: DataFrame, task: str = "line", query_type: str = "last_n_lines", scorer: str = "jaccard_sim", most_chunks: int = 1000, encode=None) -> DataFrame:
    """tasks (task_id, repo, filepath, prompt, groundtruth, right_context[, pred]) with crossfile_context.

    Files of the repository by path distance, their first chunks, scores, top k, neighbours, distinct texts, text.
    `scorer`: a name of retrieval.SCORERS or BM25, or cosine_similarity, for which `encode` loads a function from texts to vectors.
    """
    window, stride, length, k = RETRIEVAL[task]
    chunks = retrieval.with_neighbours(chunking.windows(files.select("repo", "filepath", tx.nonblank_lines(F.col("content")).alias("lines")), window, stride))
    pred = F.col("pred") if "pred" in tasks.columns else F.lit(None).cast("string")
    query = queries.build_query(query_type, F.col("prompt"), F.col("groundtruth"), F.col("right_context"), pred, length)
    near = retrieval.files_within(tasks, files, most=1000)
    candidates = retrieval.first_candidates(near, chunks, most_chunks)
    asked = tasks.select("task_id", query.alias("query"))
    scored = _scored(candidates, asked, scorer, encode)
    best = retrieval.top_k(scored, k, [F.desc("score"), F.desc("text"), F.desc("filepath"), F.col("chunk_no")])
    shown = {"same": "text", "next": "next_text", "previous": "previous_text"}[queries.neighbour_mode(query_type)]
    chosen = best.select("task_id", "rank", "filepath", F.col(shown).alias("text"))
    if shown != "text":
        chosen = retrieval.distinct_texts(chosen)
    return tasks.join(retrieval.context_text(chosen), "task_id", "left").withColumn("crossfile_context", F.coalesce("crossfile_context", F.lit("")))


def _scored(candidates: DataFrame, asked: DataFrame, scorer: str, encode) -> DataFrame:
    """candidates (task_id, filepath, chunk_no, text) with the score against asked (task_id, query); 0 where there is none."""
    if scorer in retrieval.BM25:
        lines = tx.nonblank_lines(F.col("query"))
        version = retrieval.BM25[scorer]
        weights = F.array_repeat(F.lit(1.0), F.size(lines)) if not version else scores.line_weights(F.size(lines), F.lit(0), version)
        lined = asked.select("task_id", F.explode(F.arrays_zip(lines.alias("line"), weights.alias("weight"))).alias("x")).where("x.line IS NOT NULL")
        terms = lined.select("task_id", F.explode(tx.word_tokens(F.col("x.line"))).alias("term"), F.col("x.weight").alias("weight"))
        chunk = F.struct("filepath", "chunk_no").alias("chunk_id")
        found = retrieval.bm25(candidates.select("task_id", chunk, tx.word_tokens(F.col("text")).alias("tokens")), terms)
        return candidates.join(found.select("task_id", "chunk_id.*", "score"), ["task_id", "filepath", "chunk_no"])
    if scorer == "cosine_similarity":
        texts = candidates.select("text").unionByName(asked.select(F.col("query").alias("text"))).distinct()
        vectors = generation.encoded(texts, encode)
        left = candidates.join(vectors.withColumnRenamed("vector", "chunk_vector"), "text")
        right = asked.join(vectors.select(F.col("text").alias("query"), F.col("vector").alias("query_vector")), "query")
        both = left.join(right, "task_id").withColumn("score", F.coalesce(scores.cosine(F.col("query_vector"), F.col("chunk_vector")), F.lit(0.0)))
        return both.drop("query", "query_vector", "chunk_vector")
    return candidates.join(asked, "task_id").withColumn("score", F.coalesce(retrieval.SCORERS[scorer](F.col("query"), F.col("text")), F.lit(0.0))).drop("query")


def training_examples(files: DataFrame, oracle: bool = False, k: int = 3, mean: float = 3.0, seed: int = 42, language: str = "python") -> DataFrame:
    """Sampled holes with contexts from files (repo, filepath, lines): chunks of 10 lines, of them a hash sample, a few lines of each, and the best chunks of ten times as many lines from other files."""
    base = chunking.windows(files, 10, 10).withColumn("key", F.concat_ws("|", "filepath", "start_i"))
    base = sampling.capped(base, "repo", F.col("key"), 1000, seed)
    held = sampling.poisson_windows(base.withColumn("lines", F.split("text", "\n")).select("repo", "filepath", "key", "start_i", "lines"), F.col("key"), mean, seed)
    held = held.select("repo", "filepath", (F.col("start_i") + F.col("offset")).alias("start"), (F.col("start_i") + F.col("offset") + F.col("n_lines")).alias("end"), "n_lines")
    span = 11 if oracle else 10
    tasks = held.join(files, ["repo", "filepath"]).withColumn("window", chunking.config_for(F.col("n_lines"), span)).where("window IS NOT NULL")
    left, right = F.slice("lines", 1, F.col("start")), F.slice("lines", F.col("end") + 1, F.greatest(F.size("lines") - F.col("end"), F.lit(0)))
    query = queries.chunk_query(left, F.slice("lines", F.col("start") + 1, F.col("n_lines")), right, oracle)
    tasks = tasks.withColumn("task_id", F.concat(F.col("filepath"), F.lit("/"), F.col("start"), F.lit("_"), F.col("end"))).withColumn("t", queries.chunk_task(F.col("lines"), F.col("start"), F.col("end"))).withColumn("query_words", retrieval.word_ids(query))
    chunks = chunking.multi_windows(files, chunking.window_configs(oracle)[1:]).select("repo", "window", "filepath", "chunk_no", "text", retrieval.word_ids(F.col("text")).alias("words"))
    other = chunks.select(*(F.col(c).alias(f"c_{c}") for c in chunks.columns))
    scored = tasks.select("task_id", "repo", "filepath", "window", "query_words").join(other, (F.col("repo") == F.col("c_repo")) & (F.col("window") == F.col("c_window")) & (F.col("filepath") != F.col("c_filepath")))
    scored = scored.withColumn("score", F.coalesce(scores.jaccard(F.col("query_words"), F.col("c_words")), F.lit(0.0))).select("task_id", "score", F.col("c_filepath").alias("filepath"), F.col("c_chunk_no").alias("chunk_no"), F.col("c_text").alias("text"))
    best = retrieval.top_k(scored, k, [F.desc("score"), F.col("filepath"), F.col("chunk_no")])
    sign = tx.COMMENT_SIGNS[language]
    return tasks.select("task_id", "repo", "filepath", "start", "end", "t.*").join(retrieval.context_text(best, sign), "task_id", "left").withColumn("crossfile_context", F.coalesce("crossfile_context", F.lit(f"{sign} {retrieval.CONTEXT_HEAD}\n\n")))


def evaluate(preds: DataFrame, truths: DataFrame, language: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(per row, one row of means): preds (task_id, pred), truths (task_id, target)."""
    rows = evaluation.with_truth(preds, truths)
    rows = rows.withColumn("pred", evaluation.truncated(F.col("pred"), F.col("target")))
    per_row = evaluation.detail(rows).join(evaluation.id_detail(rows, language), "task_id")
    return per_row, evaluation.summary(per_row.withColumn("es", F.col("es") / 100), {"em": "em", "es": "es", "es_distance": "es_distance", "id_em": "id_em", "id_precision": "id_precision", "id_recall": "id_recall", "id_f1": "id_f1"})


def label(tasks: DataFrame, baseline: DataFrame, augmented: DataFrame) -> DataFrame:
    return labels.gain_labels(labels.score_join(tasks, baseline, augmented))


def run_name(model: str, dataset: str, learning_rate: float, batch_size: int, seq_length: int, **more: object) -> str:
    """The name of an experiment's folder: its settings, joined by underscores."""
    parts = [model.rstrip("/").rpartition("/")[2], dataset, f"lr{learning_rate:g}", f"bs{batch_size}", f"len{seq_length}", *(f"{k}{v}" for k, v in more.items())]
    return "_".join(parts)
