"""Labelled examples: two scores joined to tasks, labels, statistics, and training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import tokens as tk

CLM_MARK = "####CLM_DATA"


def first_rows(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row of each key: the first by the order (use descending columns for the last)."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("n = 1").drop("n")


def score_join(tasks: DataFrame, baseline: DataFrame, augmented: DataFrame, generation_model: str = "") -> DataFrame:
    """tasks with es_infile and es_rg1; tasks without both scores go. Score tables: task_id, es, one row a task."""
    with_base = tasks.join(baseline.select("task_id", F.col("es").alias("es_infile")), "task_id")
    return with_base.join(augmented.select("task_id", F.col("es").alias("es_rg1")), "task_id").withColumn("generation_model", F.lit(generation_model))


def gain_labels(rows: DataFrame, gain: float = 0.0, loss: float = 0.1) -> DataFrame:
    """rows with positive (strictly more than `gain` better with context) and neg_retrieval (more than `loss` worse)."""
    return rows.withColumns({"positive": F.col("es_rg1") - F.col("es_infile") > gain, "neg_retrieval": F.col("es_infile") - F.col("es_rg1") > loss})


def label_stats(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: mean and population deviation of line counts, examples that improve, and their share of the baseline's scores."""
    count = lambda c: F.size(F.split(c, "\n")).cast("double")
    stats = []
    for name, column in (("left", "prompt"), ("right", "right_context"), ("target", "groundtruth")):
        stats += [F.avg(count(column)).alias(f"{name}_mean"), F.stddev_pop(count(column)).alias(f"{name}_std")]
    whole = baseline.agg(F.count(F.lit(1)).alias("n_baseline"))
    found = rows.agg(*stats, F.count_if(F.col("es_rg1") > F.col("es_infile")).alias("n_improved"))
    return found.crossJoin(whole).withColumn("improved_ratio", F.col("n_improved") / F.nullif(F.col("n_baseline").cast("double"), F.lit(0.0)))


def training_rows(rows: DataFrame, ids: dict[str, int], seq_length: int = 2048, ratio: float = 2.0, pad: int = 0) -> DataFrame:
    """rows (task_id, lc, rc, tgt, cfc, positive, neg_retrieval) with token_ids: cut to the budget, laid out, padded; sequences that are still too long go."""
    cut = rows.withColumn("budget", tk.context_budget(seq_length, F.col("tgt"), F.col("cfc"), ratio))
    left, right = tk.tx.python_tail(F.col("lc"), F.col("budget.lc")), tk.tx.python_head(F.col("rc"), F.col("budget.rc"))
    cut = cut.withColumns({"__left": left, "__right": right})
    kind = F.when(F.col("positive"), "positive").when(F.col("neg_retrieval"), "neg_retrieval").otherwise("negative")
    laid = tk.layout(kind, F.col("__left"), F.col("__right"), F.col("tgt"), F.col("cfc"), ids)
    plain = tk.tx.head(F.col("lc"), seq_length)
    laid = F.when(F.col("task_id").contains(CLM_MARK), plain).otherwise(laid)
    return cut.withColumn("token_ids", tk.pad_right(laid, seq_length, pad)).where(F.size("token_ids") <= seq_length).drop("budget", "__left", "__right")
