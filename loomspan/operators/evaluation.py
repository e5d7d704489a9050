"""Predictions against truths: joins, per-row metrics, summaries, thresholds and batch figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import python_code, scores
from loomspan.functions import text as tx


def with_truth(preds: DataFrame, truths: DataFrame) -> DataFrame:
    return preds.join(truths, "task_id")


def missing(truths: DataFrame, preds: DataFrame) -> DataFrame:
    """Truths without a prediction."""
    return truths.join(preds.select("task_id"), "task_id", "left_anti")


def in_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("task_id").distinct(), "task_id", "left_semi")


def focused(rows: DataFrame, repos: list[str], column: str = "task_id") -> DataFrame:
    """Rows whose id, with / as _, contains one of the repositories' names."""
    flat = F.translate(F.col(column), "/", "_")
    return rows.where(reduce(lambda a, b: a | b, [flat.contains(r.replace("/", "_")) for r in repos], F.lit(False)))


def truncated(pred: Column, target: Column) -> Column:
    """As many non-blank lines of the prediction as the target has."""
    return F.array_join(tx.head(tx.nonblank_lines(pred), F.size(tx.nonblank_lines(target))), "\n")


def detail(rows: DataFrame, pred: str = "pred", target: str = "target") -> DataFrame:
    """task_id, em (0 or 1), es (0 to 100, by matched characters) and es_distance (0 to 1, by edit distance) on trimmed texts."""
    p, t = tx.strip(F.col(pred)), tx.strip(F.col(target))
    return rows.select("task_id", scores.exact_match(F.col(pred), F.col(target)).cast("int").alias("em"), python_code.fuzz_ratio(pred, target).alias("es"), scores.edit_similarity(p, t).alias("es_distance"))


def id_detail(rows: DataFrame, language: str | None = None, pred: str = "pred", target: str = "target") -> DataFrame:
    """task_id, id_em, id_precision, id_recall, id_f1."""
    m = scores.id_match(tx.identifiers(F.col(pred), language), tx.identifiers(F.col(target), language))
    return rows.select("task_id", m.alias("m")).select("task_id", F.col("m.em").alias("id_em"), F.col("m.precision").alias("id_precision"), F.col("m.recall").alias("id_recall"), F.col("m.f1").alias("id_f1"))


def summary(rows: DataFrame, percents: dict[str, str]) -> DataFrame:
    """One row: 100 times the mean of each column under its new name, and total."""
    return rows.agg(*((100 * F.avg(F.col(c).cast("double"))).alias(n) for n, c in percents.items()), F.count(F.lit(1)).alias("total"))


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def modal_length(rows: DataFrame, length: Column) -> DataFrame:
    """Rows not longer than the most frequent length; of equally frequent ones the shortest. The mode joins as one row."""
    counts = rows.select(length.alias("len")).groupBy("len").agg(F.count(F.lit(1)).alias("n"))
    mode = counts.agg(F.max(F.struct("n", (-F.col("len")).alias("l"))).alias("m")).select((-F.col("m.l")).alias("modal"))
    return rows.crossJoin(F.broadcast(mode)).where(length <= F.col("modal"))


def latency(rows: DataFrame, gen_length: int) -> DataFrame:
    """rows (batch, latency) by batch: mean latency and that per generated token."""
    return rows.groupBy("batch").agg(F.avg("latency").alias("sample_latency")).withColumn("sample_latency_per_token", F.col("sample_latency") / gen_length)


def route(rows: DataFrame, threshold: float, routing: str = "intended") -> DataFrame:
    """rows (retrieval_prob, pred_plain, pred_context) with do_retrieval and pred. "as_coded" swaps the two predictions."""
    go = F.col("retrieval_prob") > threshold
    pick = go if routing == "intended" else ~go
    return rows.withColumn("do_retrieval", go).withColumn("pred", F.when(pick, F.col("pred_context")).otherwise(F.col("pred_plain")))


def rag_ratio(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg(F.col("do_retrieval").cast("double")).alias("rag_ratio"))


def batch_retrieval_metrics(rows: DataFrame) -> DataFrame:
    """rows (batch, has_cfc, pred_cfc, rank) by batch: precision, recall, f1, mrr over rows that have context; 0 where undefined."""
    hit = F.count_if(F.col("has_cfc") & F.col("pred_cfc")).cast("double")
    per = rows.groupBy("batch").agg(hit.alias("hit"), F.count_if("pred_cfc").alias("predicted"), F.count_if("has_cfc").alias("actual"), F.coalesce(F.avg(F.when(F.col("has_cfc"), 1 / F.col("rank").cast("double"))), F.lit(0.0)).alias("mrr"))
    per = per.withColumns({"precision": F.coalesce(F.col("hit") / F.nullif(F.col("predicted").cast("double"), F.lit(0.0)), F.lit(0.0)), "recall": F.coalesce(F.col("hit") / F.nullif(F.col("actual").cast("double"), F.lit(0.0)), F.lit(0.0))})
    both = F.col("precision") + F.col("recall")
    return per.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)).select("batch", "precision", "recall", "f1", "mrr")


def mean_retrieval_metrics(per_batch: DataFrame) -> DataFrame:
    return per_batch.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1", "mrr")))


def losses(rows: DataFrame, weight: float = 1.0) -> DataFrame:
    """rows (loss_cfc, loss_code) of batches, NaN or null counting 0: means, their weighted sum and the perplexity of the code loss."""
    zero = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    means = rows.agg(F.avg(zero("loss_cfc")).alias("loss_cfc"), F.avg(zero("loss_code")).alias("loss_code"))
    return means.withColumns({"loss": weight * F.col("loss_cfc") + F.col("loss_code"), "perplexity": F.exp("loss_code")})


def token_counts(rows: DataFrame) -> DataFrame:
    """rows (batch, ids, mask) by batch: distinct ids under the mask, and how many tokens it keeps."""
    kept = rows.select("batch", F.explode(F.filter(F.arrays_zip("ids", "mask"), lambda x: x["mask"] == 1)).alias("x"))
    return kept.groupBy("batch").agg(F.count_distinct("x.ids").alias("unique_tokens"), F.count(F.lit(1)).alias("all_tokens"))
