"""Predictions as a stream: rows of new files are scored as they come, and means by event-time window follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import evaluation

SCHEMA = "task_id STRING, pred STRING, done_at TIMESTAMP"


def scored(spark: SparkSession, folder: str, truths: DataFrame) -> DataFrame:
    """A stream of (task_id, done_at, em, es_distance) from JSON files of a folder, joined to a static table of truths."""
    rows = spark.readStream.schema(SCHEMA).json(folder).join(truths, "task_id")
    detail = evaluation.detail(rows.withColumn("pred", evaluation.truncated(F.col("pred"), F.col("target"))).withColumn("task_id", F.struct("task_id", "done_at")))
    return detail.select("task_id.task_id", "task_id.done_at", "em", "es_distance")


def windowed(rows: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Means by window; rows later than the watermark don't count."""
    return rows.withWatermark("done_at", late).groupBy(F.window("done_at", window).alias("w")).agg(F.avg("em").alias("em"), F.avg("es_distance").alias("es_distance"), F.count(F.lit(1)).alias("n"))
