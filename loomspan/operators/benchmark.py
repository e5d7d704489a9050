"""Benchmark preparation: package files, prompts joined to files, integrity checks, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.queries import benchmark_task

def canonical_repository(name: Column) -> Column:
    """owner--name, as function prompts have it, as owner_name."""
    return F.regexp_replace(name, "--", "_")


def with_urls(rows: DataFrame, listed: DataFrame, repo: str = "repo", host: str = "https://github.com/") -> DataFrame:
    """rows with url, the address of owner_name; null for a repository that `listed(repo)` doesn't name. The owner ends at the first underscore."""
    known = listed.select(F.col("repo").alias("__listed")).where("__listed IS NOT NULL").distinct()
    url = F.when(F.col("__listed").isNotNull(), F.concat(F.lit(host), F.regexp_replace(repo, "^([^_]*)_", "$1/")))
    return rows.join(known, F.col(repo) == F.col("__listed"), "left").withColumn("url", url).drop("__listed")


def package_files(files: DataFrame, listed: DataFrame, source: str = "github", license_name: str = "", language: str = "python") -> DataFrame:
    """Package records from (repo, filepath, content)."""
    content = F.array(F.struct(F.lit("text").alias("type"), F.lit(language).alias("lang"), F.col("content").alias("content")))
    return with_urls(files, listed).select(F.lit(source).alias("source"), "url", F.lit(license_name).alias("license"), F.lit("").alias("patent"), F.col("repo").alias("repository"), "filepath", content.alias("content"))


def completion_tasks(prompts: DataFrame, files: DataFrame, kind: str) -> DataFrame:
    """Tasks from prompts (repo, filepath, task_id, line_no, n_lines) and files (repo, filepath, lines); prompts without a line number go."""
    each = prompts.where(F.col("line_no").isNotNull()).join(files.select("repo", "filepath", "lines"), ["repo", "filepath"])
    parts = benchmark_task(F.col("lines"), F.col("line_no"), F.col("n_lines"), kind)
    return each.withColumn("t", parts).select("task_id", "repo", "filepath", "lines", "t.*")


def violations(tasks: DataFrame) -> DataFrame:
    """Tasks whose prompt, target and right context don't stand together in the file."""
    whole = F.concat("prompt", "groundtruth", "right_context")
    return tasks.where(~F.array_join("lines", "\n").contains(whole))


def renumbered(tasks: DataFrame, order: str) -> DataFrame:
    """tasks with number: 0, 1, ... in each repository."""
    return tasks.withColumn("number", F.row_number().over(Window.partitionBy("repo").orderBy(order)) - 1)
