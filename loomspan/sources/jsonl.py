"""Readers and writers of the record files: repositories, packages, prompts, tasks, scores, predictions, token rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import text as tx

REPOSITORY = "repo_name STRING, stars_count BIGINT, files ARRAY<STRUCT<filepath STRING, content STRING, metadata STRUCT<size BIGINT, lang STRING, ext STRING, hexsha STRING, avg_line_length DOUBLE, max_line_length BIGINT, line_count BIGINT, non_empty_line_count BIGINT, imports ARRAY<STRING>, local_imports ARRAY<STRING>, functions ARRAY<ARRAY<ARRAY<INT>>>>>>, repo_size STRUCT<number_of_files BIGINT, lines_of_code BIGINT>"
PACKAGE = "source STRING, url STRING, license STRING, patent STRING, repository STRING, filepath STRING, content ARRAY<STRUCT<type STRING, lang STRING, content STRING>>"
PROMPT = "prompt STRING, metadata STRUCT<task_id STRING, ground_truth STRING, fpath_tuple ARRAY<STRING>, context_start_lineno INT, line_no INT, lineno INT>"
TASK = "prompt STRING, groundtruth STRING, right_context STRING, full_left_context STRING, full_right_context STRING, crossfile_context STRING, ranking_latency DOUBLE, metadata STRUCT<task_id STRING, filepath STRING, repository STRING, url STRING, filename STRING, start_i INT, end_i INT>, es_infile DOUBLE, es_rg1 DOUBLE, generation_model STRING"
PREDICTION = "task_id STRING, pred STRING, latency DOUBLE, sample_latency DOUBLE, sample_latency_per_token DOUBLE, max_prob_first_token DOUBLE, max_prob_lower_bound DOUBLE, max_prob_all_tokens DOUBLE, entropy_first_token DOUBLE, entropy_all_tokens DOUBLE, retrieval_prob DOUBLE, do_retrieval BOOLEAN"
SCORES = "task_id STRING, em DOUBLE, es DOUBLE, es_repoeval DOUBLE"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def repository_files(repositories: DataFrame) -> DataFrame:
    """One row per file: repo, filepath with the repository before it, content, lines (not blank), spans of functions."""
    each = repositories.select(F.col("repo_name").alias("repo"), F.explode("files").alias("f"))
    spans = F.transform(F.coalesce("f.metadata.functions", F.array().cast("array<array<array<int>>>")), lambda s: F.struct(s[0][0].alias("start_row"), s[1][0].alias("end_row")))
    return each.select("repo", F.concat_ws("/", "repo", "f.filepath").alias("filepath"), F.col("f.content").alias("content"), tx.nonblank_lines(F.col("f.content")).alias("lines"), spans.alias("spans"))


def package_files(packages: DataFrame) -> DataFrame:
    return packages.select(F.col("repository").alias("repo"), "filepath", F.col("content")[0]["content"].alias("content"))


def source_tree(spark: SparkSession, base: str, suffix: str = "py") -> DataFrame:
    """(path, content) of all files below a folder; files that aren't UTF-8 have the replacement character."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(base)
    root = base.split(":", 1)[-1].rstrip("/")
    return files.select(F.substring_index("path", root + "/", -1).alias("path"), F.decode("content", "utf-8").alias("content"))


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def context_string(context: Column) -> Column:
    """A crossfile context given as text, or as a JSON object with its text."""
    return F.when(context.startswith("{"), F.coalesce(F.get_json_object(context, "$.text"), context)).otherwise(context)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with index 0, 1, ... by a stable key."""
    return rows.withColumn("index", F.row_number().over(Window.orderBy(*order)) - 1)


def with_origin(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Records of all JSON lines files of a folder with origin (last two parts of the path) and origin_index (line of the file)."""
    raw = spark.read.text(folder).select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("a"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("b"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("i"), "value")
    placed = raw.withColumn("origin", F.concat_ws("/", "a", "b")).withColumn("origin_index", F.row_number().over(Window.partitionBy("origin").orderBy("s", "i")) - 1)
    return placed.select(F.from_json("value", schema).alias("content"), "origin", "origin_index")


def token_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The column that training reads, as input_ids."""
    rows = spark.read.parquet(path)
    return rows.select(F.col("token_ids" if "token_ids" in rows.columns else "input_ids").alias("input_ids"))


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    return rows.orderBy(F.rand(seed))


def write_shards(rows: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder per shard of JSON lines."""
    rows.write.partitionBy(shard).json(path)


def write(rows: DataFrame, path: str, kind: str = "json") -> None:
    rows.write.format(kind).save(path)


def write_splits(rows: DataFrame, path: str) -> None:
    rows.write.partitionBy("split").parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share; in local mode and without it, a temporary one."""
    key = "spark.checkpoint.dir"
    folder = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {key} to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomspan-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def output_path(source: str, suffix: str, base_predictions: str | None = None) -> str:
    """Beside the input, or beside the base predictions, with the suffix before the extension."""
    folder = (base_predictions or source).rpartition("/")[0]
    stem, dot, extension = source.rpartition("/")[2].rpartition(".")
    name = f"{stem}.{suffix}.{extension}" if dot else f"{extension}.{suffix}"
    return f"{folder}/{name}" if folder else name
