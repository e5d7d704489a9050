"""A training corpus in five stages; each function takes (spark, docs, sf_dir) and gives the next stage's documents.

The last stage gives packed pieces instead. `run` writes and rereads between the stages, as the stages' own results are
to be kept on a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import stages
from loomspan.llm._shared import Scratch

STAGES = [
    ("language_id", stages.known_language),
    ("line_dedup", stages.without_repeated_lines),
    ("ngram_jaccard_join", stages.one_of_each_group),
    ("mixing", stages.mixed),
    ("best_fit_packing", stages.packed),
]
#: Compression, MinHash bands and a tokenizer have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name, codec="zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
