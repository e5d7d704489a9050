"""The stages of the corpus pipeline: each applies one operator, and all but the last keep the columns of documents.

Defined results: rows that share a doc_id are copies of one document until mixing, which takes each by itself; after it a
document stands once for each round that took it, cut to the words that the round took. A row with a null doc_id is a
document of its own: line dedup takes no line from it, the n-gram join keeps it if no similar document has an id or an
earlier row, mixing takes it as any other. Null texts are rejected by the
first stage. An empty table stays empty through all stages. Column names that begin with two underscores are the stages' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import langid, line_dedup, mixing, ngram_join, packing
from loomspan.llm._shared import Scratch, spread, stored_bytes


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the dictionaries settle."""
    dictionaries = langid.train_dictionaries(docs.where(~langid.held_out("doc_id")))
    return langid.identify(spread(docs), dictionaries).where("NOT rejected").select(docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the lines that repeat earlier ones; a document that has nothing left but white space goes."""
    kept = line_dedup.without_lines(docs).where(r"__removed = 0 OR text RLIKE '\\S'")
    return kept.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


#: The stage's shingles and threshold; four words and 0.85 are those of the query of op8.
WORDS, NUM, DEN = 5, 80, 100


#: Stored bytes of the mix's input for each task that writes a part of a shard.
TASK_BYTES = 32 << 20


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with a key of each row in __row, written, so that every reading has the same."""
    return Scratch(docs.sparkSession, name).keep(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered", codec="zstd")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar rows the one with the smallest id, and the component's copies of that id."""
    rows = _numbered(docs, "groups")
    parts = ngram_join.jaccard_components(rows, id_col="__row", words=WORDS, num=NUM, den=DEN).select(F.col("doc_id").alias("row"), F.col("component_id").alias("part"))
    named = rows.select("__row", F.col("doc_id").alias("id")).join(parts, F.col("__row") == F.col("row")).select("row", "part", "id")
    first = named.groupBy("part").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("m")).select(F.col("part").alias("p"), "m")
    kept = named.join(first, F.col("part") == F.col("p")).where("id = m.id OR row = m.row").select("row")
    return rows.join(kept, F.col("__row") == F.col("row"), "left_semi").drop("__row")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row once for each draw of the mix that takes it, cut to the words that the draw takes, in the order of the mix's shards."""
    numbered = _numbered(docs, "mixed")
    draws, _ = mixing.mix(numbered, row_col="__row")
    draws = draws.select(F.col("row").alias("__taken"), F.col("words").alias("__words"), F.col("shard").alias("__shard"), F.col("position").alias("__position"))
    rows = numbered.join(draws, F.col("__row") == F.col("__taken"))
    whole = F.regexp_count("text", F.lit(mixing.WORD)) <= F.col("__words")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({mixing.WORD})")), 1, F.col("__words").cast("int")), " ")
    text = F.when(whole, F.col("text")).otherwise(cut)
    rows = rows.withColumn("__text", text).select("__shard", "__position", *(F.col("__text").alias(c) if c == "text" else F.length("__text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))
    # A shard is written by as many tasks as its size asks for, each with its part of the shard's draws in their order.
    parts = max(-(-int(spark.conf.get("spark.sql.shuffle.partitions")) // mixing.SHARDS), -(-stored_bytes(numbered) // (mixing.SHARDS * TASK_BYTES)))
    task = (F.col("__shard") * parts + F.pmod("__position", F.lit(parts))).cast("int")
    return rows.repartitionById(mixing.SHARDS * parts, task).sortWithinPartitions("__position").drop("__shard", "__position")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their places in the sequences."""
    import public_tokenizers

    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
