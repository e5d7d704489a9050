"""Sliding line windows over files, function chunks and sampled chunks.

`files` holds one row per file: repo, filepath, lines (array of strings). Every function is narrow: rows multiply inside
their partition, nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import text as tx


def kept_windows(lines: Column, window: int, stride: int) -> Column:
    """A file's windows in order, as an array of structs start_i, end_i, text."""
    start = F.sequence(F.lit(0), F.size(lines) - 1, F.lit(stride))
    starts = F.when(F.size(lines) > 0, start).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda i: F.struct(i.alias("start_i"), (i + window).alias("end_i"), F.array_join(F.slice(lines, i + 1, window), "\n").alias("text")))
    return F.filter(cut, lambda c: c["text"].rlike(tx.WORD))


def windows(files: DataFrame, window: int, stride: int, lines: str = "lines") -> DataFrame:
    """One row per window: starts 0, stride, ... below the number of lines; short tails stay; end_i = start_i + window.

    Windows without a word token are dropped; chunk_no counts the kept ones of a file.
    """
    kept = kept_windows(F.col(lines), window, stride)
    return files.select(*(c for c in files.columns if c != lines), F.posexplode(kept).alias("chunk_no", "c")).select("*", "c.start_i", "c.end_i", "c.text").drop("c")


def window_configs(oracle_in_query: bool = False) -> list[tuple[int, int]]:
    """The first is for sampling; the others by number of lines 1 to 9: 10 (11 with the target in the query) times that, and half of it as the stride."""
    span = 11 if oracle_in_query else 10
    return [(10, 10), *((span * k, span * k // 2) for k in range(1, 10))]


def multi_windows(files: DataFrame, configs: list[tuple[int, int]]) -> DataFrame:
    """Windows of several configurations in one pass over the files: window, stride and the columns of `windows`."""
    table = F.array(*(F.struct(F.lit(w).alias("window"), F.lit(s).alias("stride")) for w, s in configs))
    each = files.withColumn("cfg", F.explode(table)).withColumns({"window": F.col("cfg.window"), "stride": F.col("cfg.stride")}).drop("cfg")
    starts = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1, F.col("stride"))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda i: F.struct(i.alias("start_i"), (i + F.col("window")).alias("end_i"), F.array_join(F.slice("lines", i + 1, F.col("window")), "\n").alias("text")))
    kept = F.filter(cut, lambda c: c["text"].rlike(tx.WORD))
    return each.select(*(c for c in each.columns if c != "lines"), F.posexplode(kept).alias("chunk_no", "c")).select("*", "c.start_i", "c.end_i", "c.text").drop("c")


def config_for(n_lines: Column, span: int = 10) -> Column:
    """The window for a target of so many lines: span * n for n up to 9, else null (the row is dropped)."""
    return F.when(n_lines.between(1, 9), n_lines * span)


def function_config_for(n_lines: Column, largest: int = 9) -> Column:
    """The window for a function of so many lines: 10 * n, else 50."""
    return F.when(n_lines.between(1, largest), n_lines * 10).otherwise(F.lit(50))


def function_chunks(files: DataFrame, min_lines: int = 3, max_lines: int = 30) -> DataFrame:
    """Bodies of functions: `files` with spans (array of start_row, end_row): rows start_row + 1 to end_row, blank lines kept."""
    each = files.select("*", F.explode("spans").alias("s")).drop("spans")
    body = F.slice("lines", F.col("s.start_row") + 2, F.greatest(F.col("s.end_row") - F.col("s.start_row"), F.lit(0)))
    each = each.withColumn("body", body).withColumn("n", F.size("body")).where(F.col("n").between(min_lines, max_lines))
    each = each.withColumns({"start_i": F.col("s.start_row") + 1, "end_i": F.col("s.end_row") + 1, "text": F.array_join("body", "\n")})
    return each.where(F.col("text").rlike(r"\S")).drop("s", "body", "n")


def intact_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with text, as many lines as end_i - start_i, and equal to that slice of `lines`."""
    body = F.array_join(F.slice("lines", F.col("start_i") + 1, F.greatest(F.col("end_i") - F.col("start_i"), F.lit(0))), "\n")
    return chunks.where(F.col("text").rlike(r"\S") & (F.size(F.split("text", "\n")) == F.col("end_i") - F.col("start_i")) & (F.col("text") == body))
