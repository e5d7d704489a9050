"""Queries from the text around a hole, and the fields of completion tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions import text as tx

QUERY_TYPES = ("groundtruth", "last_n_lines", "first_n_lines", "repocoder", "left_last_and_right_first")


def build_query(query_type: str, prompt: Column, groundtruth: Column, right: Column, pred: Column | None = None, length: int = 10, hyp_lines: int = 10, both_sides: bool = False) -> Column:
    """The query text; all parts by non-blank lines."""
    left, ahead = tx.nonblank_lines(prompt), tx.nonblank_lines(right)
    if query_type == "groundtruth":
        found = tx.tail(F.concat(left, tx.nonblank_lines(groundtruth)), length)
    elif query_type == "last_n_lines":
        found = tx.tail(left, length)
    elif query_type == "first_n_lines":
        found = tx.head(ahead, length)
    elif query_type == "left_last_and_right_first":
        found = F.concat(tx.python_tail(left, F.lit(length // 2)), tx.head(ahead, length - length // 2))
    elif query_type == "repocoder":
        guess = tx.nonblank_lines(pred)
        used = F.least(F.size(guess), F.lit(hyp_lines))
        if both_sides:
            found = F.concat(tx.python_tail(left, F.lit(length // 2)), tx.head(guess, used), tx.python_head(ahead, F.lit(length - length // 2) - used))
        else:
            found = F.concat(tx.python_tail(left, F.lit(length) - used), tx.head(guess, hyp_lines))
    else:
        raise ValueError(f"no query type {query_type}")
    return F.array_join(found, "\n")


def neighbour_mode(query_type: str) -> str:
    """Which chunk stands for a hit: the next one, the previous one, or the hit itself."""
    return {"groundtruth": "same", "left_last_and_right_first": "same", "first_n_lines": "previous", "repocoder": "same"}.get(query_type, "next")


def chunk_query(left_lines: Column, target_lines: Column, right_lines: Column, oracle: bool) -> Column:
    """For sampled chunks of n lines: 5n lines on each side, with the target between if oracle."""
    n = F.size(target_lines)
    parts = [tx.python_tail(left_lines, 5 * n), *([target_lines] if oracle else []), tx.head(right_lines, 5 * n)]
    return F.array_join(F.concat(*parts), "\n")


def function_query(left_lines: Column, target_lines: Column, right_lines: Column, oracle: bool) -> Column:
    """For functions of n lines: n lines on each side around the target if oracle, else 3n on each side."""
    n = F.size(target_lines)
    if oracle:
        return F.array_join(F.concat(tx.python_tail(left_lines, n), target_lines, tx.head(right_lines, n)), "\n")
    return F.array_join(F.concat(tx.python_tail(left_lines, 3 * n), tx.head(right_lines, 3 * n)), "\n")


def chunk_task(lines: Column, start: Column, end: Column) -> Column:
    """Struct prompt, groundtruth, right_context of a chunk of non-blank lines."""
    left, right = F.slice(lines, 1, start), F.slice(lines, F.least(end, F.size(lines)) + 1, F.greatest(F.size(lines) - end, F.lit(0)))
    return F.struct(
        F.when(F.size(left) > 0, F.concat(F.array_join(left, "\n"), F.lit("\n"))).otherwise(F.lit("")).alias("prompt"),
        F.array_join(F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))), "\n").alias("groundtruth"),
        F.when(F.size(right) > 0, F.concat(F.lit("\n"), F.array_join(right, "\n"))).otherwise(F.lit("")).alias("right_context"),
    )


def function_task(lines: Column, start: Column, end: Column) -> Column:
    """The same for a function: its indentation goes to the prompt, its text ends in a new line, the right context has none before it."""
    left, right = F.slice(lines, 1, start), F.slice(lines, F.least(end, F.size(lines)) + 1, F.greatest(F.size(lines) - end, F.lit(0)))
    body = F.concat(F.array_join(F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))), "\n"), F.lit("\n"))
    indent = tx.indentation(body)
    return F.struct(
        F.concat(F.when(F.size(left) > 0, F.concat(F.array_join(left, "\n"), F.lit("\n"))).otherwise(F.lit("")), indent).alias("prompt"),
        F.substring(body, F.length(indent) + 1, F.length(body)).alias("groundtruth"),
        F.array_join(right, "\n").alias("right_context"),
    )


def benchmark_task(lines: Column, start: Column, n_lines: Column, kind: str, right_lines: int = 50) -> Column:
    """Struct prompt, groundtruth, right_context, full_right_context of benchmark tasks: `start` counts lines from 0, kind is line, api or function.

    The first target line gives its indentation to the prompt; line and function right contexts begin with a new line.
    """
    first = F.get(lines, start)
    indent = tx.indentation(first)
    left = F.slice(lines, 1, start)
    prompt = F.concat(F.when(start > 0, F.concat(F.array_join(left, "\n"), F.lit("\n"))).otherwise(F.lit("")), indent)
    body = F.concat(F.array(F.substring(first, F.length(indent) + 1, F.length(first))), F.slice(lines, start + 2, F.greatest(n_lines - 1, F.lit(0))))
    ahead = F.slice(lines, start + n_lines + 1, F.greatest(F.size(lines) - start - n_lines, F.lit(0)))
    opening = "" if kind == "api" else "\n"
    join = lambda x: F.concat(F.lit(opening), F.array_join(x, "\n"))
    return F.struct(prompt.alias("prompt"), F.array_join(body, "\n").alias("groundtruth"), join(tx.head(ahead, right_lines)).alias("right_context"), join(ahead).alias("full_right_context"))
