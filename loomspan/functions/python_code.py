"""Functions that need a parser or a sequence matcher: Arrow UDFs over the standard library.

Python's own grammar stands for a tolerant syntax tree: code is valid if ast.parse takes it. Other languages have the
bracket rule of `text.bracket_statement`.
"""

from __future__ import annotations

import ast
import difflib
import keyword
import math
import re
import time
import warnings
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions import text as tx


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


#: Seconds that one row's parsing may take.
SECONDS = 5.0


def _fault(code: str) -> int | None:
    """None if the code parses; else the line, from 1, that the parser's complaint ends in, or 0 if it names none."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(code)
    except SyntaxError as e:
        return max(e.end_lineno or 0, e.lineno or 0)
    except (ValueError, RecursionError, MemoryError):
        return 0
    return None


def _parses(code: str) -> bool:
    return _fault(code) is None


@F.pandas_udf(T.BooleanType())
def parse_valid(code: pd.Series) -> pd.Series:
    return code.map(lambda c: c is not None and _parses(c))


def _first_statement(prompt: str, completion: str) -> str:
    until, last = time.monotonic() + SECONDS, len(completion)
    if _fault(prompt) == 0 or "\0" in prompt:
        return completion
    end = completion.find("\n", 1)
    while 0 < end < last and time.monotonic() < until:
        fault = _fault(prompt + completion[:end])
        if fault is None:
            return completion[:end].rstrip()
        end = completion.find("\n", end + 1)
    return completion


@F.pandas_udf(T.StringType())
def first_statement(prompt: pd.Series, completion: pd.Series) -> pd.Series:
    """The shortest start of the completion that a line ends after and that parses behind the prompt; else all of it."""
    return pd.Series([None if c is None else _first_statement(p or "", c) for p, c in zip(prompt, completion, strict=True)], dtype=object)


def statement(prompt: Column, completion: Column, language: Column) -> Column:
    """By language: the first statement of Python, up to the first bracket or semicolon of its relatives, else unchanged."""
    return F.when(language.isin("java", "csharp", "typescript"), tx.bracket_statement(completion)).when(language == "python", first_statement(prompt, completion)).otherwise(completion)


def _valid_prefix(prompt: str, completion: str) -> tuple[str, str]:
    """From the whole completion backwards. Where the parser's complaint ends in a line, no start that holds this whole line parses, as code is read from its beginning: so only that line's characters are tried one by one."""
    until, whole = time.monotonic() + SECONDS, prompt + completion
    ends = [k for k, c in enumerate(whole) if c == "\n"]
    i = len(completion)
    while i >= 0:
        fault = _fault(whole[: len(prompt) + i])
        if fault is None:
            return "parseable", completion[:i].rstrip()
        if time.monotonic() > until:
            return "timed_out", completion
        line_end = ends[fault - 1] if 0 < fault <= len(ends) else len(whole)
        i = min(i - 1, line_end - len(prompt))
    return "not_parseable", completion


@F.pandas_udf(_strings("status", "text"))
def valid_prefix(prompt: pd.Series, completion: pd.Series) -> pd.DataFrame:
    """The longest start of the completion that parses behind the prompt; status timed_out after `SECONDS`."""
    return pd.DataFrame([_valid_prefix(p or "", c or "") for p, c in zip(prompt, completion, strict=True)], columns=["status", "text"])


def _bodies(code: str) -> list[str]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines = code.split("\n")
    found = []

    def visit(node: ast.AST) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            first, last = node.body[0], node.body[-1]
            part = lines[first.lineno - 1 : last.end_lineno]
            if first.lineno == last.end_lineno:
                found.append(part[0].encode()[first.col_offset : last.end_col_offset].decode())
            else:
                part = [part[0].encode()[first.col_offset :].decode(), *part[1:-1], part[-1].encode()[: last.end_col_offset].decode()]
                found.append("\n".join(part))
        for child in ast.iter_child_nodes(node):
            visit(child)

    visit(tree)
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def function_bodies(code: pd.Series) -> pd.Series:
    """Bodies of all functions, in order of their heads, outer ones first."""
    return code.map(lambda c: [] if c is None else _bodies(c))


def _function_completion(prompt: str, completion: str) -> str | None:
    at = len(_bodies(prompt + "pass")) - 1
    found = _bodies(prompt + completion)
    return found[at] if found and -len(found) <= at < len(found) else None


@F.pandas_udf(_strings("pred", "target"))
def function_example(prompt: pd.Series, pred: pd.Series, target: pd.Series) -> pd.DataFrame:
    """Prediction and target as bodies of the function that the prompt begins; what can't be read that way stays as it is."""
    rows = []
    for p, c, t in zip(prompt, pred, target, strict=True):
        p, c, t = p or "", c or "", t or ""
        status, c = _valid_prefix(p, c)
        if status == "parseable" and (body := _function_completion(p, c)) is not None:
            c = body
            if (whole := _function_completion(p, t)) is not None:
                t = whole
        rows.append((c, t))
    return pd.DataFrame(rows, columns=["pred", "target"])


@F.pandas_udf(T.IntegerType())
def fuzz_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 to 100: twice the matched characters over both lengths, of trimmed texts; equal texts 100, one empty 0."""

    def one(x: str | None, y: str | None) -> int:
        x, y = (x or "").strip(), (y or "").strip()
        if x == y:
            return 100
        return round(100 * difflib.SequenceMatcher(None, x, y).ratio()) if x and y else 0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


_KEYWORDS = frozenset(keyword.kwlist)


def _ngram_match(reference: list[str], candidate: list[str]) -> float:
    if not reference or not candidate:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        grams = lambda t: Counter(zip(*(t[k:] for k in range(n)), strict=False))  # noqa: B023, E731
        ref, cand = grams(reference), grams(candidate)
        weight = (lambda g: 1.0 if g[0] in _KEYWORDS else 0.2) if n == 1 else (lambda g: 1.0)
        whole = sum(c * weight(g) for g, c in ref.items())
        met = sum(min(c, cand[g]) * weight(g) for g, c in ref.items())
        logs += 0.25 * math.log((met or 0.1) / max(whole, 1e-9 if n == 1 else 1.0))
    short = 1.0 if len(candidate) > len(reference) else math.exp(1 - len(reference) / len(candidate))
    return short * math.exp(logs)


@F.pandas_udf(T.DoubleType())
def weighted_ngram_match(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    """N-gram recall of the reference up to 4, keywords five times other words in unigrams, with the brevity penalty."""
    return pd.Series([_ngram_match(re.findall(r"\w+|[^\w\s]", r or ""), re.findall(r"\w+|[^\w\s]", c or "")) for r, c in zip(reference, candidate, strict=True)], dtype="float64")
