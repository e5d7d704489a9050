"""Token id arrays: budgets, layouts, padding, label masks and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions import text as tx

IGNORED = -100


def pad_right(ids: Column, length: int, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def pad_left(ids: Column, length: int, pad: int) -> Column:
    return F.concat(F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0))), ids)


def attention_mask(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: (x != pad).cast("int"))


def to_length(ids: Column, length: int, pad: int) -> Column:
    """Cut and padded on the right."""
    return pad_right(tx.head(ids, length), length, pad)


def context_budget(seq_length: int, target: Column, cfc: Column, ratio: float) -> Column:
    """Struct lr, rc, lc: tokens for both contexts, the right one and the left one (truncating toward 0)."""
    lr = F.lit(seq_length) - F.size(target) - F.size(cfc) - 5
    rc = (lr / F.lit(float(ratio) + 1)).cast("int")
    return F.struct(lr.alias("lr"), rc.alias("rc"), (rc * F.lit(float(ratio))).cast("int").alias("lc"))


def layout(kind: Column, lc: Column, rc: Column, target: Column, cfc: Column, ids: dict[str, int]) -> Column:
    """One training sequence. kind: clm, fim, positive, negative, neg_retrieval (context in the right part), cfc_positive, cfc_negative, cfc_negative_end (context after the middle mark)."""
    mark = lambda *names: F.array(*(F.lit(ids[n]) for n in names))
    start = F.concat(mark("fim_prefix"), lc, mark("fim_suffix"), rc)
    return (
        F.when(kind == "clm", F.concat(lc, target, rc))
        .when(kind == "fim", F.concat(start, mark("fim_middle"), target))
        .when(kind == "positive", F.concat(start, mark("end_rc", "cfc_info"), cfc, mark("fim_middle"), target))
        .when(kind == "neg_retrieval", F.concat(start, mark("end_rc", "neg_cfc_info", "fim_middle"), target))
        .when(kind == "negative", F.concat(start, mark("end_rc", "fim_middle"), target))
        .when(kind == "cfc_positive", F.concat(start, mark("fim_middle", "cfc_info"), cfc, mark("end_cfc_info"), target))
        .when(kind == "cfc_negative", F.concat(start, mark("fim_middle"), target))
        .when(kind == "cfc_negative_end", F.concat(start, mark("fim_middle", "end_cfc_info"), target))
    )


def inputs(ids: Column) -> Column:
    return F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0)))


def next_tokens(ids: Column) -> Column:
    return F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))



def _labels(ids: Column, pad: int) -> Column:
    return F.transform(next_tokens(ids), lambda x: F.when(x == pad, F.lit(IGNORED)).otherwise(x))


def _kept(labels: Column, keep) -> Column:
    """labels where keep(label, place from 1) holds."""
    return F.transform(labels, lambda x, i: F.when(keep(x, i + 1), x).otherwise(F.lit(IGNORED)))


def _places(labels: Column, *marks: int) -> Column:
    """Struct labels, p0, p1, ...: the first place of each mark, 0 if there is none."""
    return F.struct(labels.alias("labels"), *(F.array_position(labels, m).alias(f"p{k}") for k, m in enumerate(marks)))


def single_loss_labels(ids: Column, pad: int, middle: int, cfc_start: int, cfc_end: int, full_sequence: bool = False) -> Column:
    """Labels of the one-loss form: what follows the context's end, the context's start itself, or without context what follows the middle mark; everything in rows without a middle mark. full_sequence also keeps all up to the context's start."""

    def mask(r: Column) -> Column:
        end, start, mid = r["p0"], r["p1"], r["p2"]

        def keep(x: Column, i: Column) -> Column:
            after_end = (end > 0) & (i >= end) & (x != cfc_end)
            if full_sequence:
                return (mid == 0) | after_end | (x == cfc_start) | (start == 0) | (i < start)
            return (mid == 0) | (F.when(start > 0, after_end | (x == cfc_start)).otherwise(i >= mid) & (x != middle))

        return _kept(r["labels"], keep)

    return tx.let(_labels(ids, pad), lambda a: tx.let(_places(a, cfc_end, cfc_start, middle), mask))


def completion_labels(ids: Column, pad: int, middle: int, end_rc: int, full_sequence: bool = False) -> Column:
    """Labels of the completion loss: what follows the middle mark, and with full_sequence what comes before the right context's end. Rows without a middle mark keep all; with full_sequence that end decides alone."""

    def mask(r: Column) -> Column:
        end, mid = r["p0"], r["p1"]

        def keep(x: Column, i: Column) -> Column:
            after = (mid > 0) & (i >= mid) & (x != middle)
            return after | ((end == 0) | (i < end) if full_sequence else mid == 0)

        return _kept(r["labels"], keep)

    return tx.let(_labels(ids, pad), lambda a: tx.let(_places(a, end_rc, middle), mask))


def retrieval_labels(ids: Column, pad: int, end_rc: int, neg_retrieval: bool = False) -> Column:
    """Labels of the retrieval loss: the token after each right context's end only; the row wraps, so a mark in the last place keeps the first."""

    def mask(labels: Column) -> Column:
        before = F.concat(F.slice(labels, -1, 1), F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))))
        own = (lambda x: x != end_rc + 1) if neg_retrieval else (lambda x: F.lit(True))
        return F.zip_with(labels, before, lambda x, b: F.when((b == end_rc) & own(x), x).otherwise(F.lit(IGNORED)))

    return F.when(F.size(ids) > 1, tx.let(_labels(ids, pad), mask)).otherwise(F.slice(ids, 1, 0))


def completion_inputs(ids: Column, end_rc: int, cfc_start: int, neg_retrieval: bool = False) -> Column:
    """Inputs, in which the negative-retrieval mark reads as the context's start."""
    return F.transform(inputs(ids), lambda x: F.when(x == end_rc + 1, F.lit(cfc_start)).otherwise(x)) if neg_retrieval else inputs(ids)


def _join(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


#: Prompt kinds by name; the arguments are token arrays, cut here: left contexts keep their end, others their start.
def prompt(kind: str, left: Column, right: Column, cfc: Column, total: int = 2048, cfc_length: int = 512, right_length: int = 512, gen: int = 50) -> Column:
    """Tokens, or text for the kinds with marks, of one prompt. Space-joined regular-expression tokens stand for a tokenizer's text."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else _join(p) for p in parts))
    room = total - gen
    if kind == "left":
        return tx.tail(left, room)
    if kind == "left_fim":
        return text("<fim_prefix>", tx.tail(left, room - 10), "<fim_suffix><fim_middle>")
    if kind == "cfc_fim":
        return text("<fim_prefix>", tx.tail(left, room - right_length - 5), "<fim_suffix>", tx.head(cfc, cfc_length - 5), "<fim_middle>")
    if kind == "cfc_left":
        return F.concat(tx.head(cfc, cfc_length), tx.tail(left, room - cfc_length))
    if kind == "left_right_fim":
        return text("<fim_prefix>", tx.tail(left, room - right_length - 10), "<fim_suffix>", tx.head(right, right_length - 10), "<fim_middle>")
    if kind == "right_left":
        return F.concat(tx.head(right, cfc_length), tx.tail(left, room - right_length))
    if kind == "right_cfc_left":
        return F.concat(tx.head(right, right_length), tx.head(cfc, cfc_length), tx.tail(left, room - cfc_length - right_length))
    if kind == "right_cfc_left_fim":
        return text("<fim_prefix>", tx.head(cfc, cfc_length - 10), tx.tail(left, room - cfc_length - right_length - 10), "<fim_suffix>", tx.head(right, right_length - 10), "<fim_middle>")
    if kind == "served_left_right":
        return text("<fim_prefix>", tx.tail(left, room - right_length), "<fim_suffix>", tx.head(right, right_length), "<fim_middle>")
    if kind == "served_right_cfc":
        return text("<fim_prefix>", tx.tail(left, room - right_length - cfc_length), "<fim_suffix>", tx.head(right, right_length), "\n\n", tx.head(cfc, cfc_length), "<fim_middle>")
    if kind == "selective_left_right":
        return text("<fim_prefix>", tx.tail(left, room - right_length), "<fim_suffix>", tx.head(right, right_length), "<eof><fim_middle>")
    if kind == "selective_right_cfc":
        return text("<fim_prefix>", tx.tail(left, room - right_length - cfc_length), "<fim_suffix>", tx.head(right, right_length), "<eof><cc>", "\n\n", tx.head(cfc, cfc_length), "<fim_middle>")
    if kind == "decision":
        return F.replace(prompt("selective_left_right", left, right, cfc, total, cfc_length, right_length, gen), F.lit("<fim_middle>"), F.lit(""))
    raise ValueError(f"no prompt kind {kind}")


PROMPT_KINDS = ("left", "left_fim", "cfc_fim", "cfc_left", "left_right_fim", "right_left", "right_cfc_left", "right_cfc_left_fim", "served_left_right", "served_right_cfc", "selective_left_right", "selective_right_cfc", "decision")
