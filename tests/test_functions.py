"""Hand-computed results of column functions."""

import math

import pytest
from pyspark.sql import functions as F

from loomspan.functions import python_code, scores
from loomspan.functions import text as tx
from loomspan.functions import tokens as tk


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("v")).first()["v"]


def s(text):
    return F.lit(text)


def words(*values):
    return F.array(*map(F.lit, values))


def test_similarities(value):
    assert value(scores.jaccard(words("a", "b"), words("b", "c"))) == pytest.approx(1 / 3)
    assert value(scores.containment(words("a", "b"), words("b", "c"))) == 0.5
    assert value(scores.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) is None


def test_edit_similarity(value):
    assert value(scores.edit_similarity(s("kitten"), s("sitting"))) == pytest.approx(1 - 3 / 7)
    assert value(scores.edit_similarity(s(""), s(""))) == 0
    assert value(scores.edit_similarity(s("same"), s("same"))) == 1


def test_code_tokens(value):
    assert value(tx.code_tokens(s('getX(a_b)  "q"'))) == ["get", "X", "(", "a_b", ")", "`", "q", "`"]


@pytest.mark.parametrize(("code", "expected"), [("a; b", "a;"), (";x", ";x"), ("ab", "ab"), ("f() { x", "f() {")])
def test_bracket_statement(value, code, expected):
    assert value(tx.bracket_statement(s(code))) == expected


def test_identifiers(value):
    assert value(tx.identifiers(s('int x = foo("y z");'), "java")) == ["x", "foo"]
    with pytest.raises(ValueError):
        tx.keywords("cobol")


def test_id_match(value):
    m = value(scores.id_match(words("x", "y"), words("y", "z", "z")))
    assert (m["tp"], m["fp"], m["fn"], m["em"]) == (1, 1, 1, 0)
    assert m["precision"] == m["recall"] == m["f1"] == 0.5


@pytest.mark.parametrize(("a", "b", "expected"), [("r/a/b.py", "r/c/d/e.py", 3), ("r/a.py", "r/b.py", 0), ("r/a/b.py", "r/a/c.py", 0), ("r/a.py", "q/a.py", 2)])
def test_path_distance(value, a, b, expected):
    assert value(tx.path_distance(s(a), s(b))) == expected


def test_slices_as_python(value):
    a = list(range(1, 8))
    column = F.array(*map(F.lit, a))
    for n in range(-9, 10):
        assert value(tx.python_tail(column, F.lit(n))) == (a[-n:] if n else a)
        assert value(tx.python_head(column, F.lit(n))) == a[:n]
    assert value(tx.tail(column, 0)) == []
    assert value(tx.tail(column, 99)) == a


def test_identifier_parts(value):
    assert value(tx.identifier_parts(s("getHTTPResponse2x"))) == ["get", "http", "response", "2", "x"]
    assert value(tx.identifier_parts_keeping_case(s("get_2d_array"))) == ["get", "_", "2d", "_", "array"]
    assert value(tx.identifier_parts(s("_"))) == ["_"]


def test_comments(value):
    assert value(tx.strip_comments(s("a # b\nc // d\ne"))) == "a \nc \ne"
    assert value(tx.comment_sign(s("java"))) == "//"
    assert value(tx.comment_sign(s("cobol"))) is None


def test_budget(value):
    b = value(tk.context_budget(100, F.array_repeat(F.lit(1), 10), F.array_repeat(F.lit(1), 20), 2.0))
    assert (b["lr"], b["rc"], b["lc"]) == (65, 21, 42)


def test_line_weights(value):
    assert value(scores.line_weights(F.lit(3), F.lit(1), 1))[:3] == pytest.approx([1 / 3, 1 / 2, 1])
    assert value(scores.line_weights(F.lit(3), F.lit(0), 2)) == pytest.approx([math.exp(-2), math.exp(-1), 1, 1])


def test_single_loss_labels(value):
    """Middle mark 0, context start 49152 and end 49153, padding 99."""
    ids = [7, 12, 13, 0, 49152, 1, 2, 3, 49153, 15, 16, 99]
    got = value(tk.single_loss_labels(F.array(*map(F.lit, ids)), 99, 0, 49152, 49153))
    assert got == [-100, -100, -100, 49152, -100, -100, -100, -100, 15, 16, -100]
    plain = [7, 12, 0, 15, 16, 99]
    assert value(tk.single_loss_labels(F.array(*map(F.lit, plain)), 99, 0, 49152, 49153)) == [-100, -100, 15, 16, -100]
    clm = [7, 12, 15, 99]
    assert value(tk.single_loss_labels(F.array(*map(F.lit, clm)), 99, 0, 49152, 49153)) == [12, 15, -100]
    whole = value(tk.single_loss_labels(F.array(*map(F.lit, ids)), 99, 0, 49152, 49153, True))
    assert whole == [12, 13, 0, 49152, -100, -100, -100, -100, 15, 16, -100]


def test_two_loss_labels(value):
    """Middle mark 2, end of the right context 11, context 10, negative retrieval 12, padding 0."""
    ids = F.array(*map(F.lit, [1, 5, 3, 6, 11, 10, 7, 2, 8, 9, 0]))
    assert value(tk.retrieval_labels(ids, 0, 11)) == [-100, -100, -100, -100, 10, -100, -100, -100, -100, -100]
    assert value(tk.completion_labels(ids, 0, 2, 11)) == [-100] * 7 + [8, 9, -100]
    assert value(tk.completion_labels(ids, 0, 2, 11, True)) == [5, 3, 6, -100, -100, -100, -100, 8, 9, -100]
    negative = F.array(*map(F.lit, [1, 5, 3, 6, 11, 12, 2, 8]))
    assert value(tk.retrieval_labels(negative, 0, 11, True)) == [-100] * 7
    assert value(tk.completion_inputs(negative, 11, 10, True)) == [1, 5, 3, 6, 11, 10, 2]
    wrapped = F.array(*map(F.lit, [1, 4, 5, 11]))
    assert value(tk.retrieval_labels(wrapped, 0, 11)) == [4, -100, -100]


def test_softmax_and_uncertainty(value):
    logits = F.array(*map(F.lit, [0.0, math.log(3.0)]))
    assert value(scores.softmax_at(logits, 1)) == pytest.approx(0.75)
    u = value(scores.token_uncertainty(logits))
    assert u["max_prob"] == pytest.approx(0.75)
    assert u["entropy"] == pytest.approx(-(0.75 * math.log(0.75) + 0.25 * math.log(0.25)))
    assert value(scores.softmax_at(F.array(F.lit(1000.0), F.lit(1000.0)), 0)) == pytest.approx(0.5)
    assert value(scores.rank_of(F.array(*map(F.lit, [3.0, 1.0, 2.0])), 2)) == 2


def test_vectors(value):
    v = F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(2.0)))
    assert value(scores.masked_mean(v, F.array(F.lit(1), F.lit(1)))) == [2.0, 1.0]
    assert value(scores.max_similarity(F.array(F.array(F.lit(1.0), F.lit(0.0))), v)) == 1.0
    assert value(scores.mean_log_prob(F.array(F.lit(-1.0), F.lit(-3.0), F.lit(-9.0)), F.lit(2))) == -2.0


def test_python_code(spark):
    code = "def f():\n    "
    row = spark.createDataFrame([(code, "return 1\nx = (")], "p string, c string").select(python_code.valid_prefix("p", "c").alias("v"), python_code.first_statement("p", "c").alias("s"), python_code.function_bodies(F.lit("def a():\n    x = 1\n    return x\n\ndef b(): pass\n")).alias("b")).first()
    assert (row["v"]["status"], row["v"]["text"]) == ("parseable", "return 1\nx")
    assert row["s"] == "return 1"
    assert row["b"] == ["x = 1\n    return x", "pass"]


def test_fuzz_ratio(spark):
    rows = spark.createDataFrame([("abcd", "bcde"), ("", ""), ("a", ""), (" x ", "x")], "a string, b string")
    assert [r[0] for r in rows.select(python_code.fuzz_ratio("a", "b")).collect()] == [75, 100, 0, 100]


@pytest.mark.parametrize("kind", tk.PROMPT_KINDS)
def test_prompts_cut(value, kind):
    got = value(tk.prompt(kind, words(*"abcdef"), words("r", "s"), words("c", "d"), total=64, cfc_length=16, right_length=16, gen=8))
    assert "f" in (got if isinstance(got, str) else " ".join(got))
    with pytest.raises(ValueError):
        tk.prompt("none", words("a"), words("a"), words("a"))
