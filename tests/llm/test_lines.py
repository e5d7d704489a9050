import brute
import numpy as np
from pyspark.sql import functions as F

from loomspan.llm import line_dedup


def removed(docs):
    from loomspan.llm._shared import Scratch

    found = line_dedup.repeated_lines(Scratch(docs.sparkSession, "t"), docs.select(F.col("doc_id").alias("doc"), "text"))
    return {r.doc: set(r.lines) for r in found.collect()}


def test_against_brute_force(spark, make_docs, texts):
    for seed in (1, 2):
        some = texts(seed)
        want = brute.lines_removed(dict(enumerate(some)))
        assert sum(map(len, want.values())) > 10
        got = removed(make_docs(some))
        assert {i: got.get(i, set()) for i in range(len(some))} == want


def test_texts_and_columns(spark, make_docs):
    line = "this line stands in many of the documents here"
    some = [f"first of its kind, not like the others\n{line}\nshort", f"{line}!\n short\nsecond text with words of its own", None, "", line, f"{line}\n{line}", "ß" * 25, "ß" * 25]
    docs = make_docs(some).withColumns({"lines": F.lit("x"), "doc": F.lit(1), "id": F.lit(2), "row": F.lit(3), "gone": F.lit(4), "d": F.lit(5), "__doc": F.lit(6), "__gone": F.lit(7)})
    got = {r.doc_id: r for r in line_dedup.without_lines(docs).collect()}
    assert got[0].text == some[0] and got[1].text == "second text with words of its own"
    assert got[2].text is None and got[3].text == "" and got[4].text == "" and got[5].text == "" and got[7].text == ""
    assert (got[5].__getitem__("__lines"), got[5].__getitem__("__removed")) == (2, 2)
    assert got[1].lines == "x"
    twice = line_dedup.without_lines(docs.unionByName(docs))
    assert sorted((r.doc_id, r.text or "") for r in twice.collect()) == sorted((k, r.text or "") for k, r in got.items() for _ in range(2))
    assert line_dedup.without_lines(docs.limit(0)).count() == 0
    assert [r.text for r in line_dedup.without_lines(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long"))).collect()] == [some[5]]


def test_recall_of_bands(texts):
    """Pairs of lines near the threshold meet in a band and aren't ruled out by their sketches."""
    import random

    r = random.Random(6)
    met = every = 0
    for _ in range(400):
        a = [r.choice("abcdefghijklmnopqrst ") for _ in range(300)]
        b = list(a)
        for _ in range(3):
            b[r.randrange(300)] = "X"
        a, b = "".join(a).strip(), "".join(b).strip()
        x, y = set(line_dedup.char_shingles(a).tolist()), set(line_dedup.char_shingles(b).tolist())
        if len(x & y) / len(x | y) < 0.8:
            continue
        keys, words = line_dedup.sketches([a, b])
        every += 1
        met += bool((keys[0] == keys[1]).any()) and int(np.bitwise_count(words.view(np.uint64)[0] ^ words.view(np.uint64)[1])) <= line_dedup.MOST_DIFFERENT
    assert every > 100 and met / every > 0.98


def test_query(spark, sf_dir):
    got = line_dedup.op9_line_dedup(spark, sf_dir).toPandas()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = brute.lines_removed(docs)
    assert {r.doc_id: r.n_removed for r in got.itertuples()} == {i: len(w) for i, w in want.items()}


def test_short_lines(spark, make_docs):
    """Lines of any length but none go: exact repeats, and similar ones of 8 characters or more."""
    some = ["ab\n\nthe end\nlast one", "x\n  \nab \n\nthe end.", "昨日は雨が降りました。\nab\naaaaaaaa", "昨日は雨が降りました。\nnew\naaaaaaaaa\n1234567", "1234568\n123456789012345678\n0", "1234567890123456789\n0", None, ""]
    got = removed(make_docs(some))
    assert got == {1: {2}, 2: {1}, 3: {0, 2}, 5: {0, 1}}
    assert {i: got.get(i, set()) for i in range(len(some))} == brute.lines_removed(dict(enumerate(some)), least=1)


def test_short_lines_of_the_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = brute.lines_removed(docs, least=1)
    assert sum(map(len, want.values())) > sum(map(len, brute.lines_removed(docs, least=20).values()))
    assert {r.doc_id: r.n_removed for r in line_dedup.op9_line_dedup(spark, sf_dir).collect()} == {i: len(w) for i, w in want.items()}


def test_rows_of_one_id(spark):
    """Rows of one id with different texts neither fail nor lose lines that they don't have."""
    line = "this line stands in many of the documents here"
    rows = [(1, "a\nb\nc\n" + line), (1, line), (2, f"own text of the first row\n{line}"), (2, "one\ntwo\nthree\nfour\nfive"), (1, line), (2, "a\nsix")]
    got = sorted((r.doc_id, r.text) for r in line_dedup.without_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "a\nb\nc"), (1, line), (1, line), (2, "one\ntwo\nthree\nfour\nfive"), (2, "own text of the first row"), (2, "six")]


def test_bands_travel_in_buckets(spark, make_docs):
    """A task gives at most a row for each bucket, not one for each band, and no line's text is sought by a join with all documents."""
    some = [f"line {k} of the table, with words {k * k} and {k * 7919} of its own" for k in range(3000)]
    docs = make_docs(["\n".join(some[k : k + 100]) for k in range(0, 3000, 100)]).coalesce(1)
    assert line_dedup._bands(docs).count() <= 1 << line_dedup.BUCKET_BITS
    found = [r.i for r in spark.range(0, 10**6, 7).selectExpr("xxhash64(id) & 9223372036854775807 AS i").collect()]
    words = line_dedup._filter_of(spark.createDataFrame([(i,) for i in found[:1000]], "i long"))
    assert line_dedup._may_hold(words, np.array(found[:1000])).all()
    assert line_dedup._may_hold(words, np.array(found[1000:])).mean() < 0.15


def test_bucket_pairs_are_those_of_bands():
    """The pairs of two lines taken at once and those of larger bands are what each band by itself gives."""
    r = np.random.default_rng(3)
    keys, ids = r.integers(0, 300, 1000), r.integers(0, 400, 1000)
    of = r.integers(0, 1 << 40, 400, dtype=np.uint64) & np.uint64(0xFF000001FF)
    rows = np.empty(1000, line_dedup._BAND)
    rows["key"], rows["id"], rows["low"], rows["high"] = keys, ids, of[ids].astype(np.uint32), (of[ids] >> np.uint64(32)).astype(np.uint8)
    want = set()
    for k in range(300):
        want |= line_dedup.near_in_band(ids[keys == k], of[ids[keys == k]].view(np.int64))
    assert want and {tuple(p) for some in line_dedup._pairs_of_bucket(rows) for p in some.tolist()} == want


def test_chained_families_are_taken_apart(spark):
    """One family of unlike lines costs rows in proportion to them, and its links are those that all pairs give."""
    import random

    from loomspan.llm._shared import Scratch, components

    r = random.Random(4)
    lines = {}
    for k in range(120):
        base = [r.choice("abcdefghijklmnop") for _ in range(200)]
        for v in range(r.choice([1, 1, 2, 5])):
            some = list(base)
            some[r.randrange(200)] = "X"
            lines[len(lines) + 1] = "".join(some) + str(v)
    scratch = Scratch(spark, "t")
    members = scratch.keep(spark.createDataFrame([(i, 7, x) for i, x in lines.items()], "id long, family long, text string"), "members")
    want, got = ({(x.id, x.component_id) for x in components(scratch, links).collect()} for links in (line_dedup.family_links(scratch, members, line_dedup.char_shingles, 80, 100), line_dedup.line_links(scratch, members, 80, 100, most=50)))
    assert len(want) > 100 and got == want
    assert spark.read.parquet(scratch.paths["band_members"]).count() <= 2 * line_dedup.BANDS * len(lines) / 2
