import random

import brute
import numpy as np
from pyspark.sql import functions as F
from sql_compare import assert_same, connect

from loomspan.llm import _families, ngram_join, sigtree
from loomspan.llm._shared import Forest, Scratch, components


def test_same_as_sql(spark, sf_dir):
    assert_same(ngram_join.op8_ngram_join(spark, sf_dir), connect(sf_dir), ngram_join.OP8_SQL)


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_against_brute_force(spark, make_docs, texts):
    for seed in (1, 2):
        some = texts(seed, 90)
        docs = make_docs(some).withColumns({"id": F.lit(1), "family": F.lit(2), "keys": F.lit(3)})
        want = brute.ngram_components(dict(enumerate(some)))
        assert sum(i != c for i, (_, c) in want.items()) > 5
        assert got(ngram_join.jaccard_components(docs)) == want
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0


def chain(n, seed=3, every=1):
    """Texts of which neighbours link and distant ones don't."""
    r = random.Random(seed)
    w = [f"w{r.random()}" for _ in range(150)]
    out = []
    for _ in range(n):
        w[r.randrange(150)] = f"w{r.random()}"
        out.append(" ".join(w))
    return out


def test_chains_and_repeated_rows(spark, make_docs):
    some = chain(40) + ["A b C d", "a B c D", "a b c", "a b", "a  b"]
    docs = make_docs(some)
    want = brute.ngram_components(dict(enumerate(some)))
    assert want[39][1] == 0
    assert got(ngram_join.jaccard_components(docs.unionByName(docs.where("doc_id < 4")))) == want


def test_blocks_of_a_large_family(spark):
    """A family cut into blocks of 5 keeps all links, also those of chains across blocks and of strangers in it."""
    some = chain(60) + chain(30, 9)
    want = brute.ngram_components(dict(enumerate(some)))
    scratch = Scratch(spark, "t")
    members = spark.createDataFrame([(i, 0, t) for i, t in enumerate(some)], "id long, family long, text string").repartition(3)
    links = _families.family_links(scratch, members, ngram_join.shingles, 85, 100, block=5)
    found = {r.id: r.component_id for r in components(scratch, links).collect()}
    assert {i: found.get(i, i) for i in range(len(some))} == {i: c for i, (_, c) in want.items()}


def test_trees_lose_no_link():
    r = np.random.default_rng(4)
    pool = r.integers(0, 2**63, 5000, np.uint64)
    sets = []
    for k in range(700):
        s = np.unique(r.choice(pool, r.integers(3, 400))) if k % 2 or not sets else np.unique(np.append(sets[r.integers(len(sets))][1:], r.choice(pool, 1)))
        sets.append(s)
    sizes = np.array([len(s) for s in sets])
    maps = np.stack([sigtree.bitmap(s, 512) for s in sets])
    same = lambda i, j: 185 * len(np.intersect1d(sets[i], sets[j])) >= 85 * (sizes[i] + sizes[j])
    forest = Forest(len(sets))
    sigtree.links(sizes, maps, 85, 100, same, forest)
    plain = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if same(i, j)]
    want = brute.components(range(len(sets)), plain)
    assert plain and [int(x) for x in forest.roots()] == [want[i] for i in range(len(sets))]


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)] + [(7, 7), (3, 2), (2, 3)]
    found = {x.id: x.component_id for x in components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert found == brute.components(nodes, [e for e in edges if e[0] != e[1]])
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_periodic_texts(spark, make_docs):
    """A text of four words is one shingle, as is a longer one of the same word."""
    some = ["a a a a", "A a a a a", "a a a", "a a a a a a a", "a a", "b a a a"]
    assert got(ngram_join.jaccard_components(make_docs(some))) == brute.ngram_components(dict(enumerate(some)))


def test_rows_of_one_id_and_none(spark):
    """Each row has the component of its own text, named by the least id in it."""
    t = [" ".join(f"t{k}w{j}" for j in range(40)) for k in range(4)]
    rows = [(3, t[0]), (3, t[1]), (5, t[1] + " x"), (2, t[2]), (None, t[2]), (None, t[3]), (7, t[3] + " y"), (8, None), (9, t[0])]
    found = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in found)) == [(0, 37, 2), (0, 37, 7), (2, 37, 2), (3, 37, 3), (3, 37, 3), (5, 38, 3), (7, 38, 7), (8, 0, 8), (9, 37, 3)]
