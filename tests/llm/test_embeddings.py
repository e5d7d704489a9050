import brute
import duckdb
import numpy as np
from pyspark.sql import functions as F
from sql_compare import assert_same, connect

from loomspan.llm import embedding_dedup as dedup

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, threshold=0.93):
    """vec_id -> (links, component) by comparing all pairs."""
    usable = [(i, np.array(v, float), label) for i, v, label in rows if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    edges = [(a[0], b[0]) for k, a in enumerate(usable) for b in usable[k + 1 :] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= threshold]
    part = brute.components([i for i, _, _ in rows], edges)
    return {i: (sum(i in e for e in edges), part[i]) for i, _, _ in rows}


def got(df):
    found = df.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    return {r.vec_id: (r.n_links, r.component_id) for r in found}


def table():
    r = np.random.default_rng(1)
    rows, centres = [], r.standard_normal((12, 24))
    for i in range(400):
        c = centres[i % 12] + (r.standard_normal(24) * (0.06 if i % 3 else 0.9))
        rows.append((i, [float(x) for x in (centres[0] if i % 9 == 0 else c)], int(i % 2)))
    odd = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [float("inf")] * 24, [1.0, 2.0], [2.0, 4.0], [1e200] * 24, [1e-200] * 24, [-0.0] * 23 + [1.0], [0.0] * 23 + [1.0]]
    return rows + [(1000 + k, v, 0) for k, v in enumerate(odd)] + [(2000, rows[0][1], None), (2001, rows[0][1], None)]


def test_against_all_pairs(spark):
    rows = table()
    want = plain([(i, [x * 1e-200 for x in v] if v == [1e200] * 24 else [x * 1e200 for x in v] if v == [1e-200] * 24 else v, label) for i, v, label in rows])
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit(1), "x": F.lit(2), "n": F.lit(3), "key": F.lit(4)})
    found = got(dedup.near_duplicates(df))
    assert found == want
    assert max(n for n, _ in want.values()) > 30
    assert dedup.near_duplicates(df.limit(0)).count() == 0
    assert got(dedup.near_duplicates(df.where("vec_id between 1000 and 1005"))) == {i: (0, i) for i in range(1000, 1006)}


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 7)
    rows = table()[:200]
    assert got(dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_same_as_sql_at_a_larger_size(spark):
    """Whole sf0.1 table: recall is 1 there, and no link below the threshold."""
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert_same(dedup.op5_embedding_dedup(spark, sf), con, dedup.OP5_SQL)


def test_same_as_sql(spark, sf_dir):
    assert_same(dedup.op5_embedding_dedup(spark, sf_dir), connect(sf_dir), dedup.OP5_SQL)


def met(index, x, y):
    """Of each pair: whether a table and the compared code bring it together."""
    a, b = index.on(x), index.on(y)
    differ = a != b
    return np.any([~differ[:, t].any(1) for t in index.tables], axis=0) & (dedup._apart(index.code(a), index.code(b)) <= index.most)


def test_tables_find_pairs_at_the_threshold():
    """Recall for isotropic pairs at a cosine of 0.935; codes are balanced; tables are disjoint and apart from the compared code."""
    r = np.random.default_rng(2)
    x = dedup._unit(r.standard_normal((4000, 64)))
    index = dedup.index_for(x, 64, 5000, 0.93)
    assert met(index, x, partners(r, x, 0.935)).mean() > 0.997
    assert (abs(index.on(x).mean(0) - 0.5) < 0.08).all()
    columns = np.concatenate(index.tables)
    assert len(np.unique(columns)) == len(columns) and (not len(columns) or columns.min() >= index.words * index.bits)


def test_spread_reaches_chains():
    codes = np.array([[0, 0], [0, 1], [0, 3], [4, 3], [2**63, 0], [4, 7]], np.uint64)
    pairs = dedup.spread(np.arange(6), codes, 1)
    assert brute.components(range(6), pairs) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0}
    assert brute.components(range(6), dedup.spread(np.arange(6), codes, 0)) == {k: k for k in range(6)}


def with_mean(r, n, norm, dim=64):
    common = dedup._unit(r.standard_normal(dim))
    return dedup._unit(norm * common + np.sqrt(1 - norm**2) * dedup._unit(r.standard_normal((n, dim))))


def partners(r, x, cosine):
    other = r.standard_normal(x.shape)
    other = dedup._unit(other - (other * x).sum(1, keepdims=True) * x)
    return cosine * x + np.sqrt(1 - cosine**2) * other


def test_tables_find_pairs_around_a_common_mean():
    """Planted pairs at a cosine of 0.935 meet in a table at 5,000 to 1,000,000 vectors a label, whatever mean they share."""
    r = np.random.default_rng(3)
    for norm in (0.0, 0.8, 0.9):
        sample, x = (lambda v: (v[:8192], v[8192:]))(with_mean(r, 12_192, norm))
        y = partners(r, x, 0.935)
        for size in (5_000, 100_000, 1_000_000):
            index = dedup.index_for(sample, 64, size, 0.93)
            found = met(index, x, y).mean()
            assert found > 0.996, (norm, size, len(index.tables), found)


def test_unrelated_vectors_form_no_families():
    """Vectors of one label without links: few candidates, and none that would make a family, so families can't grow with the label."""
    r = np.random.default_rng(5)
    for norm in (0.0, 0.85):
        x = with_mean(r, 40_000, norm)
        index = dedup.index_for(x[:8192], 64, len(x), 0.93)
        on = index.on(x)
        code = index.code(on)
        pairs = families = 0
        for chosen in index.tables:
            key = (on[:, chosen] * (np.uint64(1) << np.arange(len(chosen), dtype=np.uint64))).sum(1, dtype=np.uint64)
            order = np.argsort(key, kind="stable")
            a, _, dense = dedup.candidates(key[order], order, code[order], index.most)
            pairs += len(a)
            families += int(dense.sum())
        assert not families and pairs < 20 * len(x), (norm, pairs, families, len(index.tables))


def test_candidates_of_runs():
    r = np.random.default_rng(6)
    keys = np.sort(r.integers(0, 60, 200))
    codes = r.integers(0, 2, (200, 2)).astype(np.uint64)
    a, b, _ = dedup.candidates(keys, np.arange(200), codes, 0)
    plain = [(i, j) for i in range(200) for j in range(i + 1, 200) if keys[i] == keys[j] and (codes[i] == codes[j]).all()]
    assert brute.components(range(200), zip(a.tolist(), b.tolist(), strict=True)) == brute.components(range(200), plain)


def test_long_lists(spark, monkeypatch):
    """Lists that a task doesn't hold whole lose no link."""
    monkeypatch.setattr(dedup, "LONG_LIST", 10)
    rows = table()[:200]
    assert got(dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_planted_pairs_with_a_common_mean(spark):
    r = np.random.default_rng(4)
    x = with_mean(r, 6_000, 0.85)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(np.concatenate([x, partners(r, x[:400], 0.935)]))]
    found = got(dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    linked = sum(found[6_000 + k][0] > 0 for k in range(400))
    assert linked >= 398
