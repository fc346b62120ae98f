"""Exact dedup, whitening and clustering against brute force, SQL and edge cases."""

import hashlib
import string

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import digest_merge, dual_tree, queries, whitening

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_digest_merge", "op13_dual_tree"])
def test_query_equals_sql(spark, sql, name):
    df = queries.queries()[name](spark, SF)
    found = sql.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    got, want = sorted(tuple(r[c] for c in names) for r in df.collect()), sorted(found.fetchall())
    assert got and got == want


# Exact dedup


def brute_copies(rows):
    """(id, keep_id, size, text's digest) of each row."""
    digest = lambda t: hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()
    groups = {}
    for i, t in rows:
        groups.setdefault(digest(t), []).append(i)
    key = lambda i: (i is not None, i or 0)
    return sorted((str(i), str(max(groups[digest(t)], key=key)), len(groups[digest(t)]), digest(t)) for i, t in rows)


def copies(spark, rows, parts=3, width=None):
    """Rows with columns whose names clash with those of the operator."""
    df = spark.createDataFrame([(i, t, "x", 7, "y", "z") for i, t in rows], "doc_id long, text string, id string, n int, digest string, kept string").repartition(parts)
    return digest_merge.apply(df)


@pytest.mark.parametrize("width", [1, 4, 37, 300])
def test_copies_equal_brute_force(spark, width):
    """One to three rounds of exchanges; a third of all rows is one text."""
    rng = np.random.default_rng(width)
    words = ["Straße", "STRASSE", "a", "A", "É", "é", "", " ", "\0", "İ", None, "x" * 70_000, "X" * 70_000]
    rows = [(int(i), "Hot" if i % 3 == 0 else words[rng.integers(len(words))] if i % 3 == 1 else f"only {i}") for i in range(600)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    try:
        got = copies(spark, rows, 5).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute_copies(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_copies_of_odd_tables(spark):
    rows = [(None, "a"), (None, "A"), (None, "b"), (3, "B"), (5, "c"), (5, "c"), (2**60 + 1, "big"), (2**60, "BIG"), (-4, None), (-5, "")]
    got = copies(spark, rows).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute_copies(rows)
    kept = sorted((r.text_sha256, str(r.doc_id)) for r in got if r.kept)
    assert len(kept) == 5 and {i for _, i in kept} == {"None", "3", "5", str(2**60 + 1), "-4"}  # one of each group, of repeated rows too
    assert copies(spark, []).count() == 0
    least = digest_merge.apply(spark.createDataFrame([(1, "a"), (2, "A"), (None, "a")], "doc_id long, text string"), largest=False)
    assert {r.keep_id for r in least.collect()} == {1}


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 1), st.integers(1, 3)), max_size=40), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_folding_does_not_depend_on_batches(rows, step):
    rows.sort()
    schema = pa.schema([("node", pa.int32()), ("salt", pa.int32()), ("digest", pa.binary()), ("size", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("n", pa.int64())])
    table = pa.table([[0] * len(rows), [s for _, s, _ in rows], [hashlib.sha256(bytes([d])).digest() for d, _, _ in rows], [1] * len(rows), range(len(rows)), range(len(rows)), [n for _, _, n in rows]], schema=schema)
    got = [r for b in digest_merge._folded(table.to_batches(max_chunksize=step)) for r in b.to_pylist()]
    want = {}
    for i, (d, s, n) in enumerate(rows):
        want[d, s] = (i, want.get((d, s), (0, 0))[1] + n)
    assert [(r["id"], r["n"]) for r in got] == list(want.values())


def test_radix_covers_width():
    for width in (1, 2, 8, 12, 16, 17, 211, 1000, 20_000):
        base, rounds = digest_merge.radix(width)
        assert width <= base**rounds <= max(2, 2 * width) and base <= digest_merge.FAN + 1


# Whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 3, "a", "b") for i, v in rows], "vec_id long, embedding array<float>, label int, id string, v string")


def check_whitening(got, rows, d):
    ids = [i for i, _ in rows]
    x = np.floor(64 * np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    k = min(32, d)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    want = y @ axes / np.sqrt(values)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) == n * k
    z = np.array([[by[i, c + 1].whitened for c in range(k)] for i in ids])
    assert np.abs(z * np.sign((z * want).sum(axis=0)) - want).max() < 1e-8
    assert [by[i, 1].deviation for i in ids] == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    assert {r.n for r in got} == {n} and {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10
    assert np.allclose([by[ids[0], c + 1].explained for c in range(k)], values / np.trace(y.T @ y / n))


@pytest.mark.parametrize("d", [3, 40])
def test_whitening_equals_brute_force(spark, d):
    rng = np.random.default_rng(d)
    rows = [(i, (rng.normal(size=d) * np.arange(1, d + 1)).astype(np.float32).tolist()) for i in range(300)]
    odd = [(1000, None), (1001, [None] * d), (1002, [float("nan")] + [0.0] * (d - 1)), (1003, [float("inf")] * d), (1004, []), (1005, [1.0] * (d - 1)), (1006, [3e38] * d)]
    check_whitening(whitening.apply(vectors(spark, rows + odd).repartition(4)).collect(), rows, d)


def test_whitening_of_odd_tables(spark):
    assert whitening.apply(vectors(spark, [])).collect() == []
    assert whitening.apply(vectors(spark, [(1, [1.0, 2.0])] * 3)).collect() == []
    # one direction only: one component; a repeated row and null ids are rows
    line = [(None, [0.0, 0.0]), (None, [1.0, 1.0]), (7, [2.0, 2.0]), (7, [2.0, 2.0])]
    got = whitening.apply(vectors(spark, line)).collect()
    assert len(got) == 4 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    big = whitening.apply(vectors(spark, [(1, [3e15, 0.0]), (2, [-3e15, 1.0]), (3, [0.0, 2.0])])).collect()
    assert {r.deviation for r in big if r.vec_id != 3} == {None} and len(big)


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op12_whitening(spark, SF)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(got.collect(), rows, 64)


# Clustering


@given(st.integers(1, 60), st.integers(1, 4), st.integers(1, 12), st.integers(0, 2**31))
@settings(max_examples=80, deadline=None)
def test_dual_tree_assigns_as_all_pairs_do(n, d, k, seed):
    """Few values, so many ties and copies."""
    rng = np.random.default_rng(seed)
    x, c = np.unique(rng.integers(-4, 5, size=(n, d)), axis=0), rng.integers(-4, 5, size=(k, d))
    tree, order = dual_tree.CoverTree.build(x, leaf=2)
    x = x[order]
    got, _ = dual_tree.assign(tree, x, dual_tree.Centroids(c))
    assert (got == ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)).all()


@given(st.integers(2, 200), st.integers(1, 5), st.integers(0, 2**31))
@settings(max_examples=40, deadline=None)
def test_cover_tree_covers_and_separates(n, d, seed):
    x = np.unique(np.random.default_rng(seed).integers(-50, 50, size=(n, d)), axis=0)
    tree, order = dual_tree.CoverTree.build(x, leaf=4)
    x = x[order]
    assert sorted(order) == list(range(len(x))) and (tree.start[0], tree.end[0]) == (0, len(x))
    far = lambda a, b: np.sqrt(((x[a] - x[b]) ** 2).sum(axis=-1))
    for i in range(len(tree.point)):
        assert far(tree.point[i], np.arange(tree.start[i], tree.end[i])).max() <= tree.radius[i] + 1e-9
        own = tree.first[i] + np.arange(tree.count[i])
        if len(own):
            assert tree.start[own[0]] == tree.start[i] and tree.end[own[-1]] == tree.end[i] and (tree.start[own[1:]] == tree.end[own[:-1]]).all()
            gaps = np.array([far(tree.point[a], tree.point[b]) for a in own for b in own if a < b])
            assert gaps.min() > tree.radius[own].max() - 1e-9  # a greedy net
        else:
            assert tree.end[i] - tree.start[i] <= 4


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, np.floor(64 * np.float64(v)).astype(np.int64)) for i, v in rows if v is not None and len(v) == dims and all(e is not None and np.isfinite(e) for e in v)]
    first = sorted(((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x.tolist()) for i, x in kept if i is not None))[:k]
    c, x = np.array([v for _, v in first]), np.array([v for _, v in kept])
    for _ in range(rounds):
        own = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
    far = ((x[:, None] - c) ** 2).sum(axis=2)
    own, least = far.argmin(axis=1), far.min(axis=1)
    return sorted(((str(i), int(j), int(m), int(least[own == j].sum()), int(least.sum()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), j, m in zip(kept, own, least, strict=True)), key=str)


def test_clusters_equal_brute_force(spark, monkeypatch):
    """Small blocks; a third of all rows is one vector, many tie."""
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 1.0, 1.0] if i % 3 == 0 else rng.integers(-2, 3, size=3).astype(float).tolist()) for i in range(400)]
    rows += [(None, [0.5, 0.0, 0.0]), (4, [0.25, 0.0, 0.0]), (900, None), (901, [1.0]), (902, [None, 1.0, 1.0]), (903, [float("nan"), 0.0, 0.0]), (904, [float("-inf"), 0.0, 0.0])]
    monkeypatch.setattr(dual_tree, "BLOCK", 50)
    df = vectors(spark, rows).repartition(3)
    got = sorted(((str(r.vec_id), *r[1:]) for r in dual_tree.apply(df, dims=3, k=7, rounds=3).collect()), key=str)
    assert got == brute_clusters(rows, 7, 3, 3)
    report = {}
    dual_tree.apply(df, dims=3, k=7, rounds=2, report=report)
    assert len(report["pairs"]) == 2 and report["pairs"][0]["bounded"] > 0


def test_clusters_of_odd_tables(spark):
    assert dual_tree.apply(vectors(spark, [])).collect() == []
    few = dual_tree.apply(vectors(spark, [(1, [0.0, 1.0]), (2, [5.0, 5.0])]), dims=2).collect()
    assert sorted(r.distance for r in few) == [0, 0] and len({r.cluster for r in few}) == 2
    nulls = dual_tree.apply(vectors(spark, [(None, [0.0, 1.0])]), dims=2).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in nulls] == [(None, None, None, None)]
    large = [(i, [float(v)] * 2) for i, v in enumerate([0, 1e6, -1e6, 2e6, 1e9])]  # the last is over MOST
    got = dual_tree.apply(vectors(spark, large), dims=2, k=2).collect()
    assert len(got) == 4 and sorted(((str(r.vec_id), *r[1:]) for r in got), key=str) == brute_clusters(large[:4], 2, 3, 2)
    same = dual_tree.apply(vectors(spark, [(i, [1.0, 1.0]) for i in range(20)]), dims=2).collect()
    assert {r.cluster for r in same} == {0} and {r.inertia for r in same} == {0}
