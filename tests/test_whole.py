"""Queries against brute force: texts beyond ASCII, and walks that SQL has no form for."""

import re

from quillgraph.operators import graph
from quillgraph.plans import registry

WORD = r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]"
TEXTS = [None, "", "plain  text,\tyes", "Ça  et là – une idée !", "größer_als 3\n\n\nzwei Wörter\n\n", "emoji 😀😀 x\n" * 60, "año " * 300 + "\n" + "b c\n" * 90, "  \u0085 é\x1c"]


def saved_texts(spark, folder) -> str:
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def count(text) -> int:
    return len(re.findall(WORD, text, re.ASCII))


def packed(text, budget=120):
    parts, open_, n = [], "", 0
    for line in re.sub(r"\n+\Z", "", text).split("\n"):
        k = count(line)
        if open_ and n + k > budget:
            parts, open_, n = [*parts, open_], "", 0
        open_, n = open_ + line + "\n", n + k
    return [*parts, open_]


def test_texts_beyond_ascii(spark, tmp_path):
    sf, q = saved_texts(spark, tmp_path / "sf"), registry.queries()
    texts = [t or "" for t in TEXTS]
    assert dict(map(tuple, q["f1_token_count"](spark, sf).collect())) == {i: count(t) for i, t in enumerate(texts)}
    want = [(i, k, count(p), p) for i, t in enumerate(texts) for k, p in enumerate(packed(t), 1)]
    assert sorted(map(tuple, q["f4_pack_lines"](spark, sf).collect())) == want
    want = {i: re.sub(r"\s+", " ", t, flags=re.ASCII).strip(" ") for i, t in enumerate(texts)}
    assert dict(map(tuple, q["f9_squeeze"](spark, sf).collect())) == want


def test_responses_hold_whole_texts(spark, tmp_path):
    """Two turns of one conversation with an equal start and other ends are two risks, in each of the three forms."""
    text = 'An equal start of both turns, {"a": "b"}\n```\nRISKS:\n- and end '
    rows = [(c, t, "user", text + str(t)) for c in range(3) for t in (3, 6)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    r = registry._responses(spark, str(tmp_path)).withColumn("v", registry.V.safety_verdict(registry.F.col("response")))
    found = [(x.conv_id, x.v.risks[0].description) for x in r.collect()]
    assert len(found) == len(set(found)) == 6 and all("and end" in d for _, d in found)


def test_call_chains(spark):
    """Pre-order walks, each node at its first visit."""
    from quillgraph.operators import graph
    from quillgraph.plans import demo

    edges = demo.edges(spark, "/root/testdata/sf0.001").where("edge_type = 'CALLS'")
    rows = edges.select("src", "dst").collect()
    anchors = sorted({r.src for r in rows})[:7]
    for callers in (False, True):
        to = {}
        for r in rows:
            a, b = (r.dst, r.src) if callers else (r.src, r.dst)
            to.setdefault(a, set()).add(b)
        want = []
        for a in anchors:
            seen = []

            def walk(node, depth, seen=seen):
                if node in [x for x, _ in seen]:
                    return
                seen.append((node, depth))
                for other in sorted(to.get(node, ())) if depth < 3 else ():
                    walk(other, depth + 1)

            walk(a, 0)
            want += [(a, i, n, d) for i, (n, d) in enumerate(seen)]
        df = spark.createDataFrame([(a,) for a in anchors], "anchor string")
        assert sorted(map(tuple, graph.call_chain(edges, df, 3, callers).collect())) == sorted(want)


def test_generics_at_any_depth(spark):
    from pyspark.sql import functions as F

    from quillgraph.functions.text import canonical_id

    cases = {"a.B#m(java.util.Map<A<B<C<D>>>>, x.Y<Z>[])#part2": "a.B#m(Map, Y[])", "a.B#m(List<? extends Map<K, List<V>>> , int)": "a.B#m(List, int)", "f": "f", "a.B#m()": "a.B#m()"}
    df = spark.createDataFrame([(k,) for k in cases], "id string")
    assert {r.id: r.c for r in df.select("id", canonical_id(F.col("id")).alias("c")).collect()} == cases


def test_vector_index(spark, tmp_path):
    """Rows without a direction are filed but never found; probing all cells gives the exact result; retrieval takes an index."""
    from quillgraph.operators import retrieval
    from quillgraph.operators.vector_index import VectorIndex
    from quillgraph.plans import demo

    sf = "/root/testdata/sf0.001"
    e = demo.embeddings(spark, sf)
    odd = spark.createDataFrame([("n", None), ("z", [0.0, 0.0]), ("x", [float("nan"), 1.0])], "chunk_id string, embedding array<float>")
    index = VectorIndex.build(e.unionByName(odd), f"file://{tmp_path}/index", rows=50)
    assert index.rows.count() == e.count() + 3 and index.rows.where("cell = -1").count() == 3
    query = list(e.orderBy("chunk_id").first()["embedding"])
    exact = [tuple(r) for r in retrieval.nearest(e, query, 12).collect()]
    assert [tuple(r) for r in index.nearest(query, 12, probes=len(index.centre)).collect()] == exact
    anchor = exact[0][0]
    plain, by_index = (retrieval.retrieve(demo.chunks(spark, sf), e, demo.edges(spark, sf), query, anchor, index=i).collect() for i in (None, index))
    assert sorted(plain) == sorted(by_index)
    assert retrieval.retrieve(demo.chunks(spark, sf), e, demo.edges(spark, sf), query, None, 5).count() == 5
    empty = VectorIndex.build(odd.limit(0), f"file://{tmp_path}/none")
    assert empty.rows.count() == 0


def test_pairs_of_members(spark, monkeypatch):
    """Expansion and siblings where types are cut into blocks and methods belong to several types, against walks by hand."""
    monkeypatch.setattr(graph, "BLOCK", 2)
    rows = [("BELONGS_TO", f"m{i}", f"T{i % 3}") for i in range(24)] + [("BELONGS_TO", f"m{i}", "T0") for i in (1, 2, 4)] + [("BELONGS_TO", f"m{i}", "T1") for i in (2, 5)] + [("BELONGS_TO", "m1", "T0"), ("BELONGS_TO", "field", "T1")]
    rows += [("CALLS", f"m{i}", f"m{(i * 7 + 3) % 24}") for i in range(24)] + [("CALLS", "m1", "m4"), ("CALLS", "lone", "m3"), ("BELONGS_TO", "lone", "T9")]
    names = [f"m{i}" for i in range(24)] + ["lone"]
    edges, methods = spark.createDataFrame(rows, "edge_type string, src string, dst string"), spark.createDataFrame([(n,) for n in names], "chunk_id string")
    anchors = spark.createDataFrame([("m1",), ("m2",), ("m2",), ("m9",), ("lone",), ("T1",)], "anchor string")
    steps, own = {}, {(s, d) for t, s, d in rows if t == "BELONGS_TO"}
    for _, s, d in rows:
        steps.setdefault(s, set()).add(d)
        steps.setdefault(d, set()).add(s)

    def walk(a, depth):
        hops = {a: 0}
        for k in range(1, depth + 1):
            for n in [n for n, h in hops.items() if h == k - 1]:
                for d in steps.get(n, ()):
                    hops.setdefault(d, k)
        return {(a, n, h) for n, h in hops.items()}

    asked = ["m1", "m2", "m9", "lone", "T1"]
    got = lambda df: sorted(map(tuple, df.collect()))
    want = sorted(w for a in asked for w in walk(a, 2))
    assert got(graph.expand(edges, anchors, 2)) == want
    for depth in (1, 3):
        want = sorted(w for a in asked for w in walk(a, depth))
        assert got(graph.expand(edges, anchors, depth, methods)) == [w for w in want if w[1] in names]
    beside = sorted({(a, n) for a in asked for s, t in own if s == a for n, u in own if u == t and n != a})
    assert got(graph.siblings(edges, anchors)) == beside
    for depth, top_k in ((1, 10), (2, 60)):
        want = set()
        for a in asked:
            found = {w for w in walk(a, depth) if w[1] in names}
            # a type as anchor isn't among its neighbours
            if len(found) - 1 < top_k // 2:
                found = {w for w in walk(a, depth + 1) if w[1] in names}
            want |= found | {(a, n, 1) for x, n in beside if x == a and n not in {w[1] for w in found}}
        assert got(graph.retrieval_expansion(edges, anchors, methods, depth, top_k)) == sorted(want), (depth, top_k)
