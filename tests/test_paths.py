"""Shortest paths where there are very many of them."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph

LAYERS, WIDE = 5, 16


def test_a_million_paths(spark):
    """Five full layers of 16 nodes hold 16 ** 5 paths; the least come without them."""
    layers = [["s"], *([f"n{k}.{i:02d}" for i in range(WIDE)] for k in range(LAYERS)), ["t"]]
    rows = [("CALLS", a, b) for one, two in itertools.pairwise(layers) for a in one for b in two]
    edges = spark.createDataFrame(rows, "edge_type string, src string, dst string")
    began = time.time()
    got = [r.nodes for r in graph.shortest_paths(edges, "s", "t", 6, 20).collect()]
    assert time.time() - began < 60
    want = itertools.islice(itertools.product(*layers), 20)
    assert got == [list(x) for x in want]


@pytest.mark.parametrize("seed,directed", [(0, True), (1, True), (2, False), (3, False)])
def test_paths_equal_brute_force(spark, seed, directed):
    """Ids that begin with each other, calls both ways, loops, repeated edges."""
    rng = np.random.default_rng(seed)
    names = ["a", "a#", "a#b", "ab", "b", "b()", "b()x", "c", "aa", "c d"]
    rows = {("CALLS", names[i], names[j]) for i, j in rng.integers(0, len(names), size=(22, 2))} | {("CALLED_BY", names[i], names[j]) for i, j in rng.integers(0, len(names), size=(6, 2))}
    edges = spark.createDataFrame([*rows, *list(rows)[:3]], "edge_type string, src string, dst string")
    steps = {(s, d, t, "OUT") for t, s, d in rows if t == "CALLS" or not directed} | {(d, s, t, "IN") for t, s, d in rows if not directed}
    told = lambda s: f'{{"src":"{s[0]}","dst":"{s[1]}","rel_type":"{s[2]}","direction":"{s[3]}"}}'
    for source, target in (("a", "c d"), ("ab", "b()x"), ("c", "a")):
        ways, found = [((source,), ())], []
        for _ in range(6):
            ways = [((*n, s[1]), (*e, s)) for n, e in ways for s in steps if s[0] == n[-1] and s[1] not in n]
            if found := [w for w in ways if w[0][-1] == target]:
                break
        text = lambda w: "\n".join(w[0]) + "\n[" + ",".join(map(told, w[1])) + "]"
        got = graph.shortest_paths(edges, source, target, 6, 4, directed).select(F.concat_ws("\n", F.array_join("nodes", "\n"), F.to_json("edges")).alias("t")).collect()
        assert [r.t for r in got] == sorted(map(text, found))[:4]


def test_coverage_walks_from_all_anchors_at_once(spark):
    """the rows of the pairs of anchor and node, without a row for each pair."""
    rng = random.Random(5)
    names = [f"m{i}" for i in range(30)]
    edges = [("CALLS", rng.choice(names), rng.choice(names)) for _ in range(25)] + [("BELONGS_TO", m, f"C{i % 7}") for i, m in enumerate(names) if i % 5]
    e = spark.createDataFrame(edges, "edge_type string, src string, dst string")
    anchors = spark.createDataFrame([("m1",), ("m1",), ("m10",), ("m17",), ("m28",), ("gone",)], "anchor string")
    methods, got = spark.createDataFrame([(m,) for m in names[:27]], "chunk_id string"), spark.createDataFrame([("m3",), ("m4",)], "chunk_id string")
    every = graph.expand(e, anchors, 2, methods).unionByName(graph.siblings(e, anchors).withColumn("hop", F.lit(1)))
    least = {}
    for r in every.collect():
        least[r.node] = min(r.hop, least.get(r.node, 9))
    want = sorted((h, n) for n, h in least.items() if h and n not in ("m3", "m4"))
    found = graph.coverage(e, anchors, methods, got, 1, 2, 40)
    assert want and [(r.hop, r.node) for r in found.collect()] == want
    assert "anchor#" not in found._jdf.queryExecution().optimizedPlan().toString().replace("is_anchor#", "")
