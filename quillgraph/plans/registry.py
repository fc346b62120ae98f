"""All queries of the engine, by name, with their SQL. Names begin with the inventory ids that they cover."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import verdicts as V
from ..functions.vectors import cosine
from ..operators import boilerplate, delta, diff, edges as admission, evaluate, graph, lookup, retrieval
from ..sources import java, store
from . import demo
from .demo import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, graph_sql: bool = False):
    """Registers a query under its function's name; graph_sql puts the tables of demo before it."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = (demo.SQL + sql if graph_sql else sql).strip()
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _anchors(spark: SparkSession, sf_dir: str, modulus: int = 50) -> DataFrame:
    """Anchors of traversal queries: the methods whose number is divisible by the modulus; each anchor is one query."""
    return demo.chunks(spark, sf_dir).where(F.col("vec_id") % modulus == 0).select(F.col("chunk_id").alias("anchor"))


def _anchor(spark: SparkSession, sf_dir: str) -> str:
    return demo.chunks(spark, sf_dir).where("vec_id = 0").first()["chunk_id"]


_REACH = """
, pairs AS (SELECT src, dst FROM calls UNION SELECT dst, src FROM calls{belongs}),
reach AS (SELECT chunk_id AS anchor, chunk_id AS node, 0 AS hop FROM e WHERE vec_id % 50 = 0 UNION SELECT anchor, dst, hop + 1 FROM reach JOIN pairs ON node = src WHERE hop < {depth}),
near AS (SELECT anchor, node, min(hop) AS hop FROM reach WHERE node IN (SELECT chunk_id FROM e) GROUP BY ALL)
"""
_BOTH = " UNION SELECT src, dst FROM belongs UNION SELECT dst, src FROM belongs"


@query(_REACH.format(belongs=_BOTH, depth=2) + "SELECT anchor, node, hop FROM near", True)
def g1_expand(spark, sf_dir):
    return graph.expand(demo.edges(spark, sf_dir), _anchors(spark, sf_dir), 2, demo.chunks(spark, sf_dir))


@query(_REACH.format(belongs="", depth=3) + "SELECT anchor, node, hop FROM near", True)
def g2_context(spark, sf_dir):
    return graph.context(demo.edges(spark, sf_dir), _anchors(spark, sf_dir), demo.chunks(spark, sf_dir), 3)


@query(
    _REACH.format(belongs=_BOTH, depth=2)
    + "SELECT anchor, node, hop FROM near UNION ALL SELECT DISTINCT a.chunk_id, b.chunk_id, 1 FROM e a JOIN e b ON a.fq = b.fq AND a.chunk_id <> b.chunk_id WHERE a.vec_id % 50 = 0 AND (a.chunk_id, b.chunk_id) NOT IN (SELECT anchor, node FROM near)",
    True,
)
def g3_retrieval_expansion(spark, sf_dir):
    return graph.retrieval_expansion(demo.edges(spark, sf_dir), _anchors(spark, sf_dir), demo.chunks(spark, sf_dir), 2, 10)


_PATHS = """
, w AS (SELECT src, [src, dst] AS nodes, dst AS last, 1 AS length FROM calls WHERE src = (SELECT chunk_id FROM e WHERE vec_id = 0)
  UNION ALL SELECT w.src, list_append(nodes, c.dst), c.dst, length + 1 FROM w JOIN calls c ON w.last = c.src WHERE length < {hops} AND NOT list_contains(nodes, c.dst))
"""


#: A method three calls away: 0 calls 3, 3 calls 24, 24 calls 171, all modulo the number of methods.
_FAR = "(SELECT chunk_id FROM e, k WHERE vec_id = 171 % n)"


def _far(spark, sf_dir) -> str:
    c = demo.chunks(spark, sf_dir)
    return c.where(F.col("vec_id") == 171 % c.count()).first()["chunk_id"]


def _beside(spark, sf_dir) -> str:
    """The least method that calls what the anchor calls, but can't be reached from the anchor."""
    edges, anchor = graph.by_type(demo.edges(spark, sf_dir), "CALLS"), _anchor(spark, sf_dir)
    reached = graph.paths_from_anchor(edges, anchor, demo.chunks(spark, sf_dir), 6).select("node")
    called = edges.where(F.col("src") == anchor).select("dst")
    return edges.join(called, "dst", "left_semi").select(F.col("src").alias("node")).join(reached, "node", "left_anti").orderBy("node").first()["node"]


_BESIDE = """
, far AS (SELECT chunk_id AS node, 0 AS hop FROM e WHERE vec_id = 0 UNION SELECT dst, hop + 1 FROM far JOIN calls ON node = src WHERE hop < 6),
beside AS (SELECT min(src) AS node FROM calls WHERE dst IN (SELECT dst FROM calls WHERE src = (SELECT chunk_id FROM e WHERE vec_id = 0)) AND src NOT IN (SELECT node FROM far)),
steps AS (SELECT src, dst, 'OUT' AS direction FROM calls UNION SELECT dst, src, 'IN' FROM calls),
u AS (SELECT dst AS last, [src, dst] AS nodes, [direction] AS ways, 1 AS length FROM steps WHERE src = (SELECT chunk_id FROM e WHERE vec_id = 0)
  UNION ALL SELECT s.dst, list_append(nodes, s.dst), list_append(ways, s.direction), length + 1 FROM u JOIN steps s ON u.last = s.src WHERE length < 4 AND NOT list_contains(nodes, s.dst)),
least AS (SELECT * FROM u WHERE last = (SELECT node FROM beside) QUALIFY length = min(length) OVER ()),
told AS (SELECT *, list_transform(range(1, length + 1), lambda i: '{"src":"' || nodes[i] || '","dst":"' || nodes[i + 1] || '","rel_type":"CALLS","direction":"' || ways[i] || '"}') AS json FROM least),
best AS (FROM told ORDER BY array_to_string(nodes, chr(10)) || chr(10) || '[' || array_to_string(json, ',') || ']' LIMIT 3)
"""


@query(
    _PATHS.format(hops=4)
    + f", t AS (SELECT * FROM w WHERE last = {_FAR}) SELECT array_to_string(nodes, ' > ') AS path, length FROM t WHERE length = (SELECT min(length) FROM t) ORDER BY path LIMIT 3",
    True,
)
def g4_shortest_paths(spark, sf_dir):
    found = graph.shortest_paths(demo.edges(spark, sf_dir), _anchor(spark, sf_dir), _far(spark, sf_dir), 4)
    return found.select(F.array_join("nodes", " > ").alias("path"), F.col("length").cast("int").alias("length"))


@query(_BESIDE + "SELECT nodes[1] || array_to_string(list_transform(range(1, length + 1), lambda i: CASE WHEN ways[i] = 'OUT' THEN ' -[CALLS]-> ' ELSE ' <-[CALLS]- ' END || nodes[i + 1]), '') AS path, length FROM best", True)
def g5_f16_undirected_paths(spark, sf_dir):
    found = graph.shortest_paths(demo.edges(spark, sf_dir), _anchor(spark, sf_dir), _beside(spark, sf_dir), 4, directed=False)
    return found.select(T.render_path(F.col("nodes"), F.col("edges")).alias("path"), F.col("length").cast("int").alias("length"))


@query(
    _PATHS.format(hops=3)
    + ", a AS (SELECT chunk_id AS node, [chunk_id] AS nodes, 0 AS length FROM e WHERE vec_id = 0 UNION ALL SELECT last, nodes, length FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY length, nodes) AS k FROM a) "
    "SELECT node, array_to_string(nodes, ' > ') AS path FROM r WHERE k = 1",
    True,
)
def g6_paths_from_anchor(spark, sf_dir):
    found = graph.paths_from_anchor(demo.edges(spark, sf_dir), _anchor(spark, sf_dir), demo.chunks(spark, sf_dir), 3)
    return found.select("node", F.array_join("path", " > ").alias("path"))


@query("SELECT DISTINCT dst AS node, 'CALLS' AS edge_type, 'OUT' AS direction FROM calls WHERE src = (SELECT chunk_id FROM e WHERE vec_id = 0) UNION SELECT src, 'CALLS', 'IN' FROM calls WHERE dst = (SELECT chunk_id FROM e WHERE vec_id = 0)", True)
def g8_neighbours(spark, sf_dir):
    return graph.neighbours(demo.edges(spark, sf_dir), _anchor(spark, sf_dir))


@query()
def g9_call_chain(spark, sf_dir):
    return graph.call_chain(demo.edges(spark, sf_dir), _anchors(spark, sf_dir), 3)


@query(_REACH.format(belongs=_BOTH, depth=1) + ", ids AS (SELECT DISTINCT node FROM near), i AS (SELECT src, dst, 'CALLS' AS edge_type FROM calls WHERE src IN (FROM ids) AND dst IN (FROM ids)) SELECT *, greatest((SELECT count(*) FROM i) - 200, 0) AS omitted FROM i ORDER BY src, dst LIMIT 200", True)
def g10_topology(spark, sf_dir):
    return graph.neighbourhood_topology(demo.edges(spark, sf_dir), _anchors(spark, sf_dir), demo.chunks(spark, sf_dir), 1)


@query(
    _BESIDE + _PATHS.format(hops=4) + f", t AS (SELECT * FROM w WHERE last = {_FAR}), a AS (SELECT array_to_string(nodes, ' > ') AS path, length FROM t WHERE length = (SELECT min(length) FROM t) ORDER BY path LIMIT 3) "
    "SELECT 'far' AS target, path, length, true AS directed FROM a UNION ALL SELECT 'beside', array_to_string(nodes, ' > '), length, false FROM best",
    True,
)
def g11_path_or_undirected(spark, sf_dir):
    found = lambda name, target: graph.path_or_undirected(demo.edges(spark, sf_dir), _anchor(spark, sf_dir), target, 4).select(F.lit(name).alias("target"), F.array_join("nodes", " > ").alias("path"), F.col("length").cast("int").alias("length"), "directed")
    return found("far", _far(spark, sf_dir)).union(found("beside", _beside(spark, sf_dir)))


@query(
    _REACH.format(belongs=_BOTH, depth=1)
    + ", s AS (FROM near UNION ALL SELECT DISTINCT a.chunk_id, b.chunk_id, 1 FROM e a JOIN e b ON a.fq = b.fq AND a.chunk_id <> b.chunk_id WHERE a.vec_id % 50 = 0 AND (a.chunk_id, b.chunk_id) NOT IN (SELECT anchor, node FROM near)) "
    "SELECT anchor, node, hop, place FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY hop, node)::INT AS place FROM s) WHERE place <= 10",
    True,
)
def g12_neighbourhood(spark, sf_dir):
    return graph.neighbourhood(demo.edges(spark, sf_dir), _anchors(spark, sf_dir), demo.chunks(spark, sf_dir), 1, 10)


_SIBLINGS = ", sib AS (SELECT DISTINCT a.chunk_id AS anchor, b.chunk_id AS node, 1 AS hop FROM e a JOIN e b ON a.fq = b.fq AND a.chunk_id <> b.chunk_id WHERE a.vec_id % 50 = 0)"


@query(
    _REACH.format(belongs=_BOTH, depth=2) + _SIBLINGS + " SELECT node, min(hop)::INT AS hop FROM (FROM near UNION ALL FROM sib) WHERE node NOT IN (SELECT chunk_id FROM e WHERE vec_id % 2 = 0) GROUP BY node HAVING min(hop) > 0 ORDER BY hop, node LIMIT 40",
    True,
)
def g13_coverage(spark, sf_dir):
    got = demo.chunks(spark, sf_dir).where("vec_id % 2 = 0").select("chunk_id")
    return graph.coverage(demo.edges(spark, sf_dir), _anchors(spark, sf_dir), demo.chunks(spark, sf_dir), got, 1, 2, 40)


@query(
    _REACH.format(belongs=_BOTH, depth=1)
    + """, first AS (SELECT node, min(struct_pack(request := vec_id, hop := hop)) AS f FROM near JOIN e ON anchor = chunk_id GROUP BY node), counts AS (SELECT f.request AS request, count(*) AS n FROM first GROUP BY ALL),
begun AS (SELECT request FROM (SELECT request, coalesce(sum(n) OVER (ORDER BY request ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counts) WHERE before < 30)
SELECT f.request AS request, node, f.hop AS hop FROM first WHERE f.request IN (FROM begun)""",
    True,
)
def g14_requested_context(spark, sf_dir):
    asked = demo.chunks(spark, sf_dir).where("vec_id % 50 = 0").select(F.col("vec_id").alias("request"), "chunk_id")
    return graph.requested_context(demo.edges(spark, sf_dir), asked, demo.chunks(spark, sf_dir), 30)


@query("SELECT split_part(fq, '.', 1) AS package_name, fq AS fq_class_name, array_to_string(list_sort(list(chunk_id)), ',') AS methods FROM e GROUP BY ALL", True)
def g15_a6_hierarchy(spark, sf_dir):
    return graph.hierarchy(demo.chunks(spark, sf_dir)).withColumn("methods", F.array_join("methods", ","))


@query("SELECT chunk_id, (SELECT count(*) FROM calls WHERE dst = chunk_id) AS fan_in, (SELECT count(*) FROM calls WHERE src = chunk_id) AS fan_out FROM e", True)
def a1_a2_fans(spark, sf_dir):
    edges, ids = demo.edges(spark, sf_dir), demo.chunks(spark, sf_dir)
    return graph.fan_in(edges, ids).join(graph.fan_out(edges, ids), "chunk_id")


@query("SELECT 'edge' AS what, 'CALLS' AS kind, count(*) AS n FROM calls UNION ALL SELECT 'edge', 'BELONGS_TO', count(*) FROM belongs UNION ALL SELECT 'node', 'method', count(*) FROM e UNION ALL SELECT 'node', 'class', count(DISTINCT fq) FROM e", True)
def a5_a10_summary(spark, sf_dir):
    c = demo.chunks(spark, sf_dir)
    nodes = c.select(F.lit("method").alias("kind")).union(c.select("fq_class_name").distinct().select(F.lit("class")))
    return graph.summary(demo.edges(spark, sf_dir), nodes)


@query("SELECT DISTINCT src, dst, edge_type, greatest(count(*) OVER () - 200, 0) AS omitted FROM (SELECT DISTINCT src, dst, 'CALLS' AS edge_type FROM calls) ORDER BY src, dst, edge_type LIMIT 200", True)
def o2_o3_topology(spark, sf_dir):
    return graph.topology(graph.by_type(demo.edges(spark, sf_dir), "CALLS"), 200)


_QUERY_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _vector(spark, sf_dir) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])


@query(f"SELECT chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], {_QUERY_VECTOR}::DOUBLE[]), 6) AS similarity FROM e ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_QUERY_VECTOR}::DOUBLE[]) DESC, chunk_id LIMIT 20", True)
def v1_nearest(spark, sf_dir):
    return retrieval.nearest(demo.embeddings(spark, sf_dir), _vector(spark, sf_dir), 20).withColumn("similarity", F.round("similarity", 6))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def v2_cosine(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.round(cosine(F.col("embedding").cast("array<double>"), F.col("other").cast("array<double>")), 6).alias("cosine"))


_RANKED = (
    _REACH.format(belongs=_BOTH, depth=2).replace("vec_id % 50 = 0", "vec_id = 0")
    + f"""
, sib AS (SELECT a.chunk_id AS anchor, b.chunk_id AS node, 1 AS hop FROM e a JOIN e b ON a.fq = b.fq AND a.chunk_id <> b.chunk_id WHERE a.vec_id = 0 AND b.chunk_id NOT IN (SELECT node FROM near)),
hits AS (SELECT chunk_id FROM e ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_QUERY_VECTOR}::DOUBLE[]) DESC, chunk_id LIMIT 20),
cand AS (SELECT node AS chunk_id, hop FROM (FROM near UNION ALL FROM sib) UNION ALL SELECT chunk_id, NULL FROM hits WHERE chunk_id NOT IN (SELECT node FROM near UNION ALL SELECT node FROM sib)),
feat AS (SELECT c.chunk_id, c.hop, e.fq, greatest(0, list_cosine_similarity(e.embedding::DOUBLE[], {_QUERY_VECTOR}::DOUBLE[])) AS semantic, 1.0 / (1.0 + coalesce(hop, 3)) AS graph,
  ((CASE WHEN e.fq = a.fq THEN 1.0 ELSE 0.0 END) + (CASE WHEN split_part(e.fq, '.', 1) = split_part(a.fq, '.', 1) THEN 0.5 ELSE 0.0 END)
   + least((SELECT count(*) FROM calls WHERE dst = c.chunk_id) / 3.0, 1.0) * 0.3 + least((SELECT count(*) FROM calls WHERE src = c.chunk_id) / 3.0, 1.0) * 0.2) / 2.0 AS structural
  FROM cand c JOIN e ON e.chunk_id = c.chunk_id CROSS JOIN (SELECT fq FROM e WHERE vec_id = 0) a),
ranked AS (SELECT *, 0.6 * semantic + 0.3 * graph + 0.1 * structural AS score FROM feat)
"""
)


def _reranked(spark, sf_dir) -> tuple[DataFrame, str]:
    c, edges, emb = demo.chunks(spark, sf_dir), demo.edges(spark, sf_dir), demo.embeddings(spark, sf_dir)
    anchor, vector = _anchor(spark, sf_dir), _vector(spark, sf_dir)
    reached = graph.retrieval_expansion(edges, c.where("vec_id = 0").select(F.col("chunk_id").alias("anchor")), c, 2, 10)
    found = retrieval.candidates(reached, retrieval.nearest(emb, vector, 20))
    return retrieval.rerank(found, c, emb, edges, vector, anchor), anchor


@query(_RANKED + "SELECT chunk_id, round(semantic, 6) AS semantic, round(graph, 6) AS graph, round(structural, 6) AS structural, round(score, 6) AS score FROM ranked", True)
def v3_v8_rerank(spark, sf_dir):
    r = _reranked(spark, sf_dir)[0]
    return r.select("chunk_id", *(F.round(c, 6).alias(c) for c in ("semantic", "graph", "structural", "score")))


_SELECTED = (
    _RANKED
    + """
, b AS (SELECT *, CASE WHEN chunk_id = (SELECT chunk_id FROM e WHERE vec_id = 0) THEN 0 WHEN chunk_id IN (SELECT src FROM calls WHERE dst = (SELECT chunk_id FROM e WHERE vec_id = 0)) THEN 1
  WHEN chunk_id IN (SELECT dst FROM calls WHERE src = (SELECT chunk_id FROM e WHERE vec_id = 0)) THEN 2 WHEN fq = (SELECT fq FROM e WHERE vec_id = 0) THEN 3 ELSE 4 END AS bk, row_number() OVER (ORDER BY score DESC, chunk_id) AS rk FROM ranked),
i AS (SELECT *, row_number() OVER (PARTITION BY bk ORDER BY rk) > [2, 3, 2, 2, 0][bk + 1] AS extra FROM b),
p AS (SELECT *, row_number() OVER (ORDER BY extra, bk, rk) AS position FROM i),
chosen AS (SELECT chunk_id, position::INT AS position, ['anchor', 'callers', 'callees', 'type', 'topo'][bk + 1] AS bucket, extra AS topology_only, round(score, 6) AS score FROM p WHERE position <= 10)
"""
)


@query(_SELECTED + "FROM chosen", True)
def v9_selection(spark, sf_dir):
    ranked, anchor = _reranked(spark, sf_dir)
    out = retrieval.select(ranked, demo.edges(spark, sf_dir), demo.chunks(spark, sf_dir), anchor, 10)
    return out.withColumn("score", F.round("score", 6))


@query(_SQL["v9_selection"])
def v11_hybrid_retrieval(spark, sf_dir):
    """Flagship: the whole retrieval for the method and vector 0."""
    out = retrieval.retrieve(demo.chunks(spark, sf_dir), demo.embeddings(spark, sf_dir), demo.edges(spark, sf_dir), _vector(spark, sf_dir), _anchor(spark, sf_dir))
    return out.withColumn("score", F.round("score", 6))


@query(
    _SELECTED + _PATHS.format(hops=6) + ", a AS (SELECT chunk_id AS node, [chunk_id] AS nodes, 0 AS length FROM e WHERE vec_id = 0 UNION ALL SELECT last, nodes, length FROM w), "
    "r AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY node ORDER BY length, nodes) = 1) SELECT chunk_id, position, array_to_string(nodes, ' -> ') AS path FROM chosen LEFT JOIN r ON node = chunk_id",
    True,
)
def v12_enriched(spark, sf_dir):
    chosen = v11_hybrid_retrieval(spark, sf_dir)
    paths, _ = retrieval.enrich(chosen, demo.edges(spark, sf_dir), _anchor(spark, sf_dir))
    return paths.select("chunk_id", "position", F.array_join("path", " -> ").alias("path"))


@query("SELECT * FROM (VALUES (10, 'anchor', 2), (10, 'callers', 3), (10, 'callees', 2), (10, 'type', 2), (10, 'topo', 1), (8, 'anchor', 1), (8, 'callers', 2), (8, 'callees', 2), (8, 'type', 2), (8, 'topo', 1), (6, 'anchor', 2), (6, 'callers', 2), (6, 'callees', 1), (6, 'type', 1), (6, 'topo', 0)) t(k, bucket, places)")
def v9_slots(spark, sf_dir):
    rows = [(k, b, n) for k in (10, 8, 6) for b, n in retrieval.slots(k, True).items()]
    return spark.createDataFrame(rows, "k int, bucket string, places int")


def _demo_classes(spark, sf_dir) -> DataFrame:
    return demo.chunks(spark, sf_dir).select(F.col("fq_class_name").alias("fq_name"), F.col("class_name").alias("simple_name"), "file_path", "package_name").distinct()


@query("SELECT DISTINCT 'C' || label AS identifier, fq AS fq_name, 2 AS rule FROM e UNION ALL SELECT DISTINCT fq, fq, 1 FROM e UNION ALL SELECT DISTINCT 'C' || label || '.java', fq, 3 FROM e", True)
def j3_find_classes(spark, sf_dir):
    c = _demo_classes(spark, sf_dir)
    asked = c.select(F.col("simple_name").alias("identifier")).union(c.select("fq_name")).union(c.select(F.concat("simple_name", F.lit(".java"))))
    return lookup.find_classes(c, asked)


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')")
def w7_keyword_search(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("method_name"), F.col("lang").alias("class_name"), F.col("text").alias("code"), F.col("source").alias("chunk_id"))
    return lookup.search(d, "LICENSE").select("doc_id")


@query("SELECT 'CALLS' AS edge_type, src, dst FROM calls", True)
def g7_induced(spark, sf_dir):
    return graph.induced(demo.edges(spark, sf_dir), demo.chunks(spark, sf_dir))


@query("SELECT DISTINCT a.chunk_id AS anchor, b.chunk_id AS node FROM e a JOIN e b ON a.fq = b.fq AND a.chunk_id <> b.chunk_id", True)
def j4_siblings(spark, sf_dir):
    return graph.siblings(demo.edges(spark, sf_dir), demo.chunks(spark, sf_dir).select(F.col("chunk_id").alias("anchor")))


@query("SELECT 'C' || label || '#m' || vec_id AS identifier, chunk_id, 2 AS rule, 1::BIGINT AS candidates FROM e UNION ALL SELECT 'm' || vec_id, chunk_id, 3, 1 FROM e UNION ALL SELECT chunk_id, chunk_id, 1, 1 FROM e UNION ALL SELECT 'C' || label, min(chunk_id), 4, count(*) FROM e GROUP BY label", True)
def j2_a4_find_methods(spark, sf_dir):
    c = demo.chunks(spark, sf_dir)
    asked = c.select(F.concat("class_name", F.lit("#"), "method_name").alias("identifier")).union(c.select("method_name")).union(c.select("chunk_id")).union(c.select("class_name").distinct())
    return lookup.find_methods(c, asked)


@query("SELECT vec_id::INT AS query_id, chunk_id FROM e", True)
def j14_w8_query_anchor(spark, sf_dir):
    c = demo.chunks(spark, sf_dir)
    asked = c.select(F.col("vec_id").cast("int").alias("query_id"), F.concat(F.lit("Refactor the NoSuch.Thing and "), "class_name", F.lit("#"), "method_name", F.lit(" to async, please")).alias("query"))
    return lookup.query_anchor(c, asked)


@query("SELECT e.chunk_id, len(embedding)::INT AS dims FROM e", True)
def s8_s9_w11_hydrate(spark, sf_dir):
    ids = demo.chunks(spark, sf_dir).select("chunk_id")
    rows = lookup.hydrate(demo.chunks(spark, sf_dir), ids)
    return rows.join(lookup.stored_embeddings(demo.embeddings(spark, sf_dir), ids), "chunk_id").select("chunk_id", F.size("embedding").alias("dims"))


@query("SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC)::INT AS age FROM conversations QUALIFY age <= 3")
def l14_last_messages(spark, sf_dir):
    return lookup.last_messages(table(spark, sf_dir, "conversations"), 3)


# Token budgets over the texts: null texts count as empty, words and white space are those of ASCII in both dialects

_TOKENS = "len(regexp_extract_all({}, '[A-Za-z0-9_]+|[^\\x20\\x09-\\x0DA-Za-z0-9_]'))"


def _texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query(f"SELECT doc_id, {_TOKENS.format("coalesce(text, '')")}::INT AS tokens FROM documents")
def f1_token_count(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", T.token_count(F.col("text")).alias("tokens"))


def _packed(budget: int) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n+$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\n+$', ''), chr(10)), 1) AS i FROM d),
t AS (SELECT *, {_TOKENS.format("line")} AS n FROM l),
f AS (SELECT doc_id, i, 1 AS part, n FROM t WHERE i = 1 UNION ALL
  SELECT t.doc_id, t.i, CASE WHEN f.n + t.n > {budget} THEN part + 1 ELSE part END, CASE WHEN f.n + t.n > {budget} THEN t.n ELSE f.n + t.n END FROM f JOIN t ON t.doc_id = f.doc_id AND t.i = f.i + 1),
p AS (SELECT doc_id, part::INT AS part, sum(t.n)::INT AS tokens, string_agg(line || chr(10), '' ORDER BY i) AS text FROM f JOIN t USING (doc_id, i) GROUP BY doc_id, part)
"""


@query(_packed(120) + "FROM p")
def f4_pack_lines(spark, sf_dir):
    d = _texts(spark, sf_dir).select("doc_id", F.posexplode(T.pack_lines(F.col("text"), 120)).alias("p", "text"))
    return d.select("doc_id", (F.col("p") + 1).alias("part"), T.token_count(F.col("text")).alias("tokens"), "text")


@query(_packed(512) + f"SELECT doc_id, CASE WHEN {_TOKENS.format('d.text')} <= 512 THEN 1 ELSE count(*) END::INT AS parts FROM d JOIN p USING (doc_id) GROUP BY doc_id, d.text")
def f2_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(T.split_code(F.col("text"), 512)).alias("parts"))


@query("SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS text FROM documents")
def f9_squeeze(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", T.squeeze(F.col("text")).alias("text"))


@query("SELECT chunk_id, 'm' || vec_id AS simple_name, 'C' || label || '.m' || vec_id AS short_name, fq || '#m' || vec_id || '(int, List)' AS canonical FROM e", True)
def f5_f6_f7_f21_names(spark, sf_dir):
    c = demo.chunks(spark, sf_dir)
    long = F.concat(F.regexp_replace("chunk_id", r"\(\)$", ""), F.lit("(int, java.util.List<Map<String, X>>)#part2"))
    return c.select("chunk_id", T.simple_name(F.col("chunk_id")).alias("simple_name"), T.short_name(F.concat("chunk_id", F.lit("#part3"))).alias("short_name"), T.canonical_id(long).alias("canonical"))


@query(
    "SELECT chunk_id, repeat('═', 72) || chr(10) || 'Class: C' || label || chr(10) || 'Fully Qualified: ' || fq || chr(10) || 'File: p' || (label % 3) || '/C' || label || '.java' || chr(10) || 'Class Signature: class C' || label || chr(10) || chr(10) || 'Imports:' || chr(10) || "
    "'  - import java.util.List;' || chr(10) || chr(10) || 'Method:' || chr(10) || '  - void m' || vec_id || '()' || chr(10) || '  Lines: 1-2' || chr(10) || '  Tokens: 4' || chr(10) || chr(10) || 'Code:' || chr(10) || 'void m' || vec_id || '()' || chr(10) AS value FROM e",
    True,
)
def f17_k3_prompts(spark, sf_dir):
    none = F.array().cast("array<string>")
    c = demo.chunks(spark, sf_dir).withColumns({"imports": F.array(F.lit("import java.util.List;"), F.lit("import java.lang.String;")), "class_annotations": none, "field_declarations": none, "method_annotations": none, "calls": none, "called_by": none})
    c = c.withColumns({"class_signature": F.concat(F.lit("class "), "class_name"), "method_signature": F.concat(F.lit("void "), "method_name", F.lit("()")), "start_line": F.lit(1), "end_line": F.lit(2), "token_count": T.token_count(F.col("code")), "part_index": F.lit(1), "total_parts": F.lit(1)})
    return store.readable_chunks(c)


# Responses of models, made from conversation turns


def _responses(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("text is not null")
    n = F.col("conv_id") * 31 + F.col("turn")
    # escaped as in JSON, so that the plain form has one line, no fence and no further heading
    line = F.replace(F.replace(F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)^\{"t":"(.*)"\}$', 1), F.lit("`"), F.lit("\\u0060")), F.lit(":"), F.lit("\\u003a"))
    js = F.to_json(F.struct(F.when(n % 2 == 0, "SAFE").otherwise("UNSAFE").alias("verdict"), ((n % 11) / 10.0).alias("confidence"), F.array(F.struct(F.col("text").alias("description"), F.when(n % 5 == 0, "HIGH").otherwise("low").alias("severity"))).alias("risks"), F.array(F.lit("none"), F.concat(F.lit("A.b"), n)).alias("needs"), F.col("text").alias("feedback")))
    text = F.concat(F.lit("CONFIDENCE: 0."), n % 10, F.lit("\nVERDICT: "), F.when(n % 2 == 0, "SAFE").otherwise("UNSAFE"), F.lit("\nRISKS:\n- breaking "), line, F.lit("\nNEEDS:\n- X.y\n\nFEEDBACK: "), line)
    return c.select("conv_id", "turn", F.when(n % 3 == 0, F.concat(F.lit("Here:\n```json\n"), js, F.lit("\n```\n"))).when(n % 3 == 1, js).otherwise(text).alias("response"))


_VERDICT = """
WITH r AS (SELECT conv_id, turn, conv_id * 31 + turn AS n FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, n % 2 = 0 AS safe, CASE WHEN n % 3 = 2 THEN round((n % 10) / 10.0, 6) ELSE round((n % 11) / 10.0, 6) END::DOUBLE AS confidence, n % 3 <> 2 AS from_json, CASE WHEN n % 3 = 2 THEN 'X.y' ELSE 'A.b' || n END AS needs,
  CASE WHEN n % 3 = 2 THEN 'HIGH' WHEN n % 5 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity, n % 2 = 0 AND CASE WHEN n % 3 = 2 THEN (n % 10) / 10.0 >= 0.9 ELSE (n % 11) / 10.0 >= 0.9 END AND n % 3 <> 2 AND n % 5 <> 0 AS is_safe FROM r
"""


@query(_VERDICT)
def l1_l4_w13_safety_verdict(spark, sf_dir):
    r = _responses(spark, sf_dir).withColumn("v", V.safety_verdict(F.col("response")))
    return r.select("conv_id", "turn", "v.safe", F.round("v.confidence", 6).alias("confidence"), F.col("v.parsed_from_json").alias("from_json"), F.array_join("v.needs", ",").alias("needs"), F.get("v.risks", F.lit(0))["severity"].alias("severity"), V.is_safe(F.col("v")).alias("is_safe"))


@query("WITH r AS (SELECT conv_id, turn, conv_id * 31 + turn AS n FROM conversations WHERE text IS NOT NULL) SELECT CASE WHEN n % 3 = 2 OR n % 5 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity, count(*) AS n FROM r GROUP BY ALL")
def a11_risk_counts(spark, sf_dir):
    r = _responses(spark, sf_dir).select(F.explode(V.safety_verdict(F.col("response"))["risks"]).alias("x"))
    return r.groupBy(F.col("x.severity").alias("severity")).agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT conv_id, turn, conv_id * 31 + turn AS n FROM conversations WHERE text IS NOT NULL) SELECT conv_id AS run_id, avg(CASE WHEN n % 3 <> 2 THEN 1.0 ELSE 0.0 END) AS fidelity FROM r GROUP BY ALL")
def a12_json_fidelity(spark, sf_dir):
    r = _responses(spark, sf_dir).select(F.col("conv_id").alias("run_id"), V.safety_verdict(F.col("response"))["parsed_from_json"].alias("parsed_from_json"))
    return evaluate.json_fidelity(r)


@query("SELECT conv_id AS run_id, turn AS iteration, coalesce((turn // 2) = lag(turn // 2) OVER (PARTITION BY conv_id ORDER BY turn), false) AS stagnant FROM conversations")
def l5_stagnation(spark, sf_dir):
    """Two turns name the same two risks, in other spellings; the next two name others, or fewer."""
    c, k = table(spark, sf_dir, "conversations"), F.floor(F.col("turn") / 2)
    risk = lambda x: F.struct(F.when(F.col("turn") % 2 == 0, F.upper(x)).otherwise(x).alias("description"), F.lit("LOW").alias("severity"))
    risks = F.when(k % 3 == 0, F.array(risk(F.concat(F.lit("breaks "), k)))).otherwise(F.array(risk(F.concat(F.lit("breaks "), k)), risk(F.lit("is slow"))))
    said = F.to_json(F.struct(F.lit("UNSAFE").alias("verdict"), F.lit(0.5).alias("confidence"), risks.alias("risks")))
    return evaluate.stagnation(c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("iteration"), V.safety_verdict(said)["risks"].alias("risks")))


@query("SELECT conv_id, turn, (conv_id + turn) % 2 = 0 AS safe, 0.5::DOUBLE AS confidence, (conv_id + turn) % 3 <> 0 AS from_json FROM conversations")
def l6_distributed_verdict(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    n = F.col("conv_id") + F.col("turn")
    flag = F.when(n % 2 == 0, "true").otherwise("false")
    r = c.select("conv_id", "turn", V.distributed_verdict(F.when(n % 3 == 0, F.concat(F.lit("safe: "), flag, F.lit(", confidence = 0.5"))).otherwise(F.concat(F.lit('{"safe": '), flag, F.lit(', "confidence": 0.5, "issues": ["x"]}')))).alias("v"))
    return r.select("conv_id", "turn", "v.safe", "v.confidence", F.col("v.parsed_from_json").alias("from_json"))


@query("SELECT conv_id, turn, (conv_id + turn) % 2 = 0 AS passed, least(1.0, (turn % 13) / 10.0)::DOUBLE AS score, 2 AS issues FROM conversations")
def l7_judge_verdict(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    said = F.concat(F.lit("VERDICT: "), F.when((F.col("conv_id") + F.col("turn")) % 2 == 0, "PASS").otherwise("FAIL"), F.lit("\nSCORE: "), F.round((F.col("turn") % 13) / 10.0, 1), F.lit("\nFEEDBACK:\n- a\n2. b"))
    r = c.select("conv_id", "turn", V.judge_verdict(said).alias("v"))
    return r.select("conv_id", "turn", "v.passed", "v.score", F.size("v.issues").alias("issues"))


@query("SELECT conv_id, turn, 'class A' || turn || ' {}' AS code, 'because' AS explanation, 'Foo,Bar' AS missing, 'one' AS breaking FROM conversations")
def l8_f12_f15_response(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    said = F.concat(F.lit("EXPLANATION: because\n```java\nclass A"), "turn", F.lit(" {}\n```\nBREAKING CHANGES:\n- one\nMISSING: [Foo, `Bar`]"))
    r = c.select("conv_id", "turn", V.refactor_response(said).alias("v"))
    return r.select("conv_id", "turn", "v.code", "v.explanation", F.array_join("v.missing_references", ",").alias("missing"), F.array_join("v.breaking_changes", ",").alias("breaking"))


@query("SELECT vec_id, 'replace_method' AS kind, fq AS fq_class_name, 'm' || vec_id AS method_name FROM e", True)
def l9_patch_plan(spark, sf_dir):
    from .tools import plan_from_response

    c = demo.chunks(spark, sf_dir).withColumn("method_signature", F.concat(F.lit("void "), "method_name", F.lit("()")))
    js = F.to_json(F.struct(F.array(F.struct(F.col("class_name").alias("class"), F.col("method_name").alias("method"), F.lit("void x() {}").alias("code"))).alias("code_blocks")))
    ops = F.to_json(F.struct(F.array(F.struct(F.lit("REPLACE_METHOD").alias("kind"), F.col("fq_class_name"), F.col("method_name")), F.struct(F.lit("other").alias("kind"), F.col("fq_class_name"), F.col("method_name"))).alias("ops")))
    asked = c.select(F.col("vec_id").alias("response_id"), F.when(F.col("vec_id") % 2 == 0, js).otherwise(ops).alias("response"))
    return plan_from_response(asked, c).select(F.col("response_id").alias("vec_id"), "kind", "fq_class_name", "method_name")


# Evaluation over events and labels


def _metrics(spark, sf_dir, late: bool | None = None) -> DataFrame:
    """Of all events, or of those of one half of the months, of which one stands for a baseline."""
    e = table(spark, sf_dir, "events")
    e = e if late is None else e.where((F.dayofmonth("ts") > 15) if late else (F.dayofmonth("ts") <= 15))
    return e.select(F.col("user_id").alias("fixture_id"), F.col("event_type").alias("name"), "value", "event_id", F.when(F.col("event_id") % 7 == 0, "NOT_RUN").when(F.col("event_id") % 11 == 0, "ERROR").otherwise(F.when(F.col("value") > 50, "PASS").otherwise("FAIL")).alias("status"))


_STATUS = "CASE WHEN event_id % 7 = 0 THEN 'NOT_RUN' WHEN event_id % 11 = 0 THEN 'ERROR' WHEN value > 50 THEN 'PASS' ELSE 'FAIL' END"


@query(
    f"SELECT name, pass, fail, error, not_run, round(mean_value, 6) AS mean_value, round(pass / nullif(pass + fail + error, 0), 6) AS pass_rate FROM (SELECT event_type AS name, count(*) FILTER (s = 'PASS') AS pass, count(*) FILTER (s = 'FAIL') AS fail, "
    f"count(*) FILTER (s = 'ERROR') AS error, count(*) FILTER (s = 'NOT_RUN') AS not_run, avg(value) FILTER (s IN ('PASS', 'FAIL')) AS mean_value FROM (SELECT *, {_STATUS} AS s FROM events) GROUP BY ALL)"
)
def a7_rollup(spark, sf_dir):
    r = evaluate.rollup(_metrics(spark, sf_dir))
    return r.withColumns({"mean_value": F.round("mean_value", 6), "pass_rate": F.round("pass_rate", 6)})


@query("SELECT event_type AS mode, count(*) AS fixtures, count(*) FILTER (event_id % 11 = 0) AS errors FROM events GROUP BY ALL")
def a8_runs_by_mode(spark, sf_dir):
    return evaluate.runs_by_mode(table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.when(F.col("event_id") % 11 == 0, "x").alias("error")))


def _latest(m: DataFrame) -> DataFrame:
    return m.groupBy("fixture_id", "name").agg(F.max_by("value", "event_id").alias("value"), F.max_by("status", "event_id").alias("status"))


@query(
    f"""
WITH m AS (SELECT user_id AS fixture_id, event_type AS name, day(ts) > 15 AS late, arg_max(value, event_id) AS value, arg_max({_STATUS}, event_id) AS s FROM events GROUP BY ALL)
SELECT fixture_id, name, round(b.value, 6) AS base_value, round(c.value, 6) AS value, CASE WHEN b.s = 'NOT_RUN' AND c.s = 'NOT_RUN' THEN 'UNCHANGED' WHEN b.s = 'NOT_RUN' THEN 'VERIFIER_WIRED' WHEN c.s = 'NOT_RUN' THEN 'REGRESSION'
  WHEN b.s = 'PASS' AND c.s <> 'PASS' THEN 'REGRESSION' WHEN b.s <> 'PASS' AND c.s = 'PASS' THEN 'WIN' WHEN b.value - c.value > 0.05 THEN 'REGRESSION' WHEN c.value - b.value > 0.05 THEN 'WIN' ELSE 'UNCHANGED' END AS kind
FROM (FROM m WHERE late) c JOIN (FROM m WHERE NOT late) b USING (fixture_id, name)
"""
)
def j15_f26_baseline_diff(spark, sf_dir):
    d = evaluate.baseline_diff(_latest(_metrics(spark, sf_dir, True)), _latest(_metrics(spark, sf_dir, False)))
    return d.withColumns({"base_value": F.round("base_value", 6), "value": F.round("value", 6)})


@query(
    """
WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), r AS (FROM d WHERE rank <= 10), g AS (SELECT source, doc_id FROM d JOIN labels USING (doc_id) WHERE quality = 1),
h AS (SELECT r.source, count(*) AS hits, 1.0 / min(rank) AS first FROM r JOIN g USING (source, doc_id) GROUP BY ALL), k AS (SELECT source, count(*) AS k FROM r GROUP BY ALL), n AS (SELECT source, count(*) AS n FROM g GROUP BY ALL),
a AS (SELECT k.source, k, coalesce(hits, 0) AS hits, coalesce(first, 0) AS first, coalesce(n, 0) AS n FROM k LEFT JOIN h USING (source) LEFT JOIN n USING (source)),
m AS (SELECT source, k, 'retrieval.precision@' || k AS name, hits / k AS value, n > 0 AS run FROM a UNION ALL SELECT source, k, 'retrieval.recall@' || k, CASE WHEN n = 0 THEN 0 ELSE hits / n END, n > 0 FROM a UNION ALL SELECT source, k, 'retrieval.mrr', first, n > 0 FROM a UNION ALL SELECT source, k, 'retrieval.anchor.hit', 0, false FROM a)
SELECT source AS fixture_id, name, k, round(value, 6)::DOUBLE AS value, CASE WHEN NOT run THEN 'NOT_RUN' WHEN value > 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM m
"""
)
def a9_f27_retrieval_scores(spark, sf_dir):
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")))
    got = d.where("rank <= 10").select(F.col("source").alias("fixture_id"), F.col("doc_id").alias("chunk_id"), "rank")
    gold = d.join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select(F.col("source").alias("fixture_id"), F.col("doc_id").alias("chunk_id"))
    none = F.lit(None).cast("string")
    runs = d.select(F.col("source").alias("fixture_id")).distinct().withColumns({"error": none, "anchor": none, "gold_anchor": none})
    return evaluate.retrieval_scores(got, gold, runs).withColumn("value", F.round("value", 6))


@query("SELECT event_id AS fixture_id, CASE WHEN event_id % 5 <> 0 AND event_id % 3 <> 0 AND event_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS value, CASE WHEN event_id % 5 = 0 THEN 'ERROR' WHEN event_id % 3 = 0 THEN 'NOT_RUN' WHEN event_id % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM events")
def f28_verdict_score(spark, sf_dir):
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(i.alias("fixture_id"), F.when(i % 3 == 0, "retrieval").otherwise("safeloop").alias("mode"), F.when(i % 5 == 0, "x").alias("error"), F.lit("SAFE").alias("expected"), (i % 2 == 0).alias("is_safe"))
    return evaluate.verdict_score(e)


@query("SELECT * FROM (VALUES ('no run', 2), ('nothing retrieved', 2), ('dry run', 0), ('failed self-check', 1), ('error', 1), ('regression', 1), ('fine', 0), ('failed metrics alone', 0)) t(what, code)")
def a15_exit_code(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    runs = lambda error, n: e.select(F.when(error, "x").alias("error"), F.lit(n).alias("n_retrieved"))
    metrics, fine = _metrics(spark, sf_dir, True), F.lit(False)
    worse = spark.createDataFrame([("WIN",), ("REGRESSION",)], "kind string")
    codes = {
        "no run": evaluate.exit_code(runs(fine, 1).limit(0), metrics), "nothing retrieved": evaluate.exit_code(runs(fine, 0), metrics), "dry run": evaluate.exit_code(runs(fine, 0), metrics, dry_run=True),
        "failed self-check": evaluate.exit_code(runs(fine, 1), metrics, self_check=True), "error": evaluate.exit_code(runs(F.col("event_id") % 11 == 0, 1), metrics), "regression": evaluate.exit_code(runs(fine, 1), metrics, worse),
        "fine": evaluate.exit_code(runs(fine, 1), metrics.where("status = 'PASS'"), worse.where("kind = 'WIN'"), self_check=True), "failed metrics alone": evaluate.exit_code(runs(fine, 1), metrics),
    }
    return functools.reduce(DataFrame.union, (df.select(F.lit(what).alias("what"), "code") for what, df in codes.items()))


@query("SELECT s_suppkey AS id FROM supplier WHERE regexp_matches(s_name, '1$') AND s_nationkey % 2 = 0")
def w9_filter_fixtures(spark, sf_dir):
    f = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("id"), F.lit("Retrieval").alias("mode"), F.when(F.col("s_nationkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("tags"), "s_suppkey")
    return evaluate.filter_fixtures(f, "1$", "retrieval", ["b", "a"]).select(F.col("s_suppkey").alias("id"))


@query("SELECT s_name AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'schemaVersion must be 1' WHEN s_suppkey % 3 = 1 THEN 'gold.relevant is empty' ELSE 'mode is unknown' END AS problem FROM supplier")
def w10_fixture_errors(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    gold = F.struct(F.lit(None).cast("string").alias("anchor"), F.when(k == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("relevant"))
    f = table(spark, sf_dir, "supplier").select(F.when(k == 0, 2).otherwise(1).alias("schemaVersion"), F.col("s_name").alias("id"), F.when(k == 2, "other").otherwise("retrieval").alias("mode"), F.lit("q").alias("query"), gold.alias("gold"))
    return evaluate.fixture_errors(f)


# Diffs over parts, as methods


def _parsed(spark, sf_dir, changed: bool) -> DataFrame:
    k = F.col("p_partkey")
    one = lambda cond, a, b: F.when(cond, a).otherwise(b) if changed else F.lit(b)
    return table(spark, sf_dir, "part").select(
        k.cast("string").alias("chunk_id"), F.col("p_brand").alias("class_name"), F.col("p_name").alias("method_name"), one(k % 4 == 0, "long", "int").alias("return_type"), F.array(F.lit("int a")).alias("params"),
        one(k % 5 == 0, "private", "public").alias("visibility"), F.array().cast("array<string>").alias("throws"), F.when(F.lit(changed) & (k % 3 == 0), F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x"))).alias("calls"),
        F.when(F.lit(changed) & (k % 7 == 0), F.array().cast("array<string>")).otherwise(F.array(F.lit("@Override"))).alias("annotations"), one(k % 2 == 0, "{ b; }", "{ a; }").alias("body"), F.lit(False).alias("parse_error"))


@query(
    """
WITH p AS (SELECT p_partkey AS k, p_partkey % 4 = 0 OR p_partkey % 5 = 0 AS sig FROM part), c AS (SELECT l_partkey AS k, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY ALL)
SELECT k::VARCHAR AS chunk_id, sig AS signature_changed, k % 2 = 0 AND NOT sig AND k % 7 <> 0 AS body_only, ((k % 4 = 0)::INT + (k % 5 = 0)::INT + (k % 3 = 0)::INT + (k % 7 = 0)::INT) AS change_count,
  round(1 - least(1.0, (CASE WHEN sig THEN least(coalesce(n, 0) * 0.4, 0.8) ELSE 0 END) + (CASE WHEN k % 5 = 0 THEN 0.3 ELSE 0 END) + (CASE WHEN k % 3 = 0 THEN 0.05 ELSE 0 END) + (CASE WHEN k % 7 = 0 THEN 0.05 ELSE 0 END)), 6)::DOUBLE AS safety FROM p LEFT JOIN c USING (k)
"""
)
def f24_v13_w14_w15_diff_score(spark, sf_dir):
    pack = lambda df, side: df.select("chunk_id", F.struct(*diff.PARSED).alias(side))
    pairs = pack(_parsed(spark, sf_dir, False), "old").join(pack(_parsed(spark, sf_dir, True), "new"), "chunk_id")
    edges = table(spark, sf_dir, "lineitem").select(F.lit("CALLS").alias("edge_type"), F.col("l_suppkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst")).distinct()
    return diff.score(diff.diff(pairs), edges).select("chunk_id", "signature_changed", "body_only", "change_count", F.round("safety", 6).alias("safety"))


@query(
    """
WITH o AS (SELECT p_partkey::VARCHAR AS id, p_brand AS c, p_name AS m FROM part WHERE p_partkey % 10 <> 9), n AS (SELECT p_partkey AS k, p_brand AS c, p_name AS m FROM part WHERE p_partkey % 10 <> 8),
exact AS (SELECT k, id FROM (SELECT c, m, min(k) AS k FROM n WHERE c <> '' GROUP BY ALL) JOIN (SELECT c, m, max(id) AS id FROM o WHERE c <> '' GROUP BY ALL) USING (c, m)),
lo AS (SELECT id, m, row_number() OVER (PARTITION BY m ORDER BY id) AS r FROM o WHERE id NOT IN (SELECT id FROM exact)), ln AS (SELECT k, m, row_number() OVER (PARTITION BY m ORDER BY k) AS r FROM n WHERE k NOT IN (SELECT k FROM exact)),
pairs AS (FROM exact UNION ALL SELECT k, id FROM ln JOIN lo USING (m, r)),
x AS (SELECT (SELECT count(*) FROM pairs) AS diffs, (SELECT count(*) FROM o WHERE id NOT IN (SELECT id FROM pairs)) AS deleted, (SELECT count(*) FROM n WHERE k NOT IN (SELECT k FROM pairs) AND k % 5 <> 0) AS added,
  (SELECT count(*) FROM pairs WHERE k % 7 = 0) AS lost, (SELECT count(*) FROM pairs WHERE k % 4 = 0 OR k % 5 = 0) AS signatures,
  (SELECT min(round(1 - ((k % 5 = 0)::INT * 0.3 + (k % 3 = 0)::INT * 0.05 + (k % 7 = 0)::INT * 0.05), 10)) FROM pairs) AS safety)
SELECT what, n::DOUBLE AS n FROM (SELECT unnest([{'what': 'diffs', 'n': diffs}, {'what': 'deleted', 'n': deleted}, {'what': 'added', 'n': added}, {'what': 'lost_overrides', 'n': lost},
  {'what': 'safety', 'n': CASE WHEN deleted + added + lost + signatures > 0 THEN least(safety, 0.3) ELSE safety END}], recursive := true) FROM x)
"""
)
def j16_j17_f25_w16_v14_cross_diff(spark, sf_dir):
    old = _parsed(spark, sf_dir, False).where("cast(chunk_id as int) % 10 <> 9")
    new = _parsed(spark, sf_dir, True).where("cast(chunk_id as int) % 10 <> 8").withColumn("proposal", F.col("chunk_id").cast("long")).drop("chunk_id")
    parts = diff.cross_method(old, new)
    none = spark.createDataFrame([], "edge_type string, src string, dst string")
    counts = [parts[n].agg(F.lit(n).alias("what"), F.count("*").cast("double").alias("n")) for n in ("diffs", "deleted", "added", "lost_overrides")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.unionByName(diff.loop_safety(diff.score(parts["diffs"], none), diff.violates(parts)).select(F.lit("safety").alias("what"), F.col("safety").alias("n")))


# Incremental maintenance over documents


@query("SELECT doc_id, source, CASE WHEN doc_id % 10 = 3 THEN 'new' ELSE lang END AS lang FROM documents WHERE doc_id % 10 <> 4")
def i1_k4_delta(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    old, new = d.where("doc_id % 10 <> 4"), d.where("doc_id % 10 = 3").withColumn("lang", F.lit("new"))
    return delta.upsert(old, new, "doc_id")


@query("SELECT doc_id::VARCHAR AS chunk_id FROM documents WHERE doc_id % 4 <> 0 OR doc_id % 3 = 0")
def i2_prune(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), (F.col("doc_id") % 4).cast("string").alias("file_path"))
    kept = c.where("file_path = '0' and cast(chunk_id as int) % 3 = 0")
    fields = spark.createDataFrame([], "fq_name string, owning_class_fqn string")
    classes, edges = spark.createDataFrame([], "fq_name string, file_path string"), spark.createDataFrame([], "edge_type string, src string, dst string")
    return delta.prune(c, fields, classes, edges, c.where("file_path = '0'"), kept, fields)[0].select("chunk_id")


@query("SELECT page_id, url LIKE '%.html' AS kept FROM pages")
def i3_path_guard(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", delta.guarded(F.regexp_replace(F.regexp_replace("url", "^https?:/", "/root"), r"\.html$", ".java"), "/root").alias("kept"))


# Edges admitted to a graph: supplier -> nation -> region


@query(
    "SELECT 'BELONGS_TO' AS edge_type, s_name AS src, n_name AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'CONTAINS', r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey "
    "UNION ALL SELECT 'USES_TYPE', s_name, 'T' || s_nationkey FROM supplier"
)
def j5_j13_k5_admit(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    raw = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("BELONGS_TO").alias("edge_type"), F.col("s_name").alias("src"), F.col("n_name").alias("dst"))
    raw = raw.union(r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("CONTAINS"), "r_name", "n_name")).union(s.select(F.lit("USES_TYPE"), "s_name", F.concat(F.lit("T"), "s_nationkey")))
    raw = raw.union(s.select(F.lit("BELONGS_TO"), "s_name", F.lit("nowhere"))).union(s.select(F.lit("CALLS"), "s_name", F.lit("unknown()")))
    classes = n.select(F.col("n_name").alias("fq_name"), F.lit(False).alias("is_interface"))
    return admission.admit(raw, s.select(F.col("s_name").alias("id")), classes, spark.createDataFrame([], "fq_name string"))[0]


@query("SELECT DISTINCT dst AS id, (SELECT count(*) FROM calls c WHERE c.dst = calls.dst)::INT AS callers FROM calls", True)
def j1_reverse_calls(spark, sf_dir):
    c = demo.edges(spark, sf_dir).where("edge_type = 'CALLS'").groupBy(F.col("src").alias("chunk_id")).agg(F.collect_list("dst").alias("calls"))
    return admission.reverse_calls(c).select("id", F.size("called_by").alias("callers"))


#: Method name, first statement, whether it is boilerplate with one statement, and with two.
_PLAIN = [
    ("toString", "other", True, True), ("hashCode", "return", True, True), ("builder", "other", True, True), ("getX", "return", True, False), ("getX", "assign", False, False), ("get", "return", False, False), ("setX", "assign", True, False),
    ("setX", "return", False, False), ("set", "assign", False, False), ("isOpen", "return", True, False), ("hasNext", "return", True, False), ("is", "return", False, False), ("island", "return", True, False), ("work", "return", False, False),
]


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 1 THEN [" + ", ".join(str(x[2]) for x in _PLAIN) + "][(p_partkey % 14) + 1] ELSE [" + ", ".join(str(x[3]) for x in _PLAIN) + "][(p_partkey % 14) + 1] END AS plain FROM part")
def w1_w3_boilerplate(spark, sf_dir):
    k = (F.col("p_partkey") % 14 + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in _PLAIN)), k)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), boilerplate.is_boilerplate_method(pick(0), F.when(F.col("p_size") % 2 == 1, 1).otherwise(2), pick(1)).alias("plain"))


# The whole index build over generated sources: one file for each supplier


def _sources(spark, sf_dir) -> DataFrame:
    n = F.col("s_suppkey").cast("string")
    nxt = (F.col("s_suppkey") + 1).cast("string")
    code = F.concat(
        F.lit("package q.p"), F.col("s_nationkey"), F.lit(";\nimport java.util.List;\n/** S */\npublic class S"), n, F.lit(" extends Base implements Runnable {\n  private int x, y = 1;\n  public int getX() { return x; }\n"),
        F.lit("  @Override\n  public void run() throws IOException { int a = getX(); work(a, \"}\"); }\n  List<String> work(int k, String s) { if (k > 0) { return null; } helper.go(k); return null; }\n}\n"), F.lit("// "), nxt)
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("src/S"), n, F.lit(".java")).alias("file_path"), code.alias("source"), "s_suppkey")


@query(
    "WITH s AS (SELECT 'q.p' || s_nationkey || '.S' || s_suppkey AS c FROM supplier) SELECT c || '#getX()' AS chunk_id, true AS is_boilerplate, '' AS calls, c || '#run()' AS called_by FROM s UNION ALL "
    "SELECT c || '#run()', false, c || '#getX(),' || c || '#work(int, String)', '' FROM s UNION ALL SELECT c || '#work(int, String)', false, 'helper.go(...)', c || '#run()' FROM s"
)
def s4_p1_p16_chunks(spark, sf_dir):
    c = java.Tables(java.scan(_sources(spark, sf_dir))).chunks
    return c.select("chunk_id", "is_boilerplate", F.array_join("calls", ",").alias("calls"), F.array_join("called_by", ",").alias("called_by"))


@query(
    "WITH s AS (SELECT 'q.p' || s_nationkey AS p, 'q.p' || s_nationkey || '.S' || s_suppkey AS c FROM supplier) SELECT edge_type, count(*) AS n FROM (SELECT 'CALLS' AS edge_type FROM s UNION ALL SELECT 'CALLED_BY' FROM s UNION ALL "
    "SELECT unnest(['BELONGS_TO', 'BELONGS_TO', 'CONTAINS', 'EXTENDS', 'IMPLEMENTS', 'HAS_FIELD', 'HAS_FIELD', 'USES_TYPE', 'USES_TYPE', 'RETURNS_TYPE', 'RETURNS_TYPE', 'THROWS']) FROM s) GROUP BY ALL"
)
def k5_p17_graph(spark, sf_dir):
    edges, _ = java.Tables(java.scan(_sources(spark, sf_dir))).graph()
    return edges.groupBy("edge_type").agg(F.count("*").alias("n"))


from . import batches, builds, details  # noqa: E402, F401  their queries register themselves
