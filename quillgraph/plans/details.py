"""Queries of operators that no other query reaches: DTO classes, field access, missing context, context documents, truncation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import boilerplate, edges as admission, keyword_index, lookup, prompts, retrieval
from ..sources.parted import PartedGraph
from ..sources.store import GraphStore
from ..sources.tables import shared_path
from . import demo
from .demo import table
from .registry import _PATHS, _SELECTED, _anchor, query, v11_hybrid_retrieval
from .tools import RESPONSE_SCHEMAS

#: By s_suppkey % 5: the methods of a class with their first statement and number of statements.
_METHODS = [[], [("getX", "return", 1)], [("getX", "return", 1), ("work", "other", 2)], [("<init>", "assign", 1)], [("toString", "other", 3), ("setX", "assign", 1)]]


@query(
    f"""WITH c AS (SELECT s_suppkey AS k, 'S' || s_suppkey AS class_key, s_suppkey % 5 IN (1, 4) OR (s_suppkey % 5 IN (0, 3) AND (s_suppkey % 4 IN (0, 3) OR s_suppkey % 3 > 0)) AS is_dto FROM supplier),
m(i, name, plain) AS (VALUES {", ".join(f"({i}, '{n}', {str(n not in ('work', '<init>')).lower()})" for i, own in enumerate(_METHODS) for n, _, _ in own)})
SELECT class_key, is_dto, name, CASE WHEN name IS NOT NULL THEN is_dto OR plain END AS is_boilerplate FROM c LEFT JOIN m ON i = k % 5"""
)
def w4_w5_dto_classes(spark, sf_dir):
    """Classes with and without methods, by annotations and fields; a constructor alone is no method, and boilerplate only in a DTO."""
    k = F.col("s_suppkey")
    own = F.array(*(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(f).alias("first_kind"), F.lit(c).alias("n_statements")) for n, f, c in m)) if m else F.array().cast("array<struct<name:string,first_kind:string,n_statements:int>>") for m in _METHODS))
    marks = F.array(F.array(F.lit("Data")), F.array().cast("array<string>"), F.array(F.lit("Entity")), F.array(F.lit("Entity"), F.lit("Getter")))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), k).alias("class_key"), F.get(marks, (k % 4).cast("int")).alias("annotation_names"), (k % 3).cast("int").alias("n_fields"), F.get(own, (k % 5).cast("int")).alias("own"))
    methods = s.select("class_key", F.explode("own").alias("m")).select("class_key", "m.*")
    dtos = boilerplate.dto_classes(s, methods.where("name <> '<init>'"))
    return dtos.join(boilerplate.mark(methods, dtos).select("class_key", "name", "is_boilerplate"), "class_key", "left")


@query(
    """SELECT edge_type, src, dst, false AS stub FROM (SELECT 'READS_FIELD' AS edge_type, chunk_id AS src, fq || '.f' AS dst FROM e WHERE label % 2 = 0 UNION ALL SELECT 'CATCHES', chunk_id, 'java.io.IOException' FROM e
  UNION ALL SELECT 'OVERRIDES', a.chunk_id, b.chunk_id FROM e a JOIN e b ON b.vec_id = a.vec_id + 1) UNION ALL SELECT 'stub', 'java.io.IOException', 'false', true""",
    True,
)
def j12_k5_field_access(spark, sf_dir):
    """Edge types that have a way in though no build emits them: fields that exist only, methods at both ends, a stub of what is caught."""
    c = demo.chunks(spark, sf_dir).select("chunk_id", "fq_class_name", "vec_id", F.regexp_extract("class_name", r"(\d+)$", 1).cast("int").alias("label"))
    after = c.select((F.col("vec_id") - 1).alias("vec_id"), F.col("chunk_id").alias("dst"))
    edge = lambda df, kind, dst: df.select(F.lit(kind).alias("edge_type"), F.col("chunk_id").alias("src"), dst.alias("dst"))
    field = lambda name: F.concat("fq_class_name", F.lit("." + name))
    given = edge(c, "READS_FIELD", field("f")).union(edge(c, "WRITES_FIELD", field("none"))).union(edge(c, "CATCHES", F.lit("java.io.IOException"))).union(edge(c.join(after, "vec_id"), "OVERRIDES", F.col("dst")))
    classes = c.select(F.col("fq_class_name").alias("fq_name"), F.lit(False).alias("is_interface")).distinct()
    edges, stubs = admission.admit(given, c.select(F.col("chunk_id").alias("id")), classes, c.where("label % 2 = 0").select(field("f").alias("fq_name")).distinct())
    told = stubs.select(F.lit("stub").alias("edge_type"), F.col("fq_name").alias("src"), F.col("is_interface").cast("string").alias("dst"), F.lit(True).alias("stub"))
    return edges.select("edge_type", "src", "dst", F.lit(False).alias("stub")).unionByName(told)


@query(
    """SELECT 'C' || label || '#m' || vec_id AS identifier, chunk_id FROM e WHERE vec_id % 2 = 0 AND vec_id % 3 <> 0 UNION ALL SELECT 'Nope.m' || vec_id, chunk_id FROM e WHERE vec_id % 2 = 1 AND vec_id % 3 <> 0
UNION SELECT 'Lost.C' || a.label, b.chunk_id FROM e a JOIN e b ON contains(b.chunk_id, 'C' || a.label) WHERE b.vec_id % 3 <> 0""",
    True,
)
def j18_missing_context(spark, sf_dir):
    """Identifiers that resolve as they are, by their simple name alone, or only as a part of ids nearby; a third of all is there already."""
    c, edges = demo.chunks(spark, sf_dir), demo.edges(spark, sf_dir)
    exact = c.where("vec_id % 2 = 0").select(F.concat("class_name", F.lit("#"), "method_name").alias("identifier"))
    named = c.where("vec_id % 2 = 1").select(F.concat(F.lit("Nope."), "method_name").alias("identifier"))
    lost = c.select(F.concat(F.lit("Lost."), "class_name").alias("identifier")).distinct()
    return lookup.missing_context(c, edges, exact.union(named).union(lost), c.where("vec_id % 3 = 0"), c.select(F.col("chunk_id").alias("node")))


def _full_chunks(spark, sf_dir) -> DataFrame:
    none = F.array().cast("array<string>")
    c = demo.chunks(spark, sf_dir).withColumns({n: none for n in ("imports", "class_annotations", "field_declarations", "method_annotations", "calls", "called_by")})
    c = c.withColumn("imports", F.transform(F.sequence(F.lit(1), F.lit(43)), lambda i: F.concat(F.lit("import a.B"), i + 100, F.lit(";"))))  # over the limit of 40
    return c.withColumns({"class_signature": F.concat(F.lit("class "), "class_name"), "method_signature": F.concat(F.lit("void "), "method_name", F.lit("()")), "start_line": F.lit(1), "end_line": F.lit(2), "token_count": T.token_count(F.col("code")), "part_index": F.lit(2), "total_parts": F.lit(3)})


_PROMPT = """'Class: C' || label || chr(10) || 'Fully Qualified: ' || fq || chr(10) || 'File: p' || (label % 3) || '/C' || label || '.java' || chr(10) || 'Class Signature: class C' || label || chr(10) || chr(10) || 'Imports:' || chr(10)
|| list_aggregate(list_transform(range(101, 141), lambda i: '  - import a.B' || i || ';' || chr(10)), 'string_agg', '') || '  ... (+3 more imports)' || chr(10) || chr(10) || 'Method:' || chr(10) || '  - void m' || vec_id || '()' || chr(10)
|| '  Lines: 1-2' || chr(10) || '  (Part 2 of 3)' || chr(10) || '  Tokens: 4' || chr(10) || chr(10) || 'Code:' || chr(10) || 'void m' || vec_id || '()' || chr(10)"""


@query(
    _SELECTED + _PATHS.format(hops=6) + f""", a AS (SELECT chunk_id AS node, [chunk_id] AS nodes, 0 AS length FROM e WHERE vec_id = 0 UNION ALL SELECT last, nodes, length FROM w),
r AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY node ORDER BY length, nodes) = 1), n AS (SELECT count(*) AS n FROM chosen), anchor AS (SELECT chunk_id AS id FROM e WHERE vec_id = 0),
t AS (SELECT position, '── Chunk ' || position || ' of ' || n || ' (score: ' || printf('%.4f', score) || CASE WHEN c.chunk_id = id THEN ', anchor' ELSE '' END || ') ──' || chr(10)
  || 'Path from anchor: ' || coalesce(array_to_string(nodes, ' -> '), '(none)') || chr(10) || {_PROMPT} || chr(10) AS text FROM chosen c JOIN e USING (chunk_id) LEFT JOIN r ON node = c.chunk_id, n, anchor)
SELECT '=== RETRIEVED CODE CONTEXT ===' || chr(10) || 'Query: how?' || chr(10) || 'Anchor: ' || id || chr(10) || 'Retrieved ' || n || ' relevant code chunks (ranked by relevance):' || chr(10) || chr(10)
  || '=== SUBGRAPH TOPOLOGY ===' || chr(10) || (SELECT coalesce(string_agg(src || ' -[CALLS]-> ' || dst || chr(10), '' ORDER BY src, dst), '') FROM calls WHERE src IN (SELECT chunk_id FROM chosen) AND dst IN (SELECT chunk_id FROM chosen)) || chr(10)
  || (SELECT string_agg(text, '' ORDER BY position) FROM t) AS context FROM n, anchor""",
    True,
)
def f18_f17_context_document(spark, sf_dir):
    """The document of the flagship's selection, with paths and calls inside it; each chunk is a part of a split method with 43 imports."""
    chosen, edges, anchor = v11_hybrid_retrieval(spark, sf_dir), demo.edges(spark, sf_dir), _anchor(spark, sf_dir)
    paths, inside = retrieval.enrich(chosen, edges, anchor)
    return retrieval.llm_context(chosen, _full_chunks(spark, sf_dir), "how?", anchor, paths.select("chunk_id", "path"), inside)


@query("SELECT count(*) AS before, false AS exists_after, 0::BIGINT AS files_after FROM (SELECT src FROM calls UNION ALL SELECT src FROM belongs)", True)
def k8_clean(spark, sf_dir):
    """A stored graph is emptied: no table and no file is left."""
    store = GraphStore(spark, shared_path(spark, "cleaned"))
    store.overwrite("edges", demo.edges(spark, sf_dir))
    before = store.read("edges").count()
    store.clean()
    return spark.createDataFrame([(before, store.exists("edges"), len(store.manifests()))], "before long, exists_after boolean, files_after long")


@query("SELECT k AS keyword, doc_id FROM documents, (VALUES ('license'), ('e t'), ('the'), ('no such words')) t(k) WHERE contains(lower(text), k) OR contains(lower(source), k) OR contains(lower(lang), k) OR contains('src.' || lower(source) || '#' || doc_id, k)")
def w7_keyword_index(spark, sf_dir):
    """Documents as chunks of types that their sources name; half of them are filed first, then all of each source."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("method_name"), F.col("lang").alias("class_name"), F.col("text").alias("code"), F.concat(F.lit("src."), F.coalesce("source", F.lit("")), F.lit("#"), "doc_id").alias("chunk_id"))
    graph = PartedGraph(spark, shared_path(spark, "grams"), 16)
    keyword_index.put(graph, d.where("doc_id % 2 = 0"))
    keyword_index.put(graph, d)
    found = [keyword_index.search(graph, d, k).select(F.lit(k.lower()).alias("keyword"), "doc_id") for k in ("LICENSE", "e t", "The", "no such words")]
    return found[0].union(found[1]).union(found[2]).union(found[3])


_PROMPT_KINDS = list(prompts.ASKS)
_PROMPT_SCHEMAS = ["refactor", "patch_plan", "analysis", "safety_check", "self_review"]


@query(
    f"""SELECT * FROM (WITH s AS (SELECT *, split_part(fq, '.', 2) || '.m' || vec_id AS name, 'void m' || vec_id || '()' AS sig FROM e),
c AS (SELECT a.chunk_id, list_sort(list(DISTINCT z.name)) AS names FROM calls x JOIN s a ON a.chunk_id = x.src JOIN s z ON z.chunk_id = x.dst GROUP BY ALL),
b AS (SELECT a.chunk_id, list_sort(list(DISTINCT z.name)) AS names FROM calls x JOIN s a ON a.chunk_id = x.dst JOIN s z ON z.chunk_id = x.src GROUP BY ALL),
g AS (SELECT i AS position, s.*, coalesce(c.names, []) AS outs, coalesce(b.names, []) AS ins, s.vec_id - i AS conv_id, '[' || s.name || CASE WHEN i = 0 THEN ' (target)' ELSE '' END || ']' || chr(10) AS title FROM s LEFT JOIN c USING (chunk_id) LEFT JOIN b USING (chunk_id), range(3) r(i)),
t AS (SELECT conv_id,
  string_agg(title || 'File: ' || split_part(fq, '.', 1) || '/' || split_part(fq, '.', 2) || '.java' || chr(10) || 'Signature: ' || sig || chr(10) || CASE WHEN vec_id % 2 = 0 THEN 'Annotations: Override, Deprecated' || chr(10) ELSE '' END || CASE WHEN position = 2 THEN '(body left out)' || chr(10) || chr(10) ELSE '```java' || chr(10) || sig || chr(10) || '```' || chr(10) || chr(10) END, '' ORDER BY position) AS code,
  string_agg(array_to_string(list_transform(outs, lambda o: '- ' || name || ' calls ' || o || chr(10)), '') || array_to_string(list_transform(ins, lambda o: '- ' || name || ' is called by ' || o || chr(10)), ''), '' ORDER BY position) AS relations,
  string_agg(title || 'Signature: ' || sig || chr(10) || CASE WHEN len(outs) > 0 THEN 'Calls: ' || array_to_string(outs, ', ') || chr(10) ELSE '' END || CASE WHEN len(ins) > 0 THEN 'Called by: ' || array_to_string(ins, ', ') || chr(10) ELSE '' END || chr(10), '' ORDER BY position) AS signatures,
  string_agg(CASE WHEN len(ins) > 0 THEN '- ' || name || ' is called by ' || array_to_string(ins, ', ') || chr(10) ELSE '' END, '' ORDER BY position) AS callers FROM g GROUP BY conv_id),
k(i, kind, ask, fields) AS (VALUES {", ".join(f"({i}, '{k}', '{prompts.ASKS[k]}', '{RESPONSE_SCHEMAS[n]}')" for i, (k, n) in enumerate(zip(_PROMPT_KINDS, _PROMPT_SCHEMAS, strict=True)))})
SELECT v.conv_id, v.turn, kind, 'Task:' || chr(10) || coalesce(v.text, '') || chr(10) || chr(10) || ask || chr(10) || chr(10)
  || CASE WHEN i >= 3 THEN 'Proposed changes:' || chr(10) || coalesce(v.role, '') || chr(10) || chr(10) ELSE '' END
  || CASE WHEN i = 3 AND v.turn % 2 = 0 THEN 'Facts, found by parsing:' || chr(10) || 'turn ' || v.turn || chr(10) || chr(10) ELSE '' END
  || CASE i WHEN 2 THEN coalesce(signatures, '') WHEN 3 THEN 'Callers:' || chr(10) || coalesce(callers, '') || chr(10) ELSE coalesce(code, '') END
  || CASE WHEN i < 2 THEN 'Relations:' || chr(10) || CASE WHEN coalesce(relations, '') = '' THEN '- none' || chr(10) ELSE relations END || chr(10) ELSE '' END
  || 'Answer with one JSON object of these fields: ' || fields AS prompt
FROM conversations v JOIN k ON k.i = (v.conv_id + v.turn) % 5 LEFT JOIN t ON t.conv_id = v.conv_id)""",
    True,
)
def l16_prompts(spark, sf_dir):
    """A prompt for each turn of a conversation, its text the task; four methods are chosen for each, of which three are shown, the third without its body."""
    n, none = F.col("conv_id") + F.col("turn"), F.array().cast("array<string>")
    turns = table(spark, sf_dir, "conversations").withColumn("request_id", F.concat("conv_id", F.lit("/"), "turn"))
    requests = turns.select("request_id", "conv_id", "turn", F.get(F.array(*map(F.lit, _PROMPT_KINDS)), (n % 5).cast("int")).alias("kind"), F.col("text").alias("task"), F.col("role").alias("changes"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("turn "), "turn")).alias("report"))
    c, calls = demo.chunks(spark, sf_dir), demo.edges(spark, sf_dir).where("edge_type = 'CALLS'")
    ends = lambda own, other, name: calls.groupBy(F.col(own).alias("chunk_id")).agg(F.array_sort(F.collect_set(other), lambda a, b: F.when(T.short_name(a) < T.short_name(b), -1).when(T.short_name(a) > T.short_name(b), 1).otherwise(0)).alias(name))
    full = c.withColumns({"method_signature": F.col("code"), "method_annotations": F.when(F.col("vec_id") % 2 == 0, F.array(F.lit("Override"), F.lit("Deprecated"))).otherwise(none)})
    full = full.join(ends("src", "dst", "calls"), "chunk_id", "left").join(ends("dst", "src", "called_by"), "chunk_id", "left")
    asked = turns.select("request_id", "conv_id").distinct().withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(3))))
    chosen = asked.join(c.select("chunk_id", "vec_id"), F.col("conv_id") + F.col("position") == F.col("vec_id")).select("request_id", "chunk_id", "position", (F.col("position") == 0).alias("is_anchor"), (F.col("position") == 2).alias("topology_only"))
    return prompts.build(requests, chosen, full, RESPONSE_SCHEMAS, 3).select("conv_id", "turn", "kind", "prompt")
