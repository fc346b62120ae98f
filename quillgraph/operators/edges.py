"""Typed edges: assembly from chunks, and the joins that admit them to the graph (with stub nodes where the type allows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_id, canonical_id

METHOD_TO_METHOD = ("CALLS", "CALLED_BY", "OVERRIDES", "TEST_FOR")
TO_TYPE = ("USES_TYPE", "RETURNS_TYPE", "THROWS", "CATCHES")
TO_FIELD = ("READS_FIELD", "WRITES_FIELD")


def reverse_calls(chunks: DataFrame) -> DataFrame:
    """(id, called_by) over the calls of all chunks; ids of split methods count without their part."""
    calls = chunks.select(base_id(F.col("chunk_id")).alias("src"), F.explode("calls").alias("dst"))
    return calls.groupBy("dst").agg(F.sort_array(F.collect_set("src")).alias("called_by")).withColumnRenamed("dst", "id")


def with_called_by(chunks: DataFrame) -> DataFrame:
    """Chunks with called_by filled; all files must be in. Both sides of the join are in canonical spelling."""
    back = reverse_calls(chunks).withColumn("key", canonical_id(F.col("id"))).select("key", F.explode("called_by").alias("c")).groupBy("key").agg(F.sort_array(F.collect_set("c")).alias("found"))
    own = chunks.drop("called_by").withColumn("key", canonical_id(F.col("chunk_id")))
    return own.join(back, "key", "left").withColumn("called_by", F.coalesce("found", F.array().cast("array<string>"))).drop("key", "found")


def from_chunks(chunks: DataFrame, type_info: DataFrame) -> DataFrame:
    """CALLS, CALLED_BY, BELONGS_TO from chunks; type_info (id, kind, target) gives USES_TYPE, RETURNS_TYPE, THROWS, TEST_FOR."""
    src = base_id(F.col("chunk_id"))
    calls = chunks.select(src.alias("src"), F.explode("calls").alias("dst"))
    back = chunks.select(src.alias("src"), F.explode("called_by").alias("dst"))
    owner = chunks.select(src.alias("src"), F.col("fq_class_name").alias("dst"))
    typed = type_info.select(F.col("kind").alias("edge_type"), F.col("id").alias("src"), F.col("target").alias("dst"))
    tag = lambda df, t: df.select(F.lit(t).alias("edge_type"), "src", "dst")
    return tag(calls, "CALLS").union(tag(back, "CALLED_BY")).union(tag(owner, "BELONGS_TO")).unionByName(typed).distinct()


def _into(edges: DataFrame, side: str, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col(ids.columns[0]).alias(side)).distinct(), side, "left_semi").select("edge_type", "src", "dst")


def admit(edges: DataFrame, methods: DataFrame, classes: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, stubs). methods (id), classes (fq_name, is_interface), fields (fq_name).

    Methods: both ends must exist, ids compared in canonical spelling. BELONGS_TO, HAS_FIELD, CONTAINS: the type must exist. IMPLEMENTS,
    EXTENDS and types of a signature: the source must exist, a missing target becomes a stub (an interface only for IMPLEMENTS).
    IMPORTS: from classes only. INNER_CLASS_OF, field access: both ends. One table of types holds classes and interfaces.
    """
    of = lambda *types: edges.where(F.col("edge_type").isin(*types)).select("edge_type", "src", "dst")
    ids = methods.select(F.col("id"), canonical_id(F.col("id")).alias("key")).groupBy("key").agg(F.min("id").alias("id"))
    calls = of(*METHOD_TO_METHOD).select("edge_type", canonical_id(F.col("src")).alias("a"), canonical_id(F.col("dst")).alias("b"))
    calls = calls.join(ids.select(F.col("key").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("key").alias("b"), F.col("id").alias("dst")), "b").select("edge_type", "src", "dst")
    m, c, f = methods.select("id"), classes.select("fq_name"), fields.select("fq_name")
    belongs = _into(_into(of("BELONGS_TO"), "src", m), "dst", c)
    has = _into(_into(of("HAS_FIELD"), "src", c), "dst", f)
    contains = _into(of("CONTAINS"), "dst", c)
    inherits = _into(of("IMPLEMENTS", "EXTENDS"), "src", c)
    typed = _into(of(*TO_TYPE), "src", m)
    touched = _into(_into(of(*TO_FIELD), "src", m), "dst", f)
    imports = _into(_into(of("IMPORTS"), "src", classes.where("not is_interface").select("fq_name")), "dst", c)
    inner = _into(_into(of("INNER_CLASS_OF"), "src", c), "dst", c)
    all_ = calls
    for part in (belongs, has, contains, inherits, typed, touched, imports, inner):
        all_ = all_.unionByName(part)
    wanted = inherits.unionByName(typed).groupBy(F.col("dst").alias("fq_name")).agg(F.max(F.col("edge_type") == "IMPLEMENTS").alias("is_interface"))
    stubs = wanted.join(c, "fq_name", "left_anti").select("fq_name", F.substring_index("fq_name", ".", -1).alias("simple_name"), "is_interface")
    return all_.distinct(), stubs
