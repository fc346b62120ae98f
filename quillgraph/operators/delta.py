"""Incremental maintenance: prune by file, keyed upsert, path guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHOD_EDGES = ("CALLS", "CALLED_BY", "BELONGS_TO", "USES_TYPE", "RETURNS_TYPE", "THROWS", "TEST_FOR")
CLASS_EDGES = ("CONTAINS", "EXTENDS", "IMPLEMENTS", "IMPORTS")


def guarded(path: Column, root: str) -> Column:
    """A .java file under the root, without a step upwards."""
    root = root.rstrip("/") + "/"
    return F.endswith(path, F.lit(".java")) & (F.startswith(path, F.lit(root)) | ~F.startswith(path, F.lit("/"))) & ~path.rlike(r"(^|/)\.\.(/|$)")


def upsert(existing: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """K4: rows of `new` replace those of the same key; one row for each key."""
    return existing.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new.dropDuplicates(list(key)), allowMissingColumns=True)


def prune(chunks: DataFrame, fields: DataFrame, classes: DataFrame, edges: DataFrame, files: DataFrame, kept_methods: DataFrame, kept_fields: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, fields, edges) without the methods and fields of `files` (file_path) that are gone, and without the outgoing edges of
    the methods and classes that stay. Edges of other files into them stay; edges of what is gone go, on both ends."""
    touched = files.select("file_path").distinct()
    ours = chunks.join(touched, "file_path", "left_semi")
    gone_m = ours.join(kept_methods.select("chunk_id").distinct(), "chunk_id", "left_anti").select("chunk_id")
    own_classes = classes.join(touched, "file_path", "left_semi").select("fq_name")
    own_fields = fields.join(own_classes.withColumnRenamed("fq_name", "owning_class_fqn"), "owning_class_fqn", "left_semi")
    gone_f = own_fields.join(kept_fields.select("fq_name").distinct(), "fq_name", "left_anti").select("fq_name")
    base = F.regexp_replace("chunk_id", r"#part\d+$", "")
    stay = ours.join(gone_m, "chunk_id", "left_anti").select(base.alias("id")).distinct()
    lost = ours.select(base.alias("id")).distinct().join(stay, "id", "left_anti").union(gone_f)
    out = edges.join(lost.select(F.col("id").alias("src")), "src", "left_anti").join(lost.select(F.col("id").alias("dst")), "dst", "left_anti")
    wiped = stay.select(F.col("id").alias("src"), F.explode(F.array(*map(F.lit, METHOD_EDGES))).alias("edge_type"))
    wiped = wiped.union(own_classes.select(F.col("fq_name").alias("src"), F.explode(F.array(*map(F.lit, CLASS_EDGES))).alias("edge_type")))
    out = out.join(wiped, ["src", "edge_type"], "left_anti").select("edge_type", "src", "dst")
    return chunks.join(gone_m, "chunk_id", "left_anti"), fields.join(gone_f, "fq_name", "left_anti"), out


def replace_files(existing: DataFrame, new: DataFrame) -> DataFrame:
    """I1, the plain form: rows of changed files give way to the new ones."""
    return existing.join(new.select("file_path").distinct(), "file_path", "left_anti").unionByName(new, allowMissingColumns=True)
