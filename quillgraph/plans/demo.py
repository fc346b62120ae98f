"""Code-graph tables over the driver's tables, so that every operator has rows to work on.

A method is a vector: chunk_id p<label % 3>.C<label>#m<vec_id>(), its class the label, its package label % 3. With n vectors and the rank v
of a vector (its vec_id), calls go from v to (7 v + 3) mod n and to (11 v + 5) mod n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def method_id(v, label):
    return F.concat(F.lit("p"), label % 3, F.lit(".C"), label, F.lit("#m"), v, F.lit("()"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    package, fq = F.concat(F.lit("p"), F.col("label") % 3), F.concat(F.lit("p"), F.col("label") % 3, F.lit(".C"), F.col("label"))
    return e.select(
        method_id(F.col("vec_id"), F.col("label")).alias("chunk_id"), package.alias("package_name"), F.concat(F.lit("C"), F.col("label")).alias("class_name"), fq.alias("fq_class_name"),
        F.concat(F.lit("m"), F.col("vec_id")).alias("method_name"), F.concat(F.lit("void m"), F.col("vec_id"), F.lit("()")).alias("code"), F.concat(package, F.lit("/C"), F.col("label"), F.lit(".java")).alias("file_path"), "vec_id")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(method_id(F.col("vec_id"), F.col("label")).alias("chunk_id"), "embedding")


#: Path of the edges by application and folder: they stand for the stored graph, so they are written once.
_stored: dict[tuple[str, str], str] = {}


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = shared_path(spark, "demo-edges")
        _edges(spark, sf_dir).write.partitionBy("edge_type").parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key]).select("edge_type", "src", "dst")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    n = e.agg(F.count("*").alias("n"))
    # one row, a count
    calls = e.join(F.broadcast(n)).select(method_id(F.col("vec_id"), F.col("label")).alias("src"), F.explode(F.array((F.col("vec_id") * 7 + 3) % F.col("n"), (F.col("vec_id") * 11 + 5) % F.col("n"))).alias("to"))
    names = e.select(F.col("vec_id").alias("to"), method_id(F.col("vec_id"), F.col("label")).alias("dst"))
    calls = calls.join(names, "to").select(F.lit("CALLS").alias("edge_type"), "src", "dst").distinct()
    own = chunks(spark, sf_dir).select(F.lit("BELONGS_TO").alias("edge_type"), F.col("chunk_id").alias("src"), F.col("fq_class_name").alias("dst"))
    return calls.unionByName(own)


#: The same tables in SQL.
SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding, 'p' || (label % 3) || '.C' || label || '#m' || vec_id || '()' AS chunk_id, 'p' || (label % 3) || '.C' || label AS fq FROM embeddings),
k AS (SELECT count(*) AS n FROM embeddings),
calls AS (SELECT DISTINCT a.chunk_id AS src, b.chunk_id AS dst FROM e a, k, e b WHERE b.vec_id = (a.vec_id * 7 + 3) % n OR b.vec_id = (a.vec_id * 11 + 5) % n),
belongs AS (SELECT chunk_id AS src, fq AS dst FROM e)
"""
