"""Incremental re-indexing, as a batch or as a stream of changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boilerplate, delta
from ..operators.edges import admit, with_called_by
from ..sources.java import Tables, scan
from ..sources.store import GraphStore, embed
from ..sources.tables import cut


def reindex(store: GraphStore, changed: DataFrame, root: str = "", budget: int = 512, embedder=None) -> None:
    """Changed (file_path, source): guard, scan, prune, upsert, embed. Files that don't scan are left as they are stored.

    All tables of a batch are committed together, so a batch that fails leaves the graph as it was, and one that is run again gives the
    same tables. Vectors of methods that are gone or have other code go, too; with an embedder the new code gets new ones.
    """
    files = changed.where(delta.guarded(F.col("file_path"), root)) if root else changed.where(F.endswith("file_path", F.lit(".java")))
    scanned = scan(files.dropDuplicates(["file_path"]), budget).where("error is null")
    new = Tables(scanned)
    chunks = boilerplate.drop(new.chunks)
    edges, stubs = new.graph()
    classes = new.classes.unionByName(stubs.select("fq_name", "simple_name", "is_interface"), allowMissingColumns=True)
    if store.exists("chunks"):
        old = {n: store.read(n) for n in ("chunks", "fields", "classes", "edges")}
        kept_chunks, kept_fields, kept_edges = delta.prune(old["chunks"], old["fields"], old["classes"], old["edges"], scanned.select("file_path"), chunks, new.fields)
        # calls into files that didn't change are admitted against the stored methods
        ids = kept_chunks.select(F.regexp_replace("chunk_id", r"#part\d+$", "").alias("id")).union(chunks.select(F.regexp_replace("chunk_id", r"#part\d+$", "").alias("id"))).distinct()
        all_classes = delta.upsert(old["classes"], new.classes, "fq_name")
        edges, stubs = admit(new.edges(), ids, all_classes, kept_fields.unionByName(new.fields))
        classes = new.classes.unionByName(stubs.select("fq_name", "simple_name", "is_interface"), allowMissingColumns=True)
        edges = delta.upsert(kept_edges, edges, "edge_type", "src", "dst")
        # callers in files that didn't change: the way back of every call
        edges = edges.where("edge_type <> 'CALLED_BY'").unionByName(edges.where("edge_type = 'CALLS'").select(F.lit("CALLED_BY").alias("edge_type"), F.col("dst").alias("src"), F.col("src").alias("dst")))
        every = with_called_by(delta.upsert(kept_chunks, chunks, "chunk_id")).select(old["chunks"].columns)
        tables = {"chunks": every, "fields": delta.upsert(kept_fields, new.fields, "fq_name"), "edges": edges, "classes": delta.upsert(old["classes"], classes, "fq_name")}
    else:
        tables = {"chunks": chunks, "fields": new.fields, "edges": edges, "classes": classes}
    tables["packages"] = store.merged("packages", new.packages)
    if store.exists("embeddings"):
        same = store.read("chunks").select("chunk_id", "code").join(tables["chunks"].select("chunk_id", "code"), ["chunk_id", "code"], "left_semi").select("chunk_id")
        tables["embeddings"] = store.read("embeddings").join(same, "chunk_id", "left_semi")
    if embedder is not None:
        vectors = embed(chunks, embedder)
        tables["embeddings"] = delta.upsert(tables["embeddings"], vectors, "chunk_id") if "embeddings" in tables else vectors
    store.replace({n: cut(df) if n in ("chunks", "edges") else df for n, df in tables.items()})


def follow(spark: SparkSession, incoming: str, store: GraphStore, checkpoint: str, root: str = "", budget: int = 512, embedder=None):
    """I1 as a stream: parquet files of (file_path, source, changed_at) in `incoming`; each micro-batch is one reindex of the latest
    version of each file. Started with availableNow, it ends when all is in; the checkpoint makes it go on where it was."""
    changes = spark.readStream.schema("file_path string, source string, changed_at timestamp").parquet(incoming)

    def batch(df: DataFrame, number: int) -> None:
        latest = df.groupBy("file_path").agg(F.max_by("source", "changed_at").alias("source"))
        reindex(store, latest, root, budget, embedder)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
