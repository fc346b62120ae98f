"""Re-indexing at the cost of the change, with the result of a full build.

Files are read again only if they changed. Of the others those are resolved again, from what was stored of them, whose names could now mean
something else: files that declare a type that a changed file declares too, that name a type which came or went, or that call a method
whose declaration changed, or one that a type declares or inherits which came, went or got other supertypes. All else stays as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boilerplate, delta
from ..operators.edges import admit
from ..sources.java import Tables, scan
from ..sources.parted import STORED, PartedGraph, owner
from ..sources.store import embed
from ..sources.tables import cut

_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"


def surface(parsed: DataFrame) -> DataFrame:
    """SURFACE of scanned files."""
    strings = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    of_method = lambda m: F.concat(
        strings(m["param_types"]), F.array(F.coalesce(m["return_type"], F.lit(""))), strings(m["throws"]), F.transform(m["scope"], lambda v: F.coalesce(v["type"], F.lit(""))),
        F.flatten(F.transform(m["calls"], lambda c: F.concat(F.array(F.coalesce(c["scope"], F.lit("")), c["name"]), strings(c["given"])))))
    of_type = lambda t: F.concat(strings(t["extends"]), strings(t["implements"]), F.transform(t["fields"], lambda f: F.coalesce(f["type"], F.lit(""))), F.flatten(F.transform(t["methods"], of_method)))
    written = F.concat_ws(" ", F.concat(strings(F.col("imports")), F.flatten(F.transform("types", of_type))))
    pkg = F.coalesce("package_name", F.lit(""))
    signed = F.transform("types", lambda t: F.struct(
        t["name"].alias("name"), t["outer"].alias("outer"), t["extends"].alias("extends"), t["implements"].alias("implements"),
        F.transform(t["methods"], lambda m: F.struct(m["name"].alias("name"), m["param_types"].alias("param_types"), m["return_type"].alias("return_type"))).alias("methods")))
    return parsed.select(
        "file_path", "package_name", "imports", signed.alias("types"), F.transform("types", lambda t: F.when(pkg == "", t["name"]).otherwise(F.concat(pkg, F.lit("."), t["name"]))).alias("owners"),
        F.array_distinct(F.regexp_extract_all(written, F.lit(_NAME), 0)).alias("mentions"))


def _types(rows: DataFrame) -> DataFrame:
    return rows.select("imports", F.posexplode("types").alias("i", "t"), "owners").select(F.get("owners", F.col("i")).alias("fq"), "t", "imports")


def _changed_names(before: DataFrame, after: DataFrame, every: DataFrame) -> DataFrame:
    """(name): a file that mentions one of them may resolve in another way. before, after: the surfaces of the changed files, every: of
    all files, old and new. It takes names that differ, so it may name too many, but never too few."""
    differ = lambda a, b: a.exceptAll(b).unionByName(b.exceptAll(a))
    methods = lambda rows: _types(rows).select("fq", "imports", F.explode("t.methods").alias("m")).select("fq", "m.name", "m.param_types", "m.return_type", "imports")
    types = lambda rows: _types(rows).select("fq", F.col("t.name").alias("name"), "t.outer", "t.extends", "t.implements", "imports")
    last = lambda x: F.substring_index(F.regexp_replace(x, r"<.*>", ""), ".", -1)
    changed = cut(differ(types(before), types(after)).select("fq", "name", "extends", "implements").distinct())
    moved = cut(differ(types(before).select("fq", "name"), types(after).select("fq", "name")).select("name").distinct())
    names = differ(methods(before), methods(after)).select("name").union(moved)
    if changed.isEmpty():
        return cut(names.distinct())
    # up from the changed types by the last parts of names, until nothing new is met: an upper bound of their supertypes
    above = _types(every).select(F.col("t.name").alias("name"), F.explode(F.concat("t.extends", "t.implements")).alias("s")).select("name", last(F.col("s")).alias("up")).distinct()
    seen = front = cut(changed.select("name").distinct())
    while not front.isEmpty():
        front = cut(above.join(front, "name", "left_semi").select(F.col("up").alias("name")).distinct().join(seen, "name", "left_anti"))
        seen = seen.unionByName(front)
    inherited = _types(every).join(seen, F.col("t.name") == seen["name"], "left_semi").select(F.explode("t.methods").alias("m")).select("m.name")
    return cut(names.union(inherited).distinct())


def _parts(graph: PartedGraph, keys: DataFrame, column: str) -> set[int]:
    """The parts of keys; at most as many numbers as there are parts."""
    return {r[0] for r in keys.select(graph.part(F.col(column))).distinct().collect()}


def update(graph: PartedGraph, changed: DataFrame, removed: DataFrame | None = None, root: str = "", budget: int = 512, embedder=None) -> dict[str, set[int]]:
    """I1-I3, K4-K7 for a batch: changed (file_path, source) and removed (file_path) files. Files that don't scan stay as they are stored.
    Vectors of methods that are gone or have other code go; with an embedder, chunks without a vector get one. Gives the written parts."""
    spark = changed.sparkSession
    files = changed.where(delta.guarded(F.col("file_path"), root)) if root else changed.where(F.endswith("file_path", F.lit(".java")))
    scanned = cut(scan(files.dropDuplicates(["file_path"]), budget).where("error is null"))
    after = cut(surface(scanned))
    paths = after.select("file_path")
    if removed is not None:
        paths = paths.union(removed.select("file_path")).distinct()
    paths = cut(paths)
    own_files = _parts(graph, paths, "file_path")
    stored = graph.stored("surface")
    before = cut(graph.stored("surface", own_files).join(paths, "file_path", "left_semi"))
    rest = stored.join(paths, "file_path", "left_anti")
    names = _changed_names(before, after, stored.unionByName(after))
    owners = cut(before.unionByName(after).select(F.explode("owners").alias("fq")).distinct())
    named = rest.select("file_path", F.explode("mentions").alias("name")).join(names, "name", "left_semi").select("file_path")
    again = cut(named.distinct())
    while True:  # files that declare a type of a file that is resolved again
        shared = rest.select("file_path", F.explode("owners").alias("fq")).join(owners, "fq", "left_semi").select("file_path")
        more = cut(shared.distinct().join(again, "file_path", "left_anti"))
        told = again.unionByName(more)
        owners = cut(owners.unionByName(rest.join(told, "file_path", "left_semi").select(F.explode("owners").alias("fq"))).distinct())
        again = told
        if more.isEmpty():
            break
    again_files = _parts(graph, again, "file_path")
    resolved = scanned.unionByName(graph.stored("parsed", again_files).join(again, "file_path", "left_semi"))
    new = Tables(resolved, rest.join(again, "file_path", "left_anti"))
    touched = _parts(graph, owners, "fq")
    kept = {t: graph.stored(t, touched).withColumn("_owner", owner(t)).join(owners, F.col("_owner") == F.col("fq"), "left_anti").drop("_owner") for t in ("chunks", "classes", "fields", "edges", "embeddings")}
    chunks = boilerplate.drop(new.chunks).drop("called_by")
    base = lambda df: df.select(F.regexp_replace("chunk_id", r"#part\d+$", "").alias("id"))
    others = lambda t: graph.stored(t).join(owners, owner(t) == owners["fq"], "left_anti")
    ids = base(others("chunks").select("chunk_id")).union(base(chunks)).distinct()
    classes = others("classes").select("fq_name", "is_interface").union(new.classes.select("fq_name", "is_interface"))
    edges, _ = admit(new.edges().where("edge_type <> 'CALLED_BY'"), ids, classes, others("fields").select("fq_name").union(new.fields.select("fq_name")))
    shaped = lambda t, df: df.select(*spark.createDataFrame([], STORED[t]).columns)
    rows = {t: kept[t].unionByName(shaped(t, df)) for t, df in (("chunks", chunks), ("classes", new.classes), ("fields", new.fields.dropDuplicates(["fq_name"])), ("edges", edges))}
    old_code = graph.stored("chunks", touched).select("chunk_id", "code")
    same = graph.stored("embeddings", touched).join(chunks.select("chunk_id", "code").join(old_code, ["chunk_id", "code"], "left_semi").select("chunk_id"), "chunk_id", "left_semi")
    vectors = kept["embeddings"].unionByName(same)
    if embedder is not None:
        vectors = vectors.unionByName(embed(chunks.join(same.select("chunk_id"), "chunk_id", "left_anti"), embedder))
    rows |= {"embeddings": vectors, "surface": graph.stored("surface", own_files).join(paths, "file_path", "left_anti").unionByName(after), "parsed": graph.stored("parsed", own_files).join(paths, "file_path", "left_anti").unionByName(shaped("parsed", scanned))}
    return graph.commit(rows, {t: own_files if t in ("surface", "parsed") else touched for t in rows})


def follow(spark: SparkSession, incoming: str, graph: PartedGraph, checkpoint: str, root: str = "", budget: int = 512, embedder=None):
    """I1 as a stream: parquet files of (file_path, source, changed_at) in `incoming`, a null source for a file that is gone; each
    micro-batch is one update with the latest version of each file. A batch that is run again gives the same tables."""
    changes = spark.readStream.schema("file_path string, source string, changed_at timestamp").parquet(incoming)

    def batch(df: DataFrame, number: int) -> None:
        latest = df.groupBy("file_path").agg(F.max(F.struct("changed_at", "source")).alias("r")).select("file_path", "r.source")
        latest = cut(latest)
        update(graph, latest.where("source is not null"), latest.where("source is null").select("file_path"), root, budget, embedder)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
