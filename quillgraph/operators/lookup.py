"""Lookups by name, in cascades: every rule is tried in one pass, the first that hits wins, ties go to the least id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifiers, simple_name


def find_methods(chunks: DataFrame, wanted: DataFrame, dotted: bool = False) -> DataFrame:
    """(identifier, chunk_id, rule, candidates) for wanted (identifier).

    Rules: 1 the id; 2 class#name, and then no further rule; 3 the method name; 4 an id that holds identifier + "#".
    dotted: Class.name counts as Class#name too. A4: candidates is the number of hits of the rule.
    """
    m = chunks.select("chunk_id", "method_name", "class_name", "fq_class_name").distinct()
    ask = wanted.select("identifier").distinct()
    hashed = F.col("identifier")
    if dotted:
        hashed = F.when(F.contains("identifier", F.lit("#")), hashed).otherwise(F.regexp_replace("identifier", r"\.([^.]+)$", "#$1"))
    ask = ask.withColumn("h", hashed).withColumn("c", F.substring_index("h", "#", 1)).withColumn("n", F.substring_index(F.substring_index("h", "#", -1), "(", 1)).withColumn("has", F.contains("h", F.lit("#")))
    keep = lambda df, k: df.select("identifier", "chunk_id", F.lit(k).alias("rule"))
    exact = keep(ask.join(m, ask["identifier"] == m["chunk_id"]), 1)
    named = ask.where("has").join(m, ask["n"] == m["method_name"]).where((F.col("fq_class_name") == F.col("c")) | (F.col("class_name") == F.col("c")) | F.endswith("fq_class_name", F.concat(F.lit("."), F.col("c"))))
    plain = ask.where("not has") if not dotted else ask.where(~F.contains("identifier", F.lit("#")))
    by_name = keep(plain.join(m, plain["identifier"] == m["method_name"]), 3)
    # a class given alone: the last part of the class name equals that of the identifier, then the id holds it
    parts = m.withColumn("last", F.substring_index("class_name", ".", -1))
    asked = plain.withColumn("last", F.substring_index("identifier", ".", -1))
    holding = keep(asked.join(parts, "last").where(F.contains("chunk_id", F.concat("identifier", F.lit("#")))), 4)
    found = exact.union(keep(named, 2)).union(by_name).union(holding)
    best = found.groupBy("identifier").agg(F.min("rule").alias("rule"))
    return found.join(best, ["identifier", "rule"]).groupBy("identifier", "rule").agg(F.min("chunk_id").alias("chunk_id"), F.count("*").alias("candidates")).select("identifier", "chunk_id", "rule", "candidates")


def find_classes(classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(identifier, fq_name, rule). Rules: 1 the full name; 2 the simple name; 3 a path's end (whole steps of it), for *.java only; 4 the end of the full name."""
    c = classes.select("fq_name", "simple_name", "file_path")
    ask = wanted.select("identifier").distinct()
    keep = lambda df, k: df.select("identifier", "fq_name", F.lit(k).alias("rule"))
    file = F.substring_index("identifier", "/", -1)
    by_file = ask.where(F.endswith("identifier", F.lit(".java"))).withColumn("f", file).join(c.withColumn("f", F.substring_index("file_path", "/", -1)), "f").where(F.endswith("file_path", F.col("identifier")))
    last = ask.withColumn("l", F.substring_index("identifier", ".", -1)).join(c.withColumn("l", F.substring_index("fq_name", ".", -1)), "l").where(F.endswith("fq_name", F.concat(F.lit("."), F.col("identifier"))))
    found = keep(ask.join(c, ask["identifier"] == c["fq_name"]), 1).union(keep(ask.join(c, ask["identifier"] == c["simple_name"]), 2)).union(keep(by_file, 3)).union(keep(last, 4))
    return found.groupBy("identifier").agg(F.min(F.struct("rule", "fq_name")).alias("b")).select("identifier", F.col("b.fq_name").alias("fq_name"), F.col("b.rule").alias("rule"))


def query_anchor(chunks: DataFrame, queries: DataFrame, dotted: bool = True) -> DataFrame:
    """(query_id, chunk_id) of the first identifier of each query (query_id, query) that resolves."""
    asked = queries.select("query_id", F.posexplode(identifiers(F.col("query"))).alias("place", "identifier"))
    hits = asked.join(find_methods(chunks, asked, dotted), "identifier")
    return hits.groupBy("query_id").agg(F.min(F.struct("place", "chunk_id")).alias("b")).select("query_id", F.col("b.chunk_id").alias("chunk_id"))


def missing_context(chunks: DataFrame, edges: DataFrame, wanted: DataFrame, have: DataFrame, near: DataFrame) -> DataFrame:
    """What `wanted` names beyond `have` (chunk_id): by J2, else by simple name, else ids of `near` (node) that hold the simple name."""
    exact = find_methods(chunks, wanted).select("identifier", "chunk_id")
    left = wanted.join(exact, "identifier", "left_anti").withColumn("name", simple_name(F.col("identifier")))
    m = chunks.select("chunk_id", "method_name").distinct()
    named = left.join(m, left["name"] == m["method_name"]).select("identifier", "chunk_id")
    rest = left.join(named, "identifier", "left_anti")
    # near holds the nodes within three hops of one anchor, rest the names of one response
    held = rest.join(near.select(F.col("node").alias("chunk_id")).distinct(), F.contains("chunk_id", F.col("name"))).select("identifier", "chunk_id")
    return exact.union(named).union(held).distinct().join(have.select("chunk_id"), "chunk_id", "left_anti")


def class_overviews(classes: DataFrame, fields: DataFrame, chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each class of wanted (fq_name): the class, its fields by name, its methods (split methods once), the imports of its least
    method. A class's fields and methods are what one file declares. Names without a class give no row."""
    own = wanted.select("fq_name").distinct()
    of = lambda df, name: df.withColumnRenamed(name, "fq_name").join(own, "fq_name", "left_semi")
    f = of(fields.select("owning_class_fqn", "name", "type", "declaration"), "owning_class_fqn").groupBy("fq_name").agg(F.sort_array(F.collect_list(F.struct("name", "type", "declaration"))).alias("fields"))
    base = F.regexp_replace("chunk_id", r"#part\d+$", "")
    first = of(chunks, "fq_class_name").groupBy("fq_name", base.alias("id")).agg(F.min_by(F.struct("method_name", "method_signature", "start_line", "end_line", "imports"), "part_index").alias("m"))
    method = F.struct("id", F.col("m.method_name").alias("method_name"), F.col("m.method_signature").alias("method_signature"), F.col("m.start_line").alias("start_line"), F.col("m.end_line").alias("end_line"))
    m = first.groupBy("fq_name").agg(F.sort_array(F.collect_list(method)).alias("methods"), F.min_by("m.imports", "id").alias("imports"))
    found = classes.join(own, "fq_name", "left_semi").join(f, "fq_name", "left").join(m, "fq_name", "left")
    kinds = {"fields": "array<struct<name:string,type:string,declaration:string>>", "methods": "array<struct<id:string,method_name:string,method_signature:string,start_line:int,end_line:int>>"}
    return found.withColumns({n: F.coalesce(n, F.array().cast(k)) for n, k in kinds.items()})


def class_overview(classes: DataFrame, fields: DataFrame, chunks: DataFrame, fq_name: str) -> DataFrame:
    """J19 for one class."""
    return class_overviews(classes, fields, chunks, classes.sparkSession.range(1).select(F.lit(fq_name).alias("fq_name")))


def search(chunks: DataFrame, keyword: str) -> DataFrame:
    """Chunks whose name, class, code or id holds the keyword, in any case."""
    k = F.lit(keyword.lower())
    hit = F.lit(False)
    for c in ("method_name", "class_name", "code", "chunk_id"):
        hit |= F.coalesce(F.contains(F.lower(c), k), F.lit(False))
    return chunks.where(hit)


def hydrate(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the ids; missing texts, numbers and lists get their defaults."""
    out = chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    empty = {"string": F.lit(""), "int": F.lit(0), "array<string>": F.array().cast("array<string>")}
    return out.select(*(F.coalesce(F.col(n), empty[t]).alias(n) if t in empty else F.col(n) for n, t in out.dtypes))


def stored_embeddings(embeddings: DataFrame, ids: DataFrame) -> DataFrame:
    """S9, W11."""
    return embeddings.where("embedding is not null").join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def last_messages(messages: DataFrame, most: int) -> DataFrame:
    """The last `most` turns of each conversation (conv_id, turn)."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))
    return messages.withColumn("age", place).where(F.col("age") <= most)
