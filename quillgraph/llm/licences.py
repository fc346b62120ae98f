"""Operator 9, licence scans by sparse TF-IDF cosine and directory inheritance. DataFrame functions and joins only.

Segments of a file: each line with a licence term (HINT); each run of adjacent comment lines and each paragraph with one (headers are
wrapped over lines); and the whole text of a licence file (named LICENSE, LICENCE, COPYING, NOTICE or UNLICENSE, with any ending).
Segments and templates are vectors of terms (runs of a-z and 0-9 in lower case), weighed by count * idf, idf = ln((1 + n) / (1 + df)) + 1
over the distinct segments of all files and the templates. A segment takes the template of the largest cosine if that is at least
COSINE and its words hold the marks of the licence (version, variant) and none of another; a text that says that it isn't licensed
takes none. A file takes its best segment's. Equal segments are compared once; 128 bits tell them.

A file without a licence of its own inherits that of the nearest ancestor directory (its own first) that has a licence file with a
licence; of several licence files in one directory the best score counts, then the least path.

Edge cases: null text has no segments; a null path has no directory and inherits nothing; ties of cosine go to the least licence
name; rows of one id and path are one file, and each gets its row; a text of any length is one row, and its terms are rows; a hot
segment or directory is dealt by salts in joins; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import saved
from .licence_texts import DENIED, MARKS, TEMPLATES

COSINE, SALTS = 0.6, 16
HINT = r"(?i)licen[cs]e|copyright|spdx|permission (is hereby granted|to use)|public domain|warrant(y|ies)|redistribut|cc0|unencumbered"
LICENCE_FILE = r"(?i)^(un)?licen[cs]e([-_.].*)?$|^copying([-_.].*)?$|^notice([-_.].*)?$"
#: Begins a comment line; a line with a term; what parts runs of lines.
COMMENT, TERM, CUT = r"^[ \t]*(#|//|/\*|\*|--|;|%|<!--)", "[A-Za-z0-9]", "\x01"


def directory(path: Column) -> Column:
    """All before the last slash; null if there is none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _runs(lines: Column, inside) -> Column:
    """Adjacent lines that are inside, joined by spaces."""
    return F.split(F.array_join(F.transform(lines, lambda x: F.when(inside(x), x).otherwise(CUT)), " "), CUT, -1)


def segments(files: DataFrame) -> DataFrame:
    """(id, path, segment) of files (id, path, text)."""
    name = F.regexp_extract(F.coalesce("path", F.lit("")), r"(?s)([^/]*)$", 1)
    hinted = files.where(F.col("text").rlike(HINT) | (name.rlike(LICENCE_FILE) & F.col("text").isNotNull())).select("id", "path", "text", F.split("text", "\n", -1).alias("lines"), name.rlike(LICENCE_FILE).alias("whole"))
    some = F.filter(F.concat("lines", _runs(F.col("lines"), lambda x: x.rlike(COMMENT)), _runs(F.col("lines"), lambda x: x.rlike(TERM))), lambda x: x.rlike(HINT))
    whole = F.when(F.col("whole"), F.array("text")).otherwise(F.array().cast("array<string>"))
    return hinted.select("id", "path", F.explode(F.array_distinct(F.transform(F.concat(some, whole), lambda x: F.btrim(x)))).alias("segment"))


def _marked(norm: Column, license: Column) -> Column:
    """Whether the words of a text hold the marks of a licence."""
    out = F.lit(True)
    for name, (needed, other) in MARKS.items():
        out = F.when(license == name, norm.rlike(needed) & ~norm.rlike(other)).otherwise(out)
    return out & ~norm.rlike(DENIED)


def matched(distinct: DataFrame, templates=TEMPLATES, cosine: float = COSINE) -> DataFrame:
    """(h, i, license, score) of distinct segments (h, i, segment) that reach a template; h and i are their digest."""
    spark = distinct.sparkSession
    rows = ", ".join("({}, '{}', '{}')".format(i, n.replace("'", "\\'"), t.replace("'", "\\'").replace("\n", " ")) for i, (n, t) in enumerate(templates))
    fixed = spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, license, text)")
    counted = lambda df, key, text: df.select(*key, F.explode(_terms(F.col(text))).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    # nearly all segments hold some terms, so terms are dealt by salts of their segments, and only salts that a term has get its weight
    own = saved(counted(distinct, ["h", "i"], "segment").withColumn("salt", _salt("h", "i")), "counts")
    known = counted(fixed, ["template", "license"], "text")
    n = distinct.agg(F.count("*").alias("n")).select((F.col("n") + len(templates)).alias("n"))
    df = own.select("term").union(known.select("term")).groupBy("term").agg(F.count("*").alias("df"))
    # one row, a count
    idf = df.join(F.broadcast(n)).select("term", (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))
    weigh = lambda x: x.withColumn("w", F.col("tf") * F.col("idf"))
    dealt = own.select("term", "salt").distinct().join(idf, "term")
    own, known = saved(weigh(own.join(dealt, ["term", "salt"])).drop("salt"), "terms"), weigh(known.join(idf, "term"))
    norm = own.groupBy("h", "i").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    size = known.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    # templates are a fixed list; a template is one row of its terms, so a segment's term gives one row
    terms = known.join(size, "template").groupBy("term").agg(F.collect_list(F.struct("template", "license", (F.col("w") / F.col("size")).alias("v"))).alias("in"))
    dots = own.join(F.broadcast(terms), "term").select("h", "i", "w", F.explode("in").alias("k")).groupBy("h", "i", "k.template", "k.license").agg(F.sum(F.col("w") * F.col("k.v")).alias("dot"))
    scores = dots.join(norm, ["h", "i"]).select("h", "i", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= cosine)
    scores = scores.groupBy("h", "i", "license").agg(F.max("score").alias("score"))
    words = distinct.select("h", "i", F.array_join(_terms(F.col("segment")), " ").alias("words"))
    scores = scores.join(words, ["h", "i"]).where(_marked(F.col("words"), F.col("license")))
    return scores.groupBy("h", "i").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select("h", "i", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def _salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def apply(files: DataFrame, id: str = "id", path: str = "path", text: str = "text", templates=TEMPLATES, cosine: float = COSINE) -> DataFrame:
    """(id, path, own_license, score, inherited_license, inherited_from, license) of every row."""
    source = files.select(F.col(f"`{id}`").alias("id"), F.col(f"`{path}`").cast("string").alias("path"), F.col(f"`{text}`").alias("text"))
    found = segments(source).select("id", "path", "segment", F.xxhash64("segment").alias("h"), F.xxhash64(F.lit(1), "segment").alias("i"), _salt("id", "path").alias("salt"))
    found = saved(found, "segments")
    best = saved(matched(found.select("h", "i", "segment").distinct(), templates, cosine), "matched")
    # of a hot segment only the salts that it has are joined to its match
    dealt = found.select("h", "i", "salt").distinct().join(best, ["h", "i"])
    per_file = found.select("id", "path", "h", "i", "salt").join(dealt, ["h", "i", "salt"]).groupBy("id", "path").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    per_file = per_file.select(F.col("id").alias("f_id"), F.col("path").alias("f_path"), F.col("b.license").alias("own_license"), (-F.col("b.s")).alias("score"))
    name = F.regexp_extract(F.coalesce("f_path", F.lit("")), r"(?s)([^/]*)$", 1)
    own_dirs = per_file.where(name.rlike(LICENCE_FILE)).select(directory(F.col("f_path")).alias("dir"), F.struct((-F.col("score")).alias("s"), F.col("f_path").alias("p"), F.col("own_license").alias("l")).alias("b"))
    own_dirs = own_dirs.where("dir is not null").groupBy("dir").agg(F.min("b").alias("b")).select("dir", F.col("b.l").alias("dir_license"))
    dirs = source.select(directory(F.col("path")).alias("start")).where("start is not null").distinct()
    parts = F.split("start", "/", -1)
    up = dirs.select("start", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("dir"))
    near = up.join(own_dirs, "dir").groupBy("start").agg(F.max_by(F.struct("dir", "dir_license"), F.length("dir")).alias("d"))
    near = near.select("start", F.col("d.dir").alias("inherited_from"), F.col("d.dir_license").alias("inherited_license"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = source.select("id", "path", directory(F.col("path")).alias("start"), _salt("id", "path").alias("salt"))
    joined = rows.join(per_file, rows["id"].eqNullSafe(per_file["f_id"]) & rows["path"].eqNullSafe(per_file["f_path"]), "left").join(near, ["start", "salt"], "left")
    lacks = F.col("own_license").isNull()
    return joined.select(
        F.col("id").alias(id), F.col("path").alias(path), "own_license", "score", F.when(lacks, F.col("inherited_license")).alias("inherited_license"),
        F.when(lacks, F.col("inherited_from")).alias("inherited_from"), F.coalesce("own_license", "inherited_license").alias("license"))
