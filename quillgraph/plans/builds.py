"""Queries over generated sources: the index build with all kinds of declarations and calls, and round trips through sources and sinks.

Each nation is a package of four files; what the build must find in them is written down in SQL for one package, {p}.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import boilerplate, evaluate
from ..sources import evaluation, java, store
from ..sources.tables import shared_path
from .demo import table
from .registry import query

FILES = {
    "b/Base.java": """package {p}.b;
public abstract class Base<T> {
  protected int seen;
  protected Helper make(int n) { seen = n; log("made"); return new Helper(n); }
  void log(String s) { System.out.println(s); }
  static int twice(int x) { int y = x + x; return y; }
}
""",
    "b/Helper.java": """package {p}.b;
public class Helper {
  int n;
  public Helper(int n) { this.n = n; }
  public Helper next(int k) { n += k; return this; }
  int big(int k) {
    int a = k + 1; int b = a + 2; int c = b + 3; int d = c + 4;
    int e = d + 5; int f = e + 6; int g = f + 7; int h = g + 8;
    if (h > 3) { next(h); }
    return a + b + c + d + e + f + g + h;
  }
  public boolean done(String why) { System.out.println(why); return n > 3; }
}
enum Kind { A, B }
record Pair(int a, int b) { int sum() { return a + b; } }
""",
    "c/Child.java": """package {p}.c;
import {p}.b.Base;
import {p}.b.Helper;
import static java.util.Map.entry;
/** Child */
@Deprecated
public class Child extends Base<String> implements Runnable, java.io.Serializable {
  private final Helper helper;
  String name = "x";
  public Child(Helper helper, String name) throws java.io.IOException { this.helper = helper; this.name = name; log(name); }
  @Override public void run() { make(3).next(1).done("x"); helper.next(2); super.log("s"); this.go(1); go("a"); go(2L); Base.twice(4); }
  void go(int k) { if (k > 0) { log("int"); } }
  void go(String k) { log(k); }
  void go(long k) { log("long"); run(); }
  public String getName() { return name; }
  class Inner { int z; void touch() { go(5); } }
  interface Shape { double area(); default double half() { double h = area() / 2; return h; } }
}
""",
    "c/ChildTest.java": """package {p}.c;
import {p}.b.Helper;
public class ChildTest {
  void testRun() { Child c = new Child(new Helper(1), "n"); c.run(); c.go(7); }
  void testNone() { int a = 1; }
}
""",
    "c/Broken.java": "package {p}.c; class Broken {",
}
BUDGET = 60


def sources(spark, sf_dir) -> DataFrame:
    """(file_path, source) of the packages."""
    files = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(text).alias("text")) for name, text in FILES.items()))
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("p"), F.explode(files).alias("f"))
    return rows.select(F.concat("p", F.lit("/"), "f.name").alias("file_path"), F.replace("f.text", F.lit("{p}"), F.col("p")).alias("source"))


#: m: a method, its return type, the types of its parameters, what it throws, whether it is boilerplate; c: calls between methods;
#: t: types, their kind, and the type around them. Base of all: what the files say.
_FOUND = """
WITH n AS (SELECT 'n' || n_nationkey AS p FROM nation),
m(id, cls, returned, uses, thrown, plain) AS (VALUES
  ('b.Base#make(int)', 'b.Base', '{p}.b.Helper', ['int'], NULL, false), ('b.Base#log(String)', 'b.Base', 'void', ['String'], NULL, false), ('b.Base#twice(int)', 'b.Base', 'int', ['int'], NULL, false),
  ('b.Helper#<init>(int)', 'b.Helper', NULL, ['int'], NULL, false), ('b.Helper#next(int)', 'b.Helper', '{p}.b.Helper', ['int'], NULL, false), ('b.Helper#big(int)', 'b.Helper', 'int', ['int'], NULL, false),
  ('b.Helper#done(String)', 'b.Helper', 'boolean', ['String'], NULL, false), ('c.Child#<init>(Helper, String)', 'c.Child', NULL, ['{p}.b.Helper', 'String'], 'java.io.IOException', false), ('c.Child#run()', 'c.Child', 'void', [], NULL, false),
  ('c.Child#go(int)', 'c.Child', 'void', ['int'], NULL, false), ('c.Child#go(String)', 'c.Child', 'void', ['String'], NULL, false), ('c.Child#go(long)', 'c.Child', 'void', ['long'], NULL, false),
  ('c.Child#getName()', 'c.Child', 'String', [], NULL, true), ('c.Inner#touch()', 'c.Inner', 'void', [], NULL, false), ('c.Shape#area()', 'c.Shape', 'double', [], NULL, false), ('c.Shape#half()', 'c.Shape', 'double', [], NULL, false),
  ('c.ChildTest#testRun()', 'c.ChildTest', 'void', [], NULL, false), ('c.ChildTest#testNone()', 'c.ChildTest', 'void', [], NULL, false)),
c(src, dst) AS (VALUES
  ('b.Base#make(int)', 'b.Base#log(String)'), ('b.Helper#big(int)', 'b.Helper#next(int)'), ('c.Child#<init>(Helper, String)', 'b.Base#log(String)'), ('c.Child#run()', 'b.Base#make(int)'), ('c.Child#run()', 'b.Helper#next(int)'),
  ('c.Child#run()', 'b.Helper#done(String)'), ('c.Child#run()', 'b.Base#log(String)'), ('c.Child#run()', 'c.Child#go(int)'), ('c.Child#run()', 'c.Child#go(String)'), ('c.Child#run()', 'c.Child#go(long)'), ('c.Child#run()', 'b.Base#twice(int)'),
  ('c.Child#go(int)', 'b.Base#log(String)'), ('c.Child#go(String)', 'b.Base#log(String)'), ('c.Child#go(long)', 'b.Base#log(String)'), ('c.Child#go(long)', 'c.Child#run()'), ('c.Inner#touch()', 'c.Child#go(int)'),
  ('c.Shape#half()', 'c.Shape#area()'), ('c.ChildTest#testRun()', 'c.Child#run()'), ('c.ChildTest#testRun()', 'c.Child#go(int)')),
t(name, outside, signature, interface) AS (VALUES ('b.Base', NULL, 'public abstract class Base', false), ('b.Helper', NULL, 'public class Helper', false), ('c.ChildTest', NULL, 'public class ChildTest', false),
  ('c.Child', NULL, 'public class Child extends Base<String> implements Runnable, java.io.Serializable', false), ('c.Inner', 'c.Child', 'class Inner', false), ('c.Shape', 'c.Child', 'interface Shape', true)),
own AS (SELECT edge_type, '{p}.' || src AS src, dst FROM (
  SELECT 'CALLS' AS edge_type, src, '{p}.' || dst AS dst FROM c UNION ALL SELECT 'CALLED_BY', dst, '{p}.' || src FROM c UNION ALL SELECT 'TEST_FOR', src, '{p}.' || dst FROM c WHERE contains(src, 'Test#')
  UNION ALL SELECT 'BELONGS_TO', id, '{p}.' || cls FROM m WHERE NOT plain UNION ALL SELECT 'RETURNS_TYPE', id, returned FROM m WHERE NOT plain AND returned IS NOT NULL UNION ALL SELECT 'USES_TYPE', id, unnest(uses) FROM m
  UNION ALL SELECT 'THROWS', id, thrown FROM m WHERE thrown IS NOT NULL UNION ALL SELECT 'CONTAINS', name[1], '{p}.' || name FROM t UNION ALL SELECT 'INNER_CLASS_OF', name, '{p}.' || outside FROM t WHERE outside IS NOT NULL
  UNION ALL FROM (VALUES ('EXTENDS', 'c.Child', '{p}.b.Base'), ('IMPLEMENTS', 'c.Child', 'Runnable'), ('IMPLEMENTS', 'c.Child', 'java.io.Serializable'), ('IMPORTS', 'c.Child', '{p}.b.Base'), ('IMPORTS', 'c.Child', '{p}.b.Helper'),
    ('IMPORTS', 'c.Inner', '{p}.b.Base'), ('IMPORTS', 'c.Inner', '{p}.b.Helper'), ('IMPORTS', 'c.ChildTest', '{p}.b.Helper'), ('HAS_FIELD', 'b.Base', '{p}.b.Base.seen'), ('HAS_FIELD', 'b.Helper', '{p}.b.Helper.n'),
    ('HAS_FIELD', 'c.Child', '{p}.c.Child.helper'), ('HAS_FIELD', 'c.Child', '{p}.c.Child.name'), ('HAS_FIELD', 'c.Inner', '{p}.c.Inner.z')))),
edges AS (SELECT edge_type, replace(src, '{p}', p) AS src, replace(dst, '{p}', p) AS dst FROM own, n)
"""


def _built(spark, sf_dir) -> java.Tables:
    return java.Tables(java.scan(sources(spark, sf_dir), BUDGET))


@query(_FOUND + "FROM edges")
def p6_p16_k5_j5_j13_edges(spark, sf_dir):
    """Every admitted edge, with inner types, overloads, inheritance, chains, tests, constructors and imports."""
    return _built(spark, sf_dir).graph()[0].select("edge_type", "src", "dst")


#: A tower of types, a cycle of two, and a chain of calls, each of DEEP steps.
DEEP = 20
_TOWER = ["class D0 { void root() { int a = 1; a++; } }", *(f"class D{i} extends D{i - 1} {{ }}" for i in range(1, DEEP + 1)), f"class Use extends D{DEEP} {{ void go() {{ root(); int x = 1; x++; }} }}"]
_CYCLE = ["class X extends Y { void own() { int a = 1; lost(); } }", "class Y extends X { void lost() { int b = 2; b++; } }"]
_LINKS = [f"class L{i} {{ L{i + 1} n{i + 1}() {{ int a = {i}; a++; return new L{i + 1}(); }} }}" for i in range(DEEP)] + [
    f"class L{DEEP} {{ void end() {{ int a = 0; a++; }} }}", f"class Chain {{ void run() {{ new L0(){''.join(f'.n{i}()' for i in range(1, DEEP + 1))}.end(); int a = 0; a++; }} }}",
]


@query(
    f"""WITH n AS (SELECT 'n' || n_nationkey || '.deep.' AS p FROM nation), d(src, dst) AS (VALUES ('Use#go()', 'D0#root()'), ('X#own()', 'Y#lost()'), ('Chain#run()', 'L{DEEP}#end()'))
SELECT p || src AS src, p || dst AS dst FROM d, n UNION ALL SELECT p || 'Chain#run()', p || 'L' || i || '#n' || (i + 1) || '()' FROM n, range(0, {DEEP}) t(i)"""
)
def p11_p15_deep_calls(spark, sf_dir):
    """Calls of a method DEEP types up, over a cycle of types, and through a chain of DEEP + 1 calls."""
    text = "package {p}.deep;\n" + "\n".join([*_TOWER, *_CYCLE, *_LINKS]) + "\n"
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("p")).select(F.concat("p", F.lit("/Deep.java")).alias("file_path"), F.replace(F.lit(text), F.lit("{p}"), F.col("p")).alias("source"))
    return java.Tables(java.scan(rows)).calls.where("resolved").select("src", "dst")


@query(
    _FOUND + "SELECT p || '.' || id || CASE WHEN part > 0 THEN '#part' || part ELSE '' END AS chunk_id, plain AS is_boilerplate, greatest(part, 1) AS part_index, CASE WHEN part > 0 THEN 2 ELSE 1 END AS total_parts, "
    "coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM edges WHERE edge_type = 'CALLS' AND src = p || '.' || id), CASE WHEN id IN ('b.Base#log(String)', 'b.Helper#done(String)') THEN 'System.out.println(...)' ELSE '' END) AS calls, "
    "coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM edges WHERE edge_type = 'CALLED_BY' AND src = p || '.' || id), '') AS called_by, signature AS class_signature "
    "FROM m JOIN t ON name = cls, n, (VALUES (0), (1), (2)) v(part) WHERE (part > 0) = (id = 'b.Helper#big(int)')"
)
def p2_p4_p5_p11_chunks(spark, sf_dir):
    return _built(spark, sf_dir).chunks.select("chunk_id", "is_boilerplate", "part_index", "total_parts", F.array_join("calls", ",").alias("calls"), F.array_join("called_by", ",").alias("called_by"), "class_signature")


@query(
    "SELECT 'n' || n_nationkey || '.b.Helper#big(int)#part' || part AS chunk_id, 'int big(int k) {' || chr(10) || replace(body, '|', chr(10)) || chr(10) || chr(10) || '}' AS code FROM nation, "
    "(VALUES (1, 'int a = k + 1;|int b = a + 2;|int c = b + 3;|int d = c + 4;|int e = d + 5;|int f = e + 6;|int g = f + 7;|int h = g + 8;'), (2, 'if (h > 3) { next(h); }|return a + b + c + d + e + f + g + h;')) v(part, body)"
)
def f3_statement_parts(spark, sf_dir):
    return _built(spark, sf_dir).chunks.where("total_parts > 1").select("chunk_id", "code")


@query(
    _FOUND + "SELECT p || '.' || name AS fq_name, signature, interface AS is_interface, CASE WHEN name = 'c.Child' THEN p || '.b.Base' ELSE '' END AS extended, CASE WHEN name = 'c.Child' THEN 'Runnable,java.io.Serializable' ELSE '' END AS implemented, "
    "CASE WHEN name = 'c.Child' THEN '@Deprecated' ELSE '' END AS annotations FROM t, n"
)
def p1_p2_p15_classes(spark, sf_dir):
    c = _built(spark, sf_dir).classes
    return c.select("fq_name", "signature", "is_interface", F.array_join("extended_types", ",").alias("extended"), F.array_join("implemented_types", ",").alias("implemented"), F.array_join("annotations", ",").alias("annotations"))


@query("SELECT x AS fq_name, regexp_extract(x, '[^.]+$') AS simple_name, x IN ('Runnable', 'java.io.Serializable') AS is_interface FROM (SELECT unnest(['Runnable', 'java.io.Serializable', 'java.io.IOException', 'String', 'boolean', 'double', 'int', 'long', 'void']) AS x)")
def j8_j11_stubs(spark, sf_dir):
    return _built(spark, sf_dir).graph()[1]


@query(
    _FOUND + "SELECT p || '.b.Helper' AS fq_name, 'n' AS fields, '<init>,big,done,next' AS methods, '' AS imports FROM n UNION ALL SELECT p || '.c.Child', 'helper,name', '<init>,go,go,go,run', 'import ' || p || '.b.Base;,import ' || p || '.b.Helper;,import static java.util.Map.entry;' FROM n"
)
def j19_o9_class_overview(spark, sf_dir):
    """Fields and methods of two classes of each package; a split method counts once."""
    from ..operators.lookup import class_overviews

    t = _built(spark, sf_dir)
    p = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("p"))
    wanted = p.select(F.explode(F.array(F.concat("p", F.lit(".b.Helper")), F.concat("p", F.lit(".c.Child")), F.concat("p", F.lit(".no.Such")))).alias("fq_name"))
    return class_overviews(t.classes, t.fields, boilerplate.drop(t.chunks), wanted).select(
        "fq_name", F.array_join(F.transform("fields", lambda f: f["name"]), ",").alias("fields"), F.array_join(F.array_sort(F.transform("methods", lambda m: m["method_name"])), ",").alias("methods"), F.array_join("imports", ",").alias("imports"))


# Round trips: what is written is read again


def _fresh(spark, name: str) -> str:
    return shared_path(spark, name)


@query("SELECT 'n' || n_nationkey || '/' || f AS file_path, f = 'c/Broken.java' AS broken FROM nation, (VALUES ('b/Base.java'), ('b/Helper.java'), ('c/Child.java'), ('c/ChildTest.java'), ('c/Broken.java')) v(f)")
def s1_s2_s4_scan_folder(spark, sf_dir):
    """The files of a folder tree; roots that don't exist or hold nothing give way to the fallback; a broken file is a row with an error."""
    root = _fresh(spark, "tree")
    _write_texts(spark, sources(spark, sf_dir).withColumn("file_path", F.concat(F.lit(root + "/"), "file_path")), "source")
    found = java.read_roots(spark, [f"{root}/none"], root)
    return java.scan(found, BUDGET).select("file_path", F.col("error").isNotNull().alias("broken"))


@query("SELECT 'n' || n_nationkey || '/b/Base.java' AS file_path FROM nation")
def s3_listed_files(spark, sf_dir):
    root = _fresh(spark, "listed")
    named = sources(spark, sf_dir).where(F.endswith("file_path", F.lit("Base.java")))
    _write_texts(spark, named.withColumn("file_path", F.concat(F.lit(root + "/"), "file_path")), "source")
    names = [f"{root}/{r[0]}" for r in named.select("file_path").collect()]
    found = java.read_listed(spark, [*names, f"{root}/notes.txt"])
    return found.select(F.regexp_extract("file_path", r"(n\d+/b/Base\.java)$", 1).alias("file_path"))


def _write_texts(spark, rows: DataFrame, column: str) -> None:
    """Writes each row as a file of its own, where the row is; the rows name the files."""
    store.write_each(rows, "file_path", column)


_FIXTURE = "SELECT s_name AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'retrieval' ELSE 'safeloop' END AS mode, (s_suppkey % 5)::INT AS relevant, CASE WHEN s_suppkey % 3 = 0 THEN 'a,b' ELSE '' END AS tags FROM supplier"


def _fixture_files(spark, sf_dir, folder: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    relevant = F.transform(F.sequence(F.lit(0), F.pmod(k, F.lit(5)).cast("int")), lambda x: F.concat(F.lit("r"), x))
    body = F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.col("s_name").alias("id"), F.when(k % 2 == 0, "retrieval").otherwise("safeloop").alias("mode"), F.lit("q").alias("query"), F.struct(F.slice(relevant, F.lit(1), (k % 5).cast("int")).alias("relevant")).alias("gold"), F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("tags")))
    return s.select(F.concat(F.lit(folder + "/"), "s_name", F.lit(".json")).alias("file_path"), body.alias("body"))


def _shown_fixtures(df: DataFrame) -> DataFrame:
    return df.select("id", "mode", F.size("gold.relevant").alias("relevant"), F.array_join("tags", ",").alias("tags"))


@query(_FIXTURE)
def s5_o4_fixture_folder(spark, sf_dir):
    folder = _fresh(spark, "fixtures")
    _write_texts(spark, _fixture_files(spark, sf_dir, folder), "body")
    return _shown_fixtures(evaluation.fixtures(spark, folder))


@query(f"SELECT * FROM ({_FIXTURE}) ORDER BY id LIMIT 7")
def o4_first_fixtures(spark, sf_dir):
    """The first seven by file name."""
    folder = _fresh(spark, "fixtures")
    _write_texts(spark, _fixture_files(spark, sf_dir, folder), "body")
    return _shown_fixtures(evaluate.first_fixtures(evaluation.fixtures(spark, folder), 7))


@query(f"SELECT * FROM ({_FIXTURE}) ORDER BY id LIMIT 5")
def s6_listed_fixtures(spark, sf_dir):
    folder = _fresh(spark, "index")
    files = _fixture_files(spark, sf_dir, folder)
    _write_texts(spark, files, "body")
    names = [r["file_path"].rsplit("/", 1)[1] for r in files.select("file_path").orderBy("file_path").limit(5).collect()]
    index = spark.createDataFrame([(f"{folder}/index.txt", "# fixtures\n\n" + "\n".join(names) + "\n")], "file_path string, body string")
    _write_texts(spark, index, "body")
    return _shown_fixtures(evaluation.listed_fixtures(spark, f"{folder}/index.txt"))


@query("SELECT user_id::VARCHAR AS fixture_id, event_type AS name, arg_max(value, event_id) AS value, 'PASS' AS status FROM (SELECT * FROM events QUALIFY event_id = max(event_id) OVER (PARTITION BY user_id)) GROUP BY ALL")
def s7_k11_run_log(spark, sf_dir):
    """A run log is written and read; of runs with one id the last counts."""
    path, e = _fresh(spark, "runs"), table(spark, sf_dir, "events")
    metrics = F.array(F.struct(F.col("event_type").alias("name"), "value", F.lit("PASS").alias("status")))
    rows = e.select(F.col("user_id").cast("string").alias("fixtureId"), F.lit("retrieval").alias("mode"), metrics.alias("metrics"), "event_id")
    store.write_runs(rows, path, F.col("event_id"))
    return evaluation.metrics(evaluation.runs(spark, path)).select("fixture_id", "name", "value", "status")


@query(_FOUND + "SELECT p || '.' || id AS chunk_id, length(id) > 0 AS whole FROM m, n WHERE id <> 'b.Helper#big(int)' UNION ALL SELECT p || '.b.Helper#big(int)#part' || part, true FROM n, (VALUES (1), (2)) v(part)")
def k1_chunk_export(spark, sf_dir):
    path, chunks = _fresh(spark, "chunks"), _built(spark, sf_dir).chunks
    store.write_chunks(chunks, path)
    back = spark.read.schema(chunks.schema).json(path)
    same = back.select(*(F.col(c).alias(f"b_{c}") for c in back.columns)).join(chunks, F.col("b_chunk_id") == F.col("chunk_id"))
    return same.select("chunk_id", (F.coalesce("b_code", F.lit("")) == F.col("code")).alias("whole"))


@query(
    _FOUND + "SELECT edge_type AS kind, count(*) AS n FROM edges GROUP BY ALL UNION ALL SELECT 'chunks', 18 * count(*) FROM n UNION ALL SELECT 'embeddings', 18 * count(*) FROM n UNION ALL SELECT 'packages', 2 * count(*) FROM n "
    "UNION ALL SELECT 'fields', 5 * count(*) FROM n UNION ALL SELECT 'classes', 6 * count(*) + 9 FROM n UNION ALL SELECT 'violations', 0"
)
def k4_k9_store(spark, sf_dir):
    """The graph is written twice (batches merge by key), embeddings too; then counts of all tables and of keys that occur twice."""
    from ..streaming.reindex import reindex

    g, files = store.GraphStore(spark, _fresh(spark, "graph")), sources(spark, sf_dir)
    for part in (files, files.where(F.endswith("file_path", F.lit("Helper.java")))):
        reindex(g, part, budget=BUDGET, embedder=_LengthEmbedder)
    counts = [g.read(n).agg(F.lit(n).alias("kind"), F.count("*").alias("n")) for n in ("chunks", "embeddings", "packages", "fields", "classes")]
    counts.append(g.read("edges").groupBy(F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")))
    twice = [g.violations(n).select(F.lit(1).alias("x")) for n in ("chunks", "embeddings", "edges", "classes", "fields", "packages")]
    every = twice[0]
    for t in twice[1:]:
        every = every.union(t)
    counts.append(every.agg(F.lit("violations").alias("kind"), F.count("*").alias("n")))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(_FOUND + "FROM edges")
def i1_i2_k6_parted_batches(spark, sf_dir):
    """A tree with another Base (one method renamed, one with another type), another body of Helper, no Child and one file more is indexed;
    then one batch brings the files of P6-P16 and takes the other one away. The edges are those of a full build."""
    from ..sources.parted import PartedGraph
    from ..streaming.parted_reindex import update

    files = sources(spark, sf_dir)
    other = F.replace(F.replace(F.replace("source", F.lit("log("), F.lit("note(")), F.lit("static int twice"), F.lit("static long twice")), F.lit("n += k;"), F.lit("n -= k;"))
    changes = F.col("file_path").rlike("/b/")
    first = files.where("file_path not like '%Child.java'").withColumn("source", F.when(changes, other).otherwise(F.col("source")))
    more = files.where("file_path like '%Helper.java'").select(F.replace("file_path", F.lit("Helper"), F.lit("More")).alias("file_path"), F.replace("source", F.lit("Helper"), F.lit("More")).alias("source"))
    graph = PartedGraph(spark, _fresh(spark, "parted"), 8)
    update(graph, first.unionByName(more), budget=BUDGET)
    update(graph, files.where(changes | F.endswith("file_path", F.lit("Child.java"))), more.select("file_path"), budget=BUDGET)
    return graph.edges().select("edge_type", "src", "dst")


class _LengthEmbedder:
    def embed_batch(self, texts):
        return [[float(len(t)), 1.0] for t in texts]


@query(
    _FOUND + "SELECT 'package' AS kind, p || '.b' AS key, '{\"package\":\"' || p || '.b\",\"classes\":[{\"class\":\"' || p || '.b.Base\",\"methods\":[' || (SELECT string_agg('\"' || p || '.' || id || '\"', ',' ORDER BY id) FROM m WHERE cls = 'b.Base') || "
    "']},{\"class\":\"' || p || '.b.Helper\",\"methods\":[' || (SELECT string_agg('\"' || p || '.' || x || '\"', ',' ORDER BY x) FROM (SELECT id AS x FROM m WHERE cls = 'b.Helper' AND id NOT LIKE '%big%' UNION ALL FROM (VALUES ('b.Helper#big(int)#part1'), ('b.Helper#big(int)#part2')))) || ']}]}' AS json FROM n "
    "UNION ALL SELECT 'edge', edge_type || '|' || src || '|' || dst, '{\"edge_type\":\"' || edge_type || '\",\"src\":\"' || src || '\",\"dst\":\"' || dst || '\"}' FROM edges UNION ALL SELECT 'total', edge_type, '{\"edge_type\":\"' || edge_type || '\",\"count\":' || count(*) || '}' FROM edges GROUP BY edge_type"
)
def k2_graph_document(spark, sf_dir):
    t = _built(spark, sf_dir)
    out = store.graph_document(boilerplate.drop(t.chunks), t.graph()[0])
    return out.where("kind <> 'package' or key like '%.b'")


@query("SELECT event_type AS name, count(*) FILTER (value > 50) AS pass, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def k12_summary(spark, sf_dir):
    """The JSON report of a rollup, parsed again; its text form holds the same numbers."""
    e = table(spark, sf_dir, "events")
    roll = evaluate.rollup(e.select(F.col("event_type").alias("name"), "value", F.when(F.col("value") > 50, "PASS").otherwise("FAIL").alias("status")))
    modes = evaluate.runs_by_mode(e.select(F.col("event_type").alias("mode"), F.lit(None).cast("string").alias("error")))
    found, text = json.loads(store.summary_json(roll, modes)), store.summary_text(roll, modes)
    rows = [(n, m["pass"], round(m["meanValue"], 4)) for n, m in found["byMetric"].items() if f"{n}: pass {m['pass']}," in text]
    return spark.createDataFrame(rows, "name string, pass long, mean double")


@query("SELECT 'C' || label AS class_name, 'void m' || vec_id || '()' AS signature, 'C' || label || ' void m' || vec_id || '()' || chr(10) || 'void m' || vec_id || '()' AS text FROM embeddings")
def f19_embedding_text(spark, sf_dir):
    c = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("C"), "label").alias("class_name"), F.concat(F.lit("void m"), "vec_id", F.lit("()")).alias("signature"))
    return c.withColumn("text", T.embedding_text(F.col("class_name"), F.col("signature"), F.col("signature")))


@query("SELECT p_partkey AS id, ['public', 'protected', 'private', 'package-private', 'public', 'private', 'package-private'][p_partkey % 7 + 1] AS visibility, p_partkey % 4 < 3 AS override, ['work', NULL, 'go', 'x1'][p_partkey % 4 + 1] AS name, p_partkey % 5 IN (0, 1, 3) AS present FROM part")
def f10_f11_f20_f23_text(spark, sf_dir):
    """Visibility of signatures, override marks, the name of a method's code, and imports that are there."""
    k = F.col("p_partkey")
    of = lambda n, *values: F.element_at(F.array(*(F.lit(v) for v in values)), (k % n + 1).cast("int"))
    marks = F.element_at(F.array(F.array(F.lit("@Override")), F.array(F.lit("A"), F.lit("@override()")), F.array(F.lit(" Override ")), F.array(F.lit("@Overrides"))), (k % 4 + 1).cast("int"))
    code = of(4, "void work(int a) { if (a) { go(); } }", "if (x) { while (y) { } }", "return new X(go (1));", "x1()")
    imports = F.array(F.lit("import java.util.List;"), F.lit("import a.b.*;"), F.lit("import static c.D.e;"))
    asked = of(5, "java.util.List", "import a.b.C;", "java.util.Map", "static c.D.e", "c.D.e")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), T.visibility(of(7, "public int a()", "protected a()", "private static a()", "int a()", "static public a()", "final private a()", "publicly a()")).alias("visibility"), T.has_override(marks).alias("override"),
        T.method_name_of(F.replace(code, F.lit("new X("), F.lit("new ("))).alias("name"), T.import_present(asked, imports).alias("present"))


@query("SELECT conv_id, string_agg(n, ',' ORDER BY n) AS needs FROM (SELECT conv_id, n, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS r FROM (SELECT DISTINCT conv_id, unnest(['N' || (turn % 4), 'M' || (turn % 3)]) AS n FROM conversations)) WHERE r <= 4 GROUP BY conv_id")
def a13_distinct_needs(spark, sf_dir):
    from ..functions.verdicts import distinct_needs

    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.array(F.concat(F.lit("N"), F.col("turn") % 4), F.concat(F.lit("M"), F.col("turn") % 3))).alias("all"))
    return c.select("conv_id", F.array_join(distinct_needs(F.col("all"), 4), ",").alias("needs"))


@query("SELECT count(*) AS indexed, true AS finds FROM embeddings")
def k10_vector_index(spark, sf_dir):
    """Every vector is filed; 0.9 and more of the ten nearest of sampled vectors are found in the probed cells."""
    from ..operators.vector_index import VectorIndex
    from . import demo

    index = VectorIndex.build(demo.embeddings(spark, sf_dir), _fresh(spark, "index"), rows=100)
    asked = [list(r["embedding"]) for r in table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(10).collect()]
    return index.rows.agg(F.count("*").alias("indexed")).withColumn("finds", F.lit(index.recall(asked, 10) >= 0.9))


@query(
    """
WITH m AS (SELECT s_suppkey AS id, s_suppkey % 4 AS k FROM supplier)
SELECT id::VARCHAR || CASE WHEN k = 0 THEN ' a' ELSE ' b' END AS what, ['regressions', 'wins', 'verifierWired'][k + 1] AS list, true AS in_text FROM m WHERE k < 3
UNION ALL SELECT id || ': none -> x', 'anchorChanges', true FROM m WHERE k = 3 UNION ALL SELECT 'unchanged ' || count(*), 'counts', true FROM m WHERE k = 3
"""
)
def k13_diff_report(spark, sf_dir):
    """The report of a baseline diff as a table, and as text files that hold the same lines."""
    k = F.col("s_suppkey") % 4
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fixture_id"), F.when(k == 0, "a").otherwise("b").alias("name"), k.alias("k"))
    side = lambda before: s.select("fixture_id", "name", F.when((F.col("k") == 0) & F.lit(not before) | (F.col("k") == 1) & F.lit(before), "FAIL").when((F.col("k") == 2) & F.lit(before), "NOT_RUN").otherwise("PASS").alias("status"), F.lit(1.0).alias("value"))
    runs = lambda before: s.select("fixture_id", F.when((F.col("k") == 3) & F.lit(not before), "x").alias("anchor"))
    lines = evaluate.diff_lines(evaluate.baseline_diff(side(False), side(True)), runs(False), runs(True))
    path = _fresh(spark, "diff")
    store.write_diff(lines, path)
    told = spark.read.text(path).select(F.col("value").alias("text"), F.lit(True).alias("in_text")).distinct()
    # the first line holds all counts; heads of lists are lines of their own
    return lines.where("what <> ''").join(told, "text", "left").select("what", "list", F.coalesce("in_text", F.lit(False)).alias("in_text"))
