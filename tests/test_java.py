"""The scanner on small sources, and the tables that come from them."""

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import boilerplate
from quillgraph.sources import java
from quillgraph.sources.java import ScanError, Scanner, Tables, methods_of, pack_lines, pack_statements, scan_source

SERVICE = '''
package a.b;

import java.util.List;
import a.c.Repo;

@Service
public class Svc<T extends Comparable<T>> extends Base implements Runnable, java.io.Closeable {
    private final Repo repo, spare = new Repo();
    static { init(); }
    public Svc(Repo repo) throws IOException { this.repo = repo; repo.open(); }
    @Override public void run() { String t = """
        } not code {
        """; repo.save(t, "}"); this.close(); helper.other().go(1, 2); }
    public List<Map<String, T>> find(final int a, String... names) { if (a > 0) { return null; } else { for (;;) { break; } } /* } */ return repo.all(a); }
    public void close() {}
    interface Inner { default int n() { return 1; } void abs(); }
    enum Kind { A, B { void x() {} }; void y() {} }
    record Pair(int a, int b) { Pair { check(); } }
}
'''
REPO = """
package a.c;
public class Repo {
    private int id;
    public int getId() { return id; }
    public void setId(int id) { this.id = id; }
    public void save(String a, String b) { store(a); }
    void store(String a) {}
    public void open() {}
}
"""
DTO = "package a.c;\n@Data\npublic class Dto { private String s; private int k; }"
TEST = "package a.c; class RepoTest { Repo repo; void check() { repo.save(null, null); } }"


def test_members():
    got = scan_source(SERVICE, 512)
    svc, inner = got["types"]
    assert got["package_name"] == "a.b" and got["imports"] == ["import java.util.List;", "import a.c.Repo;"]
    assert svc["signature"] == "public class Svc extends Base implements Runnable, java.io.Closeable"
    assert [(f["name"], f["type"]) for f in svc["fields"]] == [("repo", "Repo"), ("spare", "Repo")]
    methods = {m["name"]: m for m in svc["methods"]}
    assert list(methods) == ["<init>", "run", "find", "close"]
    assert methods["find"]["return_type"] == "List<Map<String, T>>" and methods["find"]["param_types"] == ["int", "String"] and methods["find"]["n_statements"] == 2
    assert [(c["scope"], c["name"], c["args"]) for c in methods["run"]["calls"]] == [("repo", "save", 2), ("this", "close", 0), ("helper", "other", 0), ("helper.other()", "go", 2)]
    assert methods["<init>"]["throws"] == ["IOException"]
    assert (inner["name"], inner["outer"], inner["kind"]) == ("Inner", "Svc", "interface") and [m["name"] for m in inner["methods"]] == ["n", "abs"]


@pytest.mark.parametrize("bad", ["class A { void f( {} }", "class A {", "int x", 'class A { String s = "open; }'])
def test_errors(bad):
    with pytest.raises((ScanError, IndexError, KeyError)):
        Scanner(bad).scan()


def test_packing():
    assert pack_lines("a\nb\nc\n\n", 2) == ["a\nb\n", "c\n"]
    assert pack_lines("a b c\nd", 2) == ["a b c\n", "d\n"]
    assert pack_statements("h {", ["a;", "b;", "c;"], "", 4) == ["h {\na;\nb;\n\n}", "h {\nc;\n\n}"]
    assert pack_statements("h {", ["a b\nc d"], "", 2) == ["h {\na b\n\n}", "h {\nc d\n\n}"]


def test_bare_methods():
    assert [(m["class_name"], m["method_name"], m["visibility"]) for m in methods_of("@Override public int f(int a) { return g(a); } void h() {}")] == [("", "f", "public"), ("", "h", "package-private")]


@pytest.fixture(scope="module")
def tables(spark):
    files = [("a/b/Svc.java", SERVICE), ("a/c/Repo.java", REPO), ("a/c/Dto.java", DTO), ("a/c/RepoTest.java", TEST), ("bad.java", "class {")]
    return Tables(java.scan(spark.createDataFrame(files, "file_path string, source string")))


def test_tables(tables):
    assert [r.file_path for r in tables.errors.collect()] == ["bad.java"]
    chunks = {r.chunk_id: r for r in tables.chunks.collect()}
    save = chunks["a.c.Repo#save(String, String)"]
    assert save.called_by == ["a.b.Svc#run()", "a.c.RepoTest#check()"] and save.calls == ["a.c.Repo#store(String)"]
    assert {k for k, r in chunks.items() if r.is_boilerplate} == {"a.c.Repo#getId()", "a.c.Repo#setId(int)", "a.b.Inner#n()"} - {"a.b.Inner#n()"}
    assert "helper.other().go(..., ...)" in chunks["a.b.Svc#run()"].calls
    dto = boilerplate.dto_classes(tables.classes.sparkSession.createDataFrame([("x", ["Data"], 0), ("y", [], 0), ("z", [], 1)], "class_key string, annotation_names array<string>, n_fields int"), tables.classes.sparkSession.createDataFrame([], "class_key string, name string, n_statements int, first_kind string"))
    assert {r.class_key: r.is_dto for r in dto.collect()} == {"x": True, "y": False, "z": True}


def test_graph(tables):
    edges, stubs = tables.graph()
    found = {(r.edge_type, r.src, r.dst) for r in edges.collect()}
    assert ("CALLS", "a.b.Svc#run()", "a.c.Repo#save(String, String)") in found
    assert ("CALLED_BY", "a.c.Repo#save(String, String)", "a.b.Svc#run()") in found
    assert ("INNER_CLASS_OF", "a.b.Inner", "a.b.Svc") in found and ("HAS_FIELD", "a.c.Dto", "a.c.Dto.s") in found
    assert ("TEST_FOR", "a.c.RepoTest#check()", "a.c.Repo#save(String, String)") in found
    assert ("IMPORTS", "a.b.Svc", "a.c.Repo") in found and not any(d == "java.util.List" for t, _, d in found if t == "IMPORTS")
    assert {r.fq_name for r in stubs.where(F.col("is_interface")).collect()} == {"Runnable", "java.io.Closeable"}


def test_parsed_blocks(spark):
    blocks = spark.createDataFrame([(0, "void f() { a.b(); }"), (1, "broken {")], "block int, code string")
    rows = java.parsed_methods(blocks).collect()
    assert [(r.block, r.method_name, r.calls, r.parse_error) for r in rows] == [(0, "f", ["a.b"], False), (1, None, None, True)]
