"""The keyword index finds what a scan finds, and is kept up to date by type."""

from pyspark.sql import functions as F

from quillgraph.operators import keyword_index, lookup
from quillgraph.sources.parted import PartedGraph


def test_index_equals_scan(spark, tmp_path):
    rows = [("p.A#f()", "f", "A", "void f() { Größe = İx; aaa(); }"), ("p.A#g()", "g", "A", None), ("p.B#h()", "h", "B", "😀😀😀 ab\n\tc"), ("p.B#aab()", "aab", "B", ""), ("q.C#x", None, None, "AAA a b c ab ba aab")]
    table = lambda r: spark.createDataFrame(r, "chunk_id string, method_name string, class_name string, code string")
    g = PartedGraph(spark, f"file://{tmp_path}/graph", 16)
    keyword_index.put(g, table(rows))
    found = lambda df: sorted(r.chunk_id for r in df.collect())
    words = ["", "a", "ab", "aab", "AAA", "größe", "😀😀😀", "p.B", "b\n\tc", "b#", "#f(", "void f()", "aaaa", "x; a"]
    for w in words:
        assert found(keyword_index.search(g, table(rows), w)) == found(lookup.search(table(rows), w)), w
    # a type changes: one of its chunks goes, one comes; another type goes
    now = [*rows[:2], ("p.B#new()", "new", "B", "fresh"), rows[4]]
    before = g.manifest()["tables"]["grams"]
    written = keyword_index.put(g, table([now[2]]))
    assert {p for p, v in g.manifest()["tables"]["grams"].items() if before.get(p) != v} == {str(p) for p in written["grams"]} and len(written["grams"]) == 1
    keyword_index.put(g, table([]), spark.createDataFrame([("q.C",)], "fq string"))
    now.pop()
    for w in words + ["fresh", "new"]:
        assert found(keyword_index.search(g, table(now), w)) == found(lookup.search(table(now), w)), w
    assert g.stored("grams").where("chunk_id like 'q.C%' or chunk_id like '%aab%'").count() == 0
    plan = keyword_index.search(g, table(now), "fresh")._jdf.queryExecution().toString()
    assert "In(gram" in plan
    assert keyword_index.grams(table(rows)).where(F.length("gram") != 3).count() == 0


def test_texts_are_dealt(spark, tmp_path, monkeypatch):
    """Types of more than one task: every row is found as by a scan, repeated ids once for each row, and no gram is shuffled."""
    monkeypatch.setattr(keyword_index, "TASK_CHARS", 300)
    rows = [(f"p.T{i % 3}#m{i}", f"m{i}", None if i % 7 == 0 else f"T{i % 3}", f"void m{i}() {{ call{i * i}(); }}") for i in range(60)] + [("p.T1#m1", "m1", "T1", "again")]
    table = spark.createDataFrame(rows, "chunk_id string, method_name string, class_name string, code string")
    g = PartedGraph(spark, f"file://{tmp_path}/graph", 4)
    keyword_index.put(g, table.where("chunk_id like 'p.T0%'"))
    keyword_index.put(g, table)
    found = lambda df: sorted(map(str, df.collect()))
    for w in ("call1", "void", "M1(", "again", "p.t2#", "none such"):
        assert found(keyword_index.search(g, table, w)) == found(lookup.search(table, w)), w
    assert len(g.stored("grams").inputFiles()) > 4
    plan = keyword_index.grams(keyword_index._dealt(g, table))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_grams_come_sorted(spark, tmp_path):
    """grams are cut and sorted as numbers in a task's memory, so Spark doesn't sort them by gram; they are those of the texts."""
    rows = [(f"p.T#m{i}", f"M{i}", None, ("😀Ab\0cé" * (i % 3)) + f"X{i}") for i in range(50)] + [("p.T#m1", "again", "T", "ab")]
    table = spark.createDataFrame(rows, "chunk_id string, method_name string, class_name string, code string").coalesce(1)
    made = [tuple(r) for r in keyword_index.grams(table).collect()]
    want = [(g, r[0]) for r in rows for g in {t.lower()[i : i + 3] for t in r if t for i in range(len(t) - 2)}]
    assert sorted(made) == sorted(want) and [g for g, _ in made] == sorted(g for g, _ in made)
    g = PartedGraph(spark, f"file://{tmp_path}/graph", 1)
    keyword_index.put(g, table)
    keyword_index.put(g, table.where("code like '%X%'"))
    stored = [r.gram for r in g.stored("grams").collect()]
    assert "Sort" not in keyword_index.grams(table)._jdf.queryExecution().executedPlan().toString() and stored == sorted(stored) and len(stored) > 400
