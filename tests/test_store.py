"""Sinks, edits, streams, loops and configuration."""

import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quillgraph.config import Config
from quillgraph.operators import evaluate
from quillgraph.plans import loops
from quillgraph.plans.tools import EditPlan, Tools
from quillgraph.sources import evaluation, java, store
from quillgraph.sources.store import GraphStore, PatchApplier
from quillgraph.streaming import reindex

A = "package p;\npublic class A {\n    B b;\n    public void f() { b.g(); }\n    public void h() { int a = 1; use(a); }\n    void use(int a) { a = 2; more(); }\n    void more() { use(1); }\n}\n"
B = "package p;\npublic class B {\n    public void g() { int x = 1; log(x); }\n    void log(int x) { x = 2; g(); }\n}\n"


def embedder():
    def make():
        class Lengths:
            def embed_batch(self, texts):
                return [[float(len(t)), 1.0] for t in texts]

        return Lengths()

    return make


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_reindex(spark, tmp_path):
    g = GraphStore(spark, f"file://{tmp_path}/graph")
    files = lambda *x: spark.createDataFrame(list(x), "file_path string, source string")
    reindex.reindex(g, files(("p/A.java", A), ("p/B.java", B), ("../x.java", A), ("n.txt", "")), "/repo", embedder=embedder())
    calls = rows(g.read("edges").where("edge_type = 'CALLS'"), "src", "dst")
    assert ("p.A#f()", "p.B#g()") in calls and ("p.B#g()", "p.B#log(int)") in calls
    assert g.read("embeddings").count() == g.read("chunks").count() == 6 and g.violations("chunks").count() == 0
    changed = B.replace("void log(int x) { x = 2; g(); }", "")
    reindex.reindex(g, files(("p/B.java", changed)), "/repo")
    after = rows(g.read("edges").where("edge_type = 'CALLS'"), "src", "dst")
    assert ("p.A#f()", "p.B#g()") in after and not any("log" in s or "log" in d for s, d in after)
    assert g.read("chunks").count() == 5
    back = rows(g.read("edges").where("edge_type = 'CALLED_BY'"), "src", "dst")
    assert back == {(d, s) for s, d in after} and g.read("chunks").where("chunk_id = 'p.B#g()'").first()["called_by"] == ["p.A#f()"]
    # the vector of the deleted method is gone, that of the other one, whose code is as before, is not
    assert rows(g.read("embeddings"), "chunk_id") == rows(g.read("chunks"), "chunk_id")
    reindex.reindex(g, files(("p/B.java", changed)), "/repo")
    assert rows(g.read("edges").where("edge_type = 'CALLS'"), "src", "dst") == after
    g.clean()
    assert not g.exists("chunks")


def test_store_commits_all_or_nothing(spark, tmp_path, monkeypatch):
    """A batch that dies between its steps leaves the graph whole; old versions stay for readers until vacuum."""
    g = GraphStore(spark, f"file://{tmp_path}/graph")
    df = lambda *x: spark.createDataFrame([(i,) for i in x], "name string")
    g.replace({"packages": df("a", "b", "a")})
    reader = g.read("packages")
    fields = spark.createDataFrame([("a.x", "n")], "fq_name string, name string")
    for step in ("_commit", "versions"):
        with monkeypatch.context() as m:
            m.setattr(GraphStore, step, lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                g.replace({"fields": fields, "packages": df("c")})
        assert rows(g.read("packages"), "name") == {("a",), ("b",)} and not g.exists("fields")
    g.replace({"fields": fields, "packages": df("c")})
    assert rows(g.read("packages"), "name") == {("c",)} and g.exists("fields") and reader.count() == 2
    with pytest.raises(RuntimeError):
        g._commit(2, {})
    g.replace({"packages": df("d")})
    g.vacuum(1)
    assert rows(g.read("packages"), "name") == {("d",)} and g.read("fields").count() == 1 and g.manifests() == [3] and len(g._listed("packages/v-*")) == 1


def test_stream(spark, tmp_path):
    g = GraphStore(spark, f"file://{tmp_path}/graph")
    at = datetime(2024, 1, 1)
    spark.createDataFrame([("p/A.java", A, at), ("p/B.java", "class {", at), ("p/B.java", B, at.replace(day=2))], "file_path string, source string, changed_at timestamp").write.parquet(f"{tmp_path}/in")
    reindex.follow(spark, f"{tmp_path}/in", g, f"{tmp_path}/check").awaitTermination()
    assert rows(g.read("classes"), "fq_name") >= {("p.A",), ("p.B",)}


def test_patches(tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/A.java").write_text(A)
    applier = PatchApplier(str(tmp_path), {"p.A": "p/A.java"})
    plan = EditPlan().replace_method("p.A", "f", "", "public int f() { return 1; }").add_import("p/A.java", "java.util.List").add_method("p.A", "void z() {}").delete_method("p.A", "more").create_file("p/C.java", "package p; class C {}")
    assert plan.commit(applier, lambda ops: False) is None
    done = plan.commit(applier)
    assert done.ok and not plan.ops and (tmp_path / "p/A.java.bak").read_text() == A
    text = (tmp_path / "p/A.java").read_text()
    assert "return 1" in text and "import java.util.List;" in text and "void z() {}" in text and "void more()" not in text and (tmp_path / "p/C.java").exists()
    bad = EditPlan().create_file("p/D.java", "class D {}").create_file("../x.java", "").commit(applier)
    assert not bad.ok and not (tmp_path / "p/D.java").exists()
    assert not EditPlan().replace_method("p.A", "f", "", "not java").commit(applier).ok and not applier.apply([]).ok


def test_evaluation_files(spark, tmp_path):
    fixture = {"schemaVersion": 1, "id": "x", "mode": "retrieval", "query": "q", "gold": {"relevant": ["m"]}}
    (tmp_path / "b.json").write_text(json.dumps(fixture))
    (tmp_path / "a.json").write_text(json.dumps({**fixture, "id": "y", "tags": ["t"]}))
    (tmp_path / "index.txt").write_text("# all\n\nb.json\n")
    assert [r.id for r in evaluation.fixtures(spark, str(tmp_path)).collect()] == ["y", "x"]
    assert [r.id for r in evaluation.listed_fixtures(spark, f"{tmp_path}/index.txt").collect()] == ["x"]
    assert evaluate.fixture_errors(evaluation.fixtures(spark, str(tmp_path))).count() == 0
    run = {"fixtureId": "x", "mode": "retrieval", "metrics": [{"name": "m", "value": 1.0, "status": "PASS"}]}
    (tmp_path / "runs.jsonl").write_text(json.dumps(run) + "\n\n" + json.dumps({**run, "metrics": [{"name": "m", "value": 0.0, "status": "FAIL"}]}) + "\n")
    m = evaluation.metrics(evaluation.runs(spark, f"{tmp_path}/runs.jsonl"))
    assert [(r.fixture_id, r.name, r.status) for r in m.collect()] == [("x", "m", "FAIL")]
    modes = evaluate.runs_by_mode(spark.createDataFrame([("retrieval", None)], "mode string, error string"))
    assert "m: pass 0, fail 1" in store.summary_text(evaluate.rollup(m), modes) and json.loads(store.summary_json(evaluate.rollup(m), modes))["fixtureCount"] == 1
    assert store.run_folder("out", datetime(2024, 1, 2, tzinfo=timezone.utc)) == "out/20240102T000000Z" and "fixtures" in store.manifest({}, datetime.now(timezone.utc), 1)


def test_sources(spark, tmp_path):
    (tmp_path / "src/p").mkdir(parents=True)
    (tmp_path / "src/p/A.java").write_text(A)
    (tmp_path / "src/p/n.txt").write_text("")
    assert [r.file_path for r in java.read_files(spark, f"{tmp_path}/src", f"{tmp_path}/none").collect()] == ["p/A.java"]
    assert java.read_roots(spark, [f"{tmp_path}/none"], str(tmp_path)).count() == 1 and java.read_listed(spark, [f"{tmp_path}/src/p/A.java", "x.txt"]).count() == 1


def test_loops(spark):
    said = iter(['{"verdict":"UNSAFE","confidence":0.5,"risks":["a"],"needs":["X.y"]}', '{"verdict":"SAFE","confidence":0.95,"risks":[]}'])
    assert loops.safe_loop(spark, lambda s, u: "code", lambda s, u: next(said), "q", lambda n: ["x"]).reason == "SAFE"
    same = lambda s, u: '{"verdict":"UNSAFE","confidence":0.5,"risks":["A"]}'
    stuck = loops.safe_loop(spark, lambda s, u: "code", same, "q", lambda n: [])
    assert (stuck.reason, stuck.iterations) == ("STAGNANT", 2)
    assert loops.safe_loop(spark, lambda s, u: "c", lambda s, u: '{"verdict":"UNSAFE","needs":["q"]}', "q", lambda n: []).reason == "CONVERGED"
    assert loops.safe_loop(spark, lambda s, u: 1 / 0, same, "q", lambda n: []).reason == "ERROR"
    assert loops.history_table(spark, {"r": stuck}).count() == 2

    class Fails:
        def verify(self, code):
            return ("FAIL", "line 1") if code == "bad" else ("PASS", "")

    codes, asked = iter(["bad", "good"]), []
    out = loops.safe_loop(spark, lambda s, u: asked.append(u) or next(codes), lambda s, u: '{"verdict":"SAFE","confidence":0.95}', "q", lambda n: [], prepare=lambda q: "near code", verifiers=(Fails(),))
    assert (out.reason, out.iterations, out.output) == ("SAFE", 2, "good") and "near code" in asked[0] and "line 1" in asked[1]
    quick = loops.safe_loop(spark, lambda s, u: "c", lambda s, u: '{"verdict":"SAFE","confidence":0.95}', "q", lambda n: [f"id of {x}" for x in n], review=lambda s, u: 'x {"assumptions":[{"needs":["A.b","A.b"]}]}', verifiers=(Fails(),))
    assert quick.reason == "SAFE" and quick.history[0]["quick"] and len(quick.history) == 1
    assert loops.review_needs("no json") == loops.review_needs('{"assumptions": 3}') == []


def test_planner_loop(spark):
    said = iter(["what?", '{"tool":"look","args":{"id":"A"}}', '{"tool":"look","args":{"id":"A"}}', '{"tool":"none"}', '{"final":"draft"}', '{"final":"better"}'])
    out = loops.planner_loop(spark, lambda s, u: next(said), lambda s, u: '{"safe": true, "confidence": 0.95}' if "better" in u else '{"safe": false, "confidence": 0.2, "issues": ["x"]}', {"look": lambda id: f"code of {id}"}, "q")
    assert (out.reason, out.output, out.iterations) == ("SAFE", "better", 2)
    assert [h["result"] for h in out.history if "tool" in h][:2] == ["code of A", "already called; see above"] and out.history[2]["result"].startswith("failed: KeyError")
    assert loops.planner_loop(spark, lambda s, u: "no", lambda s, u: "", {}, "q", most=1, steps=2).reason == "MAX_ITERATIONS"


def test_loops_around_judges(spark):
    class Task:
        def worker_prompt(self, last, feedback, k):
            return f"{feedback}"

        def judge_prompt(self, output, k):
            return output

    assert loops.judged_loop(spark, lambda s, u: u, lambda s, u: "VERDICT: PASS" if u == "no" else "VERDICT: FAIL\nFEEDBACK: no", Task()).iterations == 2
    assert loops.refine_loop(spark, lambda s, u: '{"explanation":"e"}', "q", lambda n: []).reason == "SAFE"


def test_tools(spark):
    from quillgraph.plans import demo

    sf = "/root/testdata/sf0.001"
    c, none = demo.chunks(spark, sf), F.array().cast("array<string>")
    c = c.withColumns({"method_signature": F.col("method_name"), "start_line": F.lit(1), "end_line": F.lit(1), "imports": none, "part_index": F.lit(1)})
    classes = c.select(F.col("fq_class_name").alias("fq_name"), F.col("class_name").alias("simple_name"), "file_path").distinct()
    fields = spark.createDataFrame([], "fq_name string, name string, declaration string, type string, owning_class_fqn string")
    vector = list(spark.read.parquet(f"{sf}/embeddings.parquet").first()["embedding"])
    t = Tools(c, classes, fields, demo.edges(spark, sf), demo.embeddings(spark, sf), embed=lambda q: vector, chat=lambda s, u: s)
    name = c.where("vec_id = 3").first()["chunk_id"]
    assert t.retrieve_code(f"refactor {name}").count() == 10 and t.method_callees(name).count() >= 1 and t.trace_call_chain(name).count() > 1
    assert t.subgraph_topology(name).count() > 0 and t.expand_node(name).count() > 0 and t.retrieve_code_by_id(name, 1, 5).count() == 5
    assert len(t.class_overview(c.first()["class_name"]).first()["methods"]) > 1 and t.call_path(name, t.method_callees(name).first()[0]).first()["length"] == 1
    assert t.self_review("x") == "self_review" and t.refactor_code("a", "b") == "refactor" and t.method_callers("nothing.here").count() == 0
    assert t.self_review_context([name], spark.createDataFrame([], "chunk_id string"), name).count() == 1


def test_config():
    assert Config.load({"top_k": "3"}, {"QUILLGRAPH_TOP_K": "4", "QUILLGRAPH_DEPTH": "1"}) == Config(top_k=3, depth=1)


def test_entry_without_parts():
    """The driver's contract holds without the optional parts."""
    import subprocess
    import sys

    code = "import sys\nfor m in ('quillgraph.llm', 'corpus_pipeline'): sys.modules[m] = None\nimport __spark_entry__ as e\nassert len(e.queries()) > 50 and not any(n.startswith('op') for n in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0


@pytest.mark.parametrize(("k", "want"), [(10, (2, 3, 2, 2, 1)), (8, (1, 2, 2, 2, 1)), (6, (2, 2, 1, 1, 0))])
def test_slots(k, want):
    from quillgraph.operators.retrieval import slots

    assert tuple(slots(k, True).values()) == want


def test_files_of_plain_paths_keep_their_names(spark, tmp_path):
    """A path without a scheme is written under the name that it has, whatever its characters, as one with a scheme is."""
    names = ["S#1.json", "a b%23.json", "ü?.json"]
    for head in ("", "file:", "file://"):
        folder = f"{head}{tmp_path}/to{len(head)}"
        rows = spark.createDataFrame([(f"{folder}/{n}", n) for n in names], "file_path string, body string")
        assert store.write_each(rows, "file_path", "body") == 3
        assert sorted(os.listdir(f"{tmp_path}/to{len(head)}")) == sorted(names)
