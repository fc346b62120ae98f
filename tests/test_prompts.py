"""Prompts of all kinds: what each shows, bounded context, nulls and requests without context."""

from quillgraph.operators import prompts
from quillgraph.plans.tools import RESPONSE_SCHEMAS

REQUESTS = "request_id string, kind string, task string, changes string, report string, prompt string"
CHOSEN = "request_id string, chunk_id string, position int, is_anchor boolean, topology_only boolean"
CHUNKS = "chunk_id string, class_name string, method_name string, file_path string, method_signature string, method_annotations array<string>, calls array<string>, called_by array<string>, code string"


def test_kinds_bounds_and_nulls(spark):
    asked = [(k, k, f"do {k}", "new code", "1 deleted", "old") for k in prompts.ASKS] + [("bare", "refactor", None, None, None, None), ("odd", "poem", "x", "y", "z", None), ("none", None, "x", None, None, None)]
    chosen = [(k, c, i, i == 0, i == 1) for k in [*prompts.ASKS, "odd"] for i, c in enumerate(["p.A#f()", "p.B#g(int)", "p.C#h()"])]
    code = [("p.A#f()", "A", "f", "p/A.java", "void f()", ["Override"], ["p.B#g(int)"], None, "void f() { g(1); }"), ("p.B#g(int)", "B", "g", None, None, None, None, ["p.A#f()"], None), ("p.C#h()", "C", "h", "p/C.java", "void h()", [], [], [], "void h() {}")]
    got = prompts.build(spark.createDataFrame(asked, REQUESTS), spark.createDataFrame(chosen, CHOSEN), spark.createDataFrame(code, CHUNKS), RESPONSE_SCHEMAS, 2)
    text = {r.request_id: r.prompt for r in got.collect()}
    assert len(text) == len(asked) and text["odd"] is None and text["none"] is None
    for kind in prompts.ASKS:
        own = text[kind]
        assert own.startswith(f"Task:\ndo {kind}\n\n{prompts.ASKS[kind]}") and "C.h" not in own
        assert ("Proposed changes:\nnew code" in own) == (kind in ("safety_check", "self_review"))
        assert ("1 deleted" in own) == (kind == "safety_check")
        assert ("void f() { g(1); }" in own and "(body left out)" in own) == (kind in ("refactor", "patch", "self_review"))
        assert ("- A.f calls B.g\n- B.g is called by A.f\n" in own) == (kind in ("refactor", "patch"))
    assert "[A.f (target)]\nSignature: void f()\nCalls: B.g\n\n[B.g]\nSignature: \nCalled by: A.f\n" in text["analysis"]
    assert "Callers:\n- B.g is called by A.f\n\n" in text["safety_check"] and text["patch"].endswith(RESPONSE_SCHEMAS["patch_plan"])
    assert "Task:\n\n\n" in text["bare"] and f"{prompts.RELATIONS}- none\n" in text["bare"] and "[" not in text["bare"].split("Answer")[0]
    assert prompts.build(spark.createDataFrame([], REQUESTS), spark.createDataFrame([], CHOSEN), spark.createDataFrame(code, CHUNKS), RESPONSE_SCHEMAS).count() == 0
