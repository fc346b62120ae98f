"""A whole evaluation, from fixture files to reports and the exit code."""

import json

import pytest

from quillgraph.plans import batches, demo, evaluation
from quillgraph.sources import evaluation as sources

SF = "/root/testdata/sf0.001"


def test_evaluation(spark, tmp_path):
    rows = [r.asDict(True) for r in batches.fixtures(spark, SF).limit(3).collect()]
    (tmp_path / "in").mkdir()
    for i, r in enumerate(rows):
        r |= {"topK": 4 if i else 10, "tags": ["a"] if i < 2 else []}
        (tmp_path / f"in/{r['id']}.json").write_text(json.dumps({k: v for k, v in r.items() if k != "file"}))
    fixtures = sources.fixtures(spark, f"file://{tmp_path}/in")
    graph = evaluation.Graph(demo.chunks(spark, SF), demo.embeddings(spark, SF), demo.edges(spark, SF), batches._one_hot)
    out = f"file://{tmp_path}/out"
    done = evaluation.run(spark, fixtures, graph, out, verdicts=spark.createDataFrame([(rows[0]["id"], None, True)], "fixture_id string, error string, is_safe boolean"))
    assert done.code == 0 and {r.fixtureId: len(r.retrieved) for r in done.runs.collect()} == {r["id"]: r["topK"] for r in rows}
    assert {r.anchorId for r in done.runs.collect()} == {r["gold"]["anchor"] for r in rows}
    named = {(r.fixture_id, r.name): r for r in done.metrics.collect()}
    assert len(named) == 13 and named[rows[0]["id"], "safeloop.verdict"].status == "NOT_RUN"  # its mode is retrieval
    log = sources.runs(spark, f"{out}/runs.jsonl")
    assert {(r.fixture_id, r.name, r.value, r.status) for r in sources.metrics(log).collect()} == {(r.fixture_id, r.name, r.value, r.status) for r in named.values()}
    summary = json.loads("\n".join(r[0] for r in spark.read.text(f"{out}/summary.json").collect()))
    assert summary["fixtureCount"] == 3 and summary["byMetric"]["retrieval.anchor.hit"]["pass"] == 3
    # the same against itself is unchanged; against a better baseline it is worse
    again = evaluation.run(spark, fixtures, graph, out, log, evaluation.Options(tags=("a",)))
    assert again.code == 0 and {r.kind for r in again.diffs.collect()} == {"UNCHANGED"} and again.runs.count() == 2
    dry = evaluation.run(spark, fixtures, graph, o=evaluation.Options(dry_run=True, self_check=True))
    assert dry.code == 0 and {r.value for r in dry.metrics.collect()} == {1.0}
    worse = evaluation.run(spark, fixtures, graph, out, dry.runs, evaluation.Options(limit=2))
    bad = {(r.fixture_id, r.name) for r in worse.diffs.collect() if r.kind == "REGRESSION"}
    assert worse.code == (1 if bad else 0) and bad <= set(named)
    with pytest.raises(ValueError, match="query is blank"):
        evaluation.run(spark, fixtures.withColumn("query", fixtures["description"]), graph)
    none = evaluation.run(spark, fixtures.where("id = 'none'"), graph)
    assert none.code == 2 and none.runs.count() == 0
