"""One evaluation from fixtures to exit code: load, filter, validate, retrieve for all fixtures at once, score, report, compare."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import batch_retrieval, evaluate, lookup
from ..schema import RUNS
from ..sources import evaluation as sources
from ..sources import store
from ..sources.tables import cut, ship


@dataclass
class Options:
    """id_pattern, mode, tags and limit choose fixtures; a dry run takes the gold set for the result, a self-check expects it to score."""

    id_pattern: str | None = None
    mode: str | None = None
    tags: tuple[str, ...] = ()
    limit: int | None = None
    dry_run: bool = False
    self_check: bool = False
    epsilon: float = 0.05


@dataclass
class Graph:
    """The tables that are searched, and a factory of embedders for the queries (embed_batch). index: a vector index, else all is scanned."""

    chunks: DataFrame
    embeddings: DataFrame
    edges: DataFrame
    embedder: Callable
    index: object = None


@dataclass
class Evaluation:
    """runs (RUNS), metrics (fixture_id, name, k, value, status), diffs (None without a baseline) and the exit code."""

    runs: DataFrame
    metrics: DataFrame
    diffs: DataFrame | None
    code: int


def chosen(fixtures: DataFrame, o: Options) -> DataFrame:
    """A fixture that isn't valid is an error, told with its problem."""
    out = evaluate.first_fixtures(evaluate.filter_fixtures(fixtures, o.id_pattern, o.mode, list(o.tags)), o.limit)
    wrong = evaluate.fixture_errors(out).limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r['id']}: {r['problem']}" for r in wrong))
    return out


def requests(fixtures: DataFrame, graph: Graph) -> DataFrame:
    """(query_id, vector, anchor, top_k): the query's vector, and the first method that it names."""
    ship(fixtures.sparkSession)
    embedder = graph.embedder

    def run(frames):
        own = embedder()
        for pdf in frames:
            yield pd.DataFrame({"query_id": pdf["id"], "vector": own.embed_batch(pdf["query"].tolist()), "top_k": pdf["topK"].fillna(0).astype("int32")})

    asked = cut(fixtures.select("id", "query", "topK").mapInPandas(run, "query_id string, vector array<double>, top_k int"))
    anchors = lookup.query_anchor(graph.chunks, fixtures.select(F.col("id").alias("query_id"), "query")).select("query_id", F.col("chunk_id").alias("anchor"))
    return cut(asked.join(anchors, "query_id", "left"))


def retrieved(asked: DataFrame, graph: Graph, c: Config = Config()) -> DataFrame:
    """(fixture_id, chunk_id, score, rank): one batch for each number of results that fixtures ask for."""
    out = None
    for (k,) in asked.select("top_k").distinct().collect():
        one = batch_retrieval.retrieve(graph.chunks, graph.embeddings, graph.edges, asked.where(F.col("top_k") == k).drop("top_k"), k if k > 0 else None, c, graph.index)
        rows = one.select(F.col("query_id").alias("fixture_id"), "chunk_id", "score", F.col("position").alias("rank"))
        out = rows if out is None else out.unionByName(rows)
    return cut(out) if out is not None else asked.sparkSession.createDataFrame([], "fixture_id string, chunk_id string, score double, rank int")


def run(spark: SparkSession, fixtures: DataFrame, graph: Graph, out: str | None = None, baseline: DataFrame | None = None, o: Options = Options(), verdicts: DataFrame | None = None, c: Config = Config()) -> Evaluation:
    """fixtures: of sources.evaluation; baseline: runs of an earlier log; verdicts: (fixture_id, error, is_safe) of loops that ran elsewhere.

    Reports go to the folder `out`: the run log, a summary and the diff as text and JSON, and a manifest. Exit codes are those of A15.
    """
    own = cut(chosen(fixtures, o))
    baseline = cut(baseline) if baseline is not None else None  # the reports may go where it is
    gold = own.select(F.col("id").alias("fixture_id"), F.posexplode("gold.relevant").alias("place", "chunk_id"))
    if o.dry_run:
        found = gold.select("fixture_id", "chunk_id", F.lit(1.0).alias("score"), (F.col("place") + 1).alias("rank"))
        anchors = own.select(F.col("id").alias("fixture_id"), F.col("gold.anchor").alias("anchor"))
    else:
        asked = requests(own, graph)
        found, anchors = retrieved(asked, graph, c), asked.select(F.col("query_id").alias("fixture_id"), "anchor")
    runs = own.select(F.col("id").alias("fixture_id"), "mode", F.lit(None).cast("string").alias("error"), F.col("gold.anchor").alias("gold_anchor"), F.col("expected.analyzer").alias("expected")).join(anchors, "fixture_id", "left")
    metrics = evaluate.retrieval_scores(found.select("fixture_id", "chunk_id", "rank"), gold.select("fixture_id", "chunk_id"), runs.select("fixture_id", "error", "anchor", "gold_anchor"))
    if verdicts is not None:
        safe = evaluate.verdict_score(runs.drop("error").join(verdicts, "fixture_id"))
        metrics = metrics.unionByName(safe.select("fixture_id", F.lit("safeloop.verdict").alias("name"), F.lit(0).cast("long").alias("k"), "value", "status"))
    metrics = cut(metrics)
    log = cut(_log(runs, found, metrics))
    diffs = None
    if baseline is not None:
        diffs = cut(evaluate.baseline_diff(metrics.select("fixture_id", "name", "value", "status"), sources.metrics(baseline), o.epsilon))
    counts = log.select("error", F.size("retrieved").alias("n_retrieved"))
    code = evaluate.exit_code(counts, metrics, diffs, o.dry_run, o.self_check).first()["code"]
    if out:
        _report(spark, out, log, metrics, diffs, baseline, o)
    return Evaluation(log, metrics, diffs, code)


def _log(runs: DataFrame, found: DataFrame, metrics: DataFrame) -> DataFrame:
    """RUNS of an evaluation. A fixture's results and metrics are a few rows."""
    hits = found.groupBy("fixture_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("h"))
    told = metrics.groupBy("fixture_id").agg(F.sort_array(F.collect_list(F.struct("name", "value", "status", F.lit(None).cast("string").alias("note")))).alias("metrics"))
    none = F.array().cast("array<struct<rank:int,chunk_id:string,score:double>>")
    rows = runs.join(hits, "fixture_id", "left").join(told, "fixture_id", "left")
    made = rows.select(
        F.col("fixture_id").alias("fixtureId"), "mode", F.current_timestamp().alias("startedAt"), "error", F.col("anchor").alias("anchorId"),
        F.transform(F.coalesce("h", none), lambda x: F.struct(x["chunk_id"].alias("chunkId"), x["score"].alias("score"), x["rank"].alias("rank"))).alias("retrieved"), "metrics")
    return runs.sparkSession.createDataFrame([], RUNS).unionByName(made, allowMissingColumns=True)


def _report(spark: SparkSession, out: str, log: DataFrame, metrics: DataFrame, diffs: DataFrame | None, baseline: DataFrame | None, o: Options) -> None:
    """K11-K14. The texts hold one line for each metric's name, and for each change of a fixture."""
    store.write_runs(log, f"{out}/runs.jsonl")
    roll, modes = cut(evaluate.rollup(metrics)), evaluate.runs_by_mode(log.select("mode", "error"))
    texts = {"summary.txt": store.summary_text(roll, modes), "summary.json": store.summary_json(roll, modes), "manifest.json": store.manifest(vars(o), datetime.now(timezone.utc), log.count())}
    if diffs is not None:
        sides = [x.select(F.col("fixtureId").alias("fixture_id"), F.col("anchorId").alias("anchor")) for x in (log, baseline)]
        report = evaluate.diff_report(diffs, *sides)
        texts |= {"diff.txt": store.diff_text(report), "diff.json": store.diff_json(report)}
    for name, text in texts.items():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/{name}")
