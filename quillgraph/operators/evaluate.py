"""Evaluation: fixtures, scores of runs, rollups, diff against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("retrieval", "safeloop")


def filter_fixtures(fixtures: DataFrame, id_pattern: str | None = None, mode: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """The pattern occurs in the id; the mode in any case; all tags."""
    out = fixtures
    if id_pattern:
        out = out.where(F.col("id").rlike(id_pattern))
    if mode:
        out = out.where(F.lower("mode") == mode.lower())
    if tags:
        out = out.where(F.size(F.array_except(F.array(*map(F.lit, tags)), F.coalesce("tags", F.array().cast("array<string>")))) == 0)
    return out


def first_fixtures(fixtures: DataFrame, limit: int | None) -> DataFrame:
    """The first `limit` by file name, after all filters; 0 or none is no limit."""
    return fixtures.orderBy("file").limit(limit) if limit and limit > 0 else fixtures.orderBy("file")


def fixture_errors(fixtures: DataFrame) -> DataFrame:
    """(id, problem) of fixtures that aren't valid."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    problem = (
        F.when(~F.col("schemaVersion").eqNullSafe(F.lit(1)), "schemaVersion must be 1").when(blank("id"), "id is blank").when(blank("mode"), "mode is blank").when(blank("query"), "query is blank")
        .when(F.coalesce(F.size("gold.relevant"), F.lit(0)) <= 0, "gold.relevant is empty").when(~F.lower("mode").isin(*MODES), "mode is unknown")
    )
    return fixtures.select("id", problem.alias("problem")).where("problem is not null")


def status(value: Column) -> Column:
    """F27."""
    return F.when(value > 0, "PASS").otherwise("FAIL")


def retrieval_scores(retrieved: DataFrame, gold: DataFrame, runs: DataFrame) -> DataFrame:
    """Long table (fixture_id, name, k, value, status). retrieved: fixture_id, chunk_id, rank; gold: fixture_id, chunk_id;
    runs: fixture_id, error, anchor, gold_anchor. A run with an error has ERROR metrics, one without gold NOT_RUN ones."""
    got = retrieved.groupBy("fixture_id").agg(F.count("*").alias("k"))
    want = gold.groupBy("fixture_id").agg(F.count("*").alias("n_gold"))
    hit = retrieved.join(gold.distinct(), ["fixture_id", "chunk_id"]).groupBy("fixture_id").agg(F.count_distinct("chunk_id").alias("hits"), (F.lit(1.0) / F.min("rank")).alias("first"))
    all_ = runs.join(got, "fixture_id", "left").join(want, "fixture_id", "left").join(hit, "fixture_id", "left").na.fill(0, ["k", "n_gold", "hits"]).na.fill(0.0, ["first"])
    k = F.when(F.col("error").isNotNull(), "K").otherwise(F.col("k").cast("string"))
    anchor_known = F.coalesce(F.trim("gold_anchor"), F.lit("")) != ""
    rows = F.array(
        F.struct(F.concat(F.lit("retrieval.precision@"), k).alias("name"), F.when(F.col("k") == 0, 0.0).otherwise(F.col("hits") / F.col("k")).alias("value"), (F.col("n_gold") > 0).alias("run")),
        F.struct(F.concat(F.lit("retrieval.recall@"), k).alias("name"), F.when(F.col("n_gold") == 0, 0.0).otherwise(F.col("hits") / F.col("n_gold")).alias("value"), (F.col("n_gold") > 0).alias("run")),
        F.struct(F.lit("retrieval.anchor.hit").alias("name"), F.coalesce((F.col("anchor") == F.col("gold_anchor")).cast("double"), F.lit(0.0)).alias("value"), anchor_known.alias("run")),
        F.struct(F.lit("retrieval.mrr").alias("name"), F.col("first").alias("value"), (F.col("n_gold") > 0).alias("run")),
    )
    long = all_.select("fixture_id", "error", "k", F.explode(rows).alias("m"))
    state = F.when(F.col("error").isNotNull(), "ERROR").when(~F.col("m.run"), "NOT_RUN").otherwise(status(F.col("m.value")))
    return long.select("fixture_id", F.col("m.name").alias("name"), "k", F.when(state.isin("PASS", "FAIL"), F.col("m.value")).otherwise(0.0).alias("value"), state.alias("status"))


def verdict_score(runs: DataFrame) -> DataFrame:
    """(fixture_id, value, status) of runs (fixture_id, mode, error, expected, is_safe)."""
    agree = F.lower("expected") == F.when(F.col("is_safe"), "safe").otherwise("unsafe")
    state = (
        F.when(F.col("error").isNotNull(), "ERROR").when(~F.lower(F.coalesce("mode", F.lit(""))).eqNullSafe(F.lit("safeloop")), "NOT_RUN").when(F.coalesce(F.trim("expected"), F.lit("")) == "", "NOT_RUN")
        .when(F.col("is_safe").isNull(), "ERROR").when(agree, "PASS").otherwise("FAIL")
    )
    return runs.select("fixture_id", F.when(state == "PASS", 1.0).otherwise(0.0).alias("value"), state.alias("status"))


def build_score(results: DataFrame) -> DataFrame:
    """verifier results (fixture_id, name, status) become metrics of the same status."""
    return results.select("fixture_id", F.concat("name", F.lit(".pass")).alias("name"), F.when(F.col("status") == "PASS", 1.0).otherwise(0.0).alias("value"), "status")


def rollup(metrics: DataFrame) -> DataFrame:
    """(name, pass, fail, error, not_run, pass_rate, mean_value) of metrics (name, value, status)."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = metrics.groupBy("name").agg(n("PASS").alias("pass"), n("FAIL").alias("fail"), n("ERROR").alias("error"), n("NOT_RUN").alias("not_run"), F.avg(F.when(F.col("status").isin("PASS", "FAIL"), F.col("value"))).alias("mean_value"))
    run = F.col("pass") + F.col("fail") + F.col("error")
    return out.withColumn("pass_rate", F.when(run > 0, F.col("pass") / run))


def runs_by_mode(runs: DataFrame) -> DataFrame:
    """A8."""
    return runs.groupBy("mode").agg(F.count("*").alias("fixtures"), F.count("error").alias("errors")).orderBy("mode")


def classify(base_status: Column, base_value: Column, status: Column, value: Column, epsilon: float = 0.05) -> Column:
    """F26."""
    drop = base_value - value
    was, now = base_status == "PASS", status == "PASS"
    return (
        F.when((base_status == "NOT_RUN") & (status == "NOT_RUN"), "UNCHANGED").when(base_status == "NOT_RUN", "VERIFIER_WIRED").when(status == "NOT_RUN", "REGRESSION")
        .when(was & ~now, "REGRESSION").when(~was & now, "WIN").when(drop > epsilon, "REGRESSION").when(-drop > epsilon, "WIN").otherwise("UNCHANGED")
    )


def baseline_diff(current: DataFrame, base: DataFrame, epsilon: float = 0.05) -> DataFrame:
    """(fixture_id, name, base_value, value, kind); what only one side has is left out."""
    b = base.select("fixture_id", "name", F.col("status").alias("base_status"), F.col("value").alias("base_value"))
    both = current.join(b, ["fixture_id", "name"])
    return both.select("fixture_id", "name", "base_value", "value", classify(F.col("base_status"), F.col("base_value"), F.col("status"), F.col("value"), epsilon).alias("kind"))


def diff_summary(diffs: DataFrame, runs: DataFrame, base_runs: DataFrame) -> DataFrame:
    """One row of counts; runs and base_runs hold fixture_id and anchor."""
    n = lambda k: F.count_if(F.col("kind") == k)
    kinds = diffs.agg(n("REGRESSION").alias("regressions"), n("WIN").alias("wins"), n("VERIFIER_WIRED").alias("verifier_wired"))
    both = runs.select("fixture_id", F.col("anchor").alias("a")).join(base_runs.select("fixture_id", F.col("anchor").alias("b")), "fixture_id")
    changed = diffs.where("kind <> 'UNCHANGED'").select("fixture_id").distinct()
    still = both.join(changed, "fixture_id", "left_anti").agg(F.count("*").alias("unchanged"))
    moved = both.agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("anchor_changes"))
    sizes = runs.agg(F.count("*").alias("current_fixtures")).join(base_runs.agg(F.count("*").alias("baseline_fixtures")))
    return kinds.join(still).join(moved).join(sizes)


def diff_report(diffs: DataFrame, runs: DataFrame, base_runs: DataFrame) -> dict:
    """The summary with its lists: "fixture metric" of regressions, wins and newly wired verifiers, "fixture: old -> new" of changed
    anchors. The lists hold a row for each metric of an evaluation's fixtures, which are files that people write."""
    out = diff_summary(diffs, runs, base_runs).first().asDict()
    named = diffs.where("kind <> 'UNCHANGED'").orderBy("fixture_id", "name").select("kind", F.concat_ws(" ", F.col("fixture_id").cast("string"), "name").alias("what")).collect()
    lists = {key: [r["what"] for r in named if r["kind"] == kind] for key, kind in (("regressions", "REGRESSION"), ("wins", "WIN"), ("verifierWired", "VERIFIER_WIRED"))}
    both = runs.select("fixture_id", F.coalesce("anchor", F.lit("none")).alias("a")).join(base_runs.select("fixture_id", F.coalesce("anchor", F.lit("none")).alias("b")), "fixture_id")
    moved = [f"{r['fixture_id']}: {r['b']} -> {r['a']}" for r in both.where("a <> b").orderBy("fixture_id").collect()]
    return {"baselineFixtures": out["baseline_fixtures"], "currentFixtures": out["current_fixtures"], "unchanged": out["unchanged"], **lists, "anchorChanges": moved}


def diff_lines(diffs: DataFrame, runs: DataFrame, base_runs: DataFrame) -> DataFrame:
    """K13 of any size: (place, list, what, text) of a diff_report: its counts and the lines of its lists, in order of place and what."""
    lists = {"REGRESSION": ("regressions", "Regressions"), "WIN": ("wins", "Wins"), "VERIFIER_WIRED": ("verifierWired", "Verifiers wired")}
    of = lambda i: F.create_map(*(F.lit(x) for k, v in lists.items() for x in (k, v[i])))
    rank = F.array_position(F.array(*map(F.lit, lists)), F.col("kind")).cast("int")
    named = diffs.where(F.col("kind") != "UNCHANGED").select((2 * rank).alias("place"), F.element_at(of(0), F.col("kind")).alias("list"), F.concat_ws(" ", F.col("fixture_id").cast("string"), "name").alias("what"), F.element_at(of(1), F.col("kind")).alias("title"))
    both = runs.select("fixture_id", F.coalesce("anchor", F.lit("none")).alias("a")).join(base_runs.select("fixture_id", F.coalesce("anchor", F.lit("none")).alias("b")), "fixture_id")
    moved = both.where("a <> b").select(F.lit(8).alias("place"), F.lit("anchorChanges").alias("list"), F.concat("fixture_id", F.lit(": "), "b", F.lit(" -> "), "a").alias("what"), F.lit("Anchor changes").alias("title"))
    every = named.unionByName(moved)
    heads = every.groupBy("place", "list", "title").count().select((F.col("place") - 1).alias("place"), "list", F.lit("").alias("what"), F.concat("title", F.lit(" ("), "count", F.lit("):")).alias("text"))
    first = diff_summary(diffs, runs, base_runs).select(F.lit(0).alias("place"), F.lit("counts").alias("list"), F.concat(F.lit("unchanged "), "unchanged").alias("what"), F.concat(F.lit("Baseline: "), "baseline_fixtures", F.lit(" fixtures, current: "), "current_fixtures", F.lit(", unchanged: "), "unchanged").alias("text"))
    return first.unionByName(heads).unionByName(every.select("place", "list", "what", F.concat(F.lit("  "), "what").alias("text")))


def exit_code(runs: DataFrame, metrics: DataFrame, regressions: DataFrame | None = None, dry_run: bool = False, self_check: bool = False) -> DataFrame:
    """One row (code): 2 if no run retrieved anything, 1 on a failed self-check, an error or a regression, else 0. runs: error, n_retrieved."""
    r = runs.agg(F.bool_or(F.col("error").isNotNull()).alias("any_error"), F.bool_and(F.col("error").isNull() & (F.col("n_retrieved") == 0)).alias("all_empty"))
    m = metrics.agg(F.count_if(F.col("status").isin("FAIL", "ERROR")).alias("bad"))
    g = (regressions.where("kind = 'REGRESSION'") if regressions is not None else metrics.where("false")).agg(F.count("*").alias("worse"))
    code = F.when(F.coalesce("all_empty", F.lit(True)) & F.lit(not dry_run), 2).when(F.lit(self_check) & (F.col("bad") > 0), 1).when(F.coalesce("any_error", F.lit(False)), 1).when(F.col("worse") > 0, 1).otherwise(0)
    return r.join(m).join(g).select(code.alias("code"))


def json_fidelity(verdicts: DataFrame) -> DataFrame:
    """(run_id, fidelity): the share of verdicts parsed from JSON, 1 without any. verdicts: run_id, parsed_from_json (null: none)."""
    return verdicts.groupBy("run_id").agg(F.coalesce(F.avg(F.col("parsed_from_json").cast("double")), F.lit(1.0)).alias("fidelity"))


def stagnation(verdicts: DataFrame) -> DataFrame:
    """L5 over iterations: (run_id, iteration, stagnant); verdicts: run_id, iteration, risks."""
    from pyspark.sql import Window

    from ..functions.verdicts import same_risks

    before = F.lag("risks").over(Window.partitionBy("run_id").orderBy("iteration"))
    return verdicts.select("run_id", "iteration", "risks", before.alias("before")).select("run_id", "iteration", same_risks(F.col("risks"), F.col("before")).alias("stagnant"))
