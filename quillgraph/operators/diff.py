"""Structural diffs of parsed methods and their risk.

A parsed method has: chunk_id, class_name, method_name, return_type, params ("type name" each), visibility, throws, calls, annotations,
body, parse_error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_override, squeeze, visibility_rank

#: Risk weights: signature by caller, its cap, call added, call removed, narrowed visibility, throws, annotation.
SIGNATURE, SIGNATURE_MOST, ADDED, REMOVED, NARROWED, THROWS, ANNOTATION = 0.4, 0.8, 0.05, 0.15, 0.3, 0.1, 0.05
PARSED = ("return_type", "params", "visibility", "throws", "calls", "annotations", "body", "parse_error")


def _or_none(x: Column) -> Column:
    return F.when(x == "", "(none)").otherwise(x)


def diff(pairs: DataFrame) -> DataFrame:
    """Pairs holds chunk_id and the parsed methods as structs `old` and `new`."""
    o, n = (lambda f: F.col(f"old.{f}")), (lambda f: F.col(f"new.{f}"))
    flat = {"return_type": lambda c: c, "params": lambda c: F.array_join(c, ", "), "visibility": lambda c: c, "throws": lambda c: F.array_join(F.array_sort(c), ", ")}
    old, new = {k: f(o(k)) for k, f in flat.items()}, {k: f(n(k)) for k, f in flat.items()}
    changed = {k: ~old[k].eqNullSafe(new[k]) for k in flat}
    error = F.when(F.coalesce(o("parse_error"), F.lit(False)), "original").when(F.coalesce(n("parse_error"), F.lit(False)), "proposed")
    out = pairs.select(
        "chunk_id", error.alias("parse_error"), *(changed[k].alias(f"{k}_changed") for k in flat),
        *(x.alias(f"{side}_{k}") for side, values in (("old", old), ("new", new)) for k, x in ((k, _or_none(v) if k == "throws" else v) for k, v in values.items())),
        F.array_except(n("calls"), o("calls")).alias("added_calls"), F.array_except(o("calls"), n("calls")).alias("removed_calls"),
        F.array_except(n("annotations"), o("annotations")).alias("added_annotations"), F.array_except(o("annotations"), n("annotations")).alias("removed_annotations"),
        (~squeeze(o("body")).eqNullSafe(squeeze(n("body")))).alias("body_changed"))
    signature = F.col("return_type_changed") | F.col("params_changed") | F.col("visibility_changed") | F.col("throws_changed")
    same_annotations = (F.size("added_annotations") == 0) & (F.size("removed_annotations") == 0)
    out = out.withColumn("signature_changed", signature).withColumn("call_graph_changed", (F.size("added_calls") > 0) | (F.size("removed_calls") > 0))
    out = out.withColumn("body_only", ~F.col("signature_changed") & same_annotations & F.col("body_changed"))
    flags = sum((F.col(f"{k}_changed").cast("int") for k in flat), F.lit(0))
    sizes = sum((F.size(c) for c in ("added_calls", "removed_calls", "added_annotations", "removed_annotations")), F.lit(0))
    return out.withColumn("change_count", flags + sizes).withColumn("safe_change", F.col("parse_error").isNull() & ~F.col("signature_changed") & ~F.col("call_graph_changed"))


def score(diffs: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds callers, affected_callers, safety (1 - risk; 0 if a side doesn't parse). Callers are those of CALLS edges."""
    asked = diffs.select("chunk_id").distinct()
    up = edges.where("edge_type = 'CALLS'").join(asked, F.col("dst") == F.col("chunk_id"), "left_semi").groupBy(F.col("dst").alias("chunk_id")).agg(F.array_sort(F.collect_set("src")).alias("affected_callers"))
    out = diffs.join(up, "chunk_id", "left").withColumn("affected_callers", F.when(F.col("signature_changed"), F.coalesce("affected_callers", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    callers = F.size("affected_callers")
    narrowed = visibility_rank(F.col("new_visibility")) < visibility_rank(F.col("old_visibility"))
    risk = (
        F.when(F.col("signature_changed"), F.least(callers * SIGNATURE, F.lit(SIGNATURE_MOST))).otherwise(0.0)
        + F.when(F.col("visibility_changed") & narrowed, NARROWED).otherwise(0.0)
        + F.when(F.col("throws_changed"), THROWS).otherwise(0.0)
        + F.size("removed_calls") * REMOVED
        + F.size("added_calls") * ADDED
        + (F.size("added_annotations") + F.size("removed_annotations")) * ANNOTATION
    )
    safety = F.when(F.col("parse_error").isNotNull(), 0.0).otherwise(1.0 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), risk)))
    return out.withColumn("callers", callers).withColumn("narrowed", narrowed).withColumn("safety", F.round(safety, 10))


def match(originals: DataFrame, proposed: DataFrame) -> DataFrame:
    """(proposal, chunk_id): by class and name, each original once; then what is left by name, in the order of both sides.

    originals: chunk_id, class_name, method_name; proposed: proposal (its place), class_name, method_name.
    """
    nth = lambda by, order: F.row_number().over(Window.partitionBy(*by).orderBy(order))
    last = originals.groupBy("class_name", "method_name").agg(F.max("chunk_id").alias("chunk_id")).where("class_name <> ''")
    first = proposed.where("class_name <> ''").withColumn("k", nth(["class_name", "method_name"], "proposal")).where("k = 1")
    exact = first.join(last, ["class_name", "method_name"]).select("proposal", "chunk_id")
    left_p = proposed.join(exact, "proposal", "left_anti").withColumn("k", nth(["method_name"], "proposal"))
    left_o = originals.join(exact, "chunk_id", "left_anti").withColumn("k", nth(["method_name"], "chunk_id"))
    return exact.union(left_p.join(left_o, ["method_name", "k"]).select("proposal", "chunk_id"))


def cross_method(originals: DataFrame, proposed: DataFrame) -> dict[str, DataFrame]:
    """Diffs of matched methods, deleted originals, added visible methods, lost overrides. Rows are parsed methods."""
    pairs = match(originals, proposed)
    pack = lambda df, side, key: df.select(key, F.struct(*PARSED).alias(side))
    both = pairs.join(pack(originals, "old", "chunk_id"), "chunk_id").join(pack(proposed, "new", "proposal"), "proposal")
    diffs = diff(both)
    lost = both.where(has_override(F.col("old.annotations")) & ~has_override(F.col("new.annotations")) & ~F.coalesce(F.col("new.parse_error"), F.lit(False)))
    names = originals.select("chunk_id", "class_name", "method_name")
    return {
        "diffs": diffs,
        "deleted": originals.join(pairs, "chunk_id", "left_anti").select("chunk_id", "class_name", "method_name", "visibility"),
        "added": proposed.join(pairs, "proposal", "left_anti").where(F.col("visibility").isin("public", "protected")).select("class_name", "method_name", "visibility"),
        "lost_overrides": lost.select("chunk_id").join(names, "chunk_id").select("class_name", "method_name"),
    }


def violates(parts: dict[str, DataFrame]) -> DataFrame:
    """One row (violation): a lost override, an added visible method, a deleted visible one, or a changed visible signature."""
    visible = lambda c: F.col(c).isin("public", "protected")
    marks = [
        parts["lost_overrides"].select(F.lit(1).alias("x")), parts["added"].select(F.lit(1).alias("x")), parts["deleted"].where(visible("visibility")).select(F.lit(1).alias("x")),
        parts["diffs"].where(F.col("signature_changed") & visible("old_visibility")).select(F.lit(1).alias("x")),
    ]
    found = marks[0]
    for m in marks[1:]:
        found = found.union(m)
    return found.agg((F.count("*") > 0).alias("violation"))


def loop_safety(scored: DataFrame, violation: DataFrame) -> DataFrame:
    """The least safety of all methods (1 without any), at most 0.3 on a violation."""
    least = scored.agg(F.coalesce(F.min("safety"), F.lit(1.0)).alias("s"))
    return least.join(F.broadcast(violation)).select(F.when(F.col("violation"), F.least("s", F.lit(0.3))).otherwise(F.col("s")).alias("safety"))
