"""Prompts of five kinds for a table of requests, in one plan.

refactor and patch show code and relations, analysis signatures with calls and callers, safety_check and self_review the proposed
changes: the one with a report of facts and the callers, the other with code. All end with the fields of the answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_name

MAX_CHUNKS = 10
#: Kind of a prompt: what is asked beside the task.
ASKS = {
    "refactor": "Change the code as the task says and nothing else. Name what you miss.",
    "patch": "Give the change as edits. Each edit has all fields, unused ones empty.",
    "analysis": "Change nothing yet. Say what depends on this code and what a change reaches.",
    "safety_check": "List what the proposed changes may break, with severity and mitigation.",
    "self_review": "List what the proposed changes assume without having seen it.",
}
_SHOWN = {"code": ("refactor", "patch", "self_review"), "relations": ("refactor", "patch"), "signatures": ("analysis",), "callers": ("safety_check",), "changes": ("safety_check", "self_review"), "report": ("safety_check",)}
RELATIONS = "Relations:\n"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _if(condition: Column, *pieces) -> Column:
    return F.when(condition, F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in pieces))).otherwise(F.lit(""))


def _names(ids: str) -> Column:
    return F.transform(F.coalesce(F.col(ids), F.array().cast("array<string>")), short_name)


def _chunk_texts() -> list[Column]:
    """What each form of a prompt shows of a chunk; empty if nothing."""
    name, calls, callers = F.concat(_text("class_name"), F.lit("."), _text("method_name")), _names("calls"), _names("called_by")
    title = F.concat(F.lit("["), name, F.when(F.col("is_anchor"), " (target)").otherwise(""), F.lit("]\n"))
    signature = F.concat(F.lit("Signature: "), _text("method_signature"), F.lit("\n"))
    marks = _if(F.coalesce(F.size("method_annotations"), F.lit(0)) > 0, "Annotations: ", F.array_join("method_annotations", ", "), "\n")
    body = F.when(F.col("topology_only"), "(body left out)\n\n").otherwise(F.concat(F.lit("```java\n"), _text("code"), F.lit("\n```\n\n")))
    line = lambda verb, others: F.array_join(F.transform(others, lambda o: F.concat(F.lit("- "), name, F.lit(f" {verb} "), o, F.lit("\n"))), "")
    listed = lambda label, others: _if(F.size(others) > 0, label, F.array_join(others, ", "), "\n")
    return [
        F.concat(title, F.lit("File: "), _text("file_path"), F.lit("\n"), signature, marks, body).alias("code"),
        F.concat(line("calls", calls), line("is called by", callers)).alias("relations"),
        F.concat(title, signature, listed("Calls: ", calls), listed("Called by: ", callers), F.lit("\n")).alias("signatures"),
        _if(F.size(callers) > 0, "- ", name, " is called by ", F.array_join(callers, ", "), "\n").alias("callers"),
    ]


def build(requests: DataFrame, chosen: DataFrame, chunks: DataFrame, schemas: dict[str, str], most: int = MAX_CHUNKS) -> DataFrame:
    """requests (request_id, kind, task, changes, report) with a prompt.

    chosen: (request_id, chunk_id, position, is_anchor, topology_only); of a request the `most` first positions, from 0, are shown, so its
    group is bounded. A request with none has no context; a kind that is not one of ASKS gets a null prompt; null texts are empty.
    """
    own = chosen.where(F.col("position") < most).join(chunks, "chunk_id")
    parts = [c.alias(n) for n, c in zip(("code", "relations", "signatures", "callers"), _chunk_texts(), strict=True)]
    told = own.select("request_id", F.struct("position", "chunk_id", *parts).alias("part")).groupBy("request_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    joined = lambda n: F.coalesce(F.array_join(F.transform("parts", lambda p: p[n]), ""), F.lit(""))
    shows = lambda what: F.col("kind").isin(*_SHOWN[what])
    relations = F.when(joined("relations") == "", "- none\n").otherwise(joined("relations"))
    choice = lambda of: F.element_at(F.create_map(*(F.lit(x) for pair in of.items() for x in pair)), F.col("kind"))
    prompt = F.concat(
        F.lit("Task:\n"), _text("task"), F.lit("\n\n"), choice(ASKS), F.lit("\n\n"),
        _if(shows("changes"), "Proposed changes:\n", _text("changes"), "\n\n"), _if(shows("report") & (_text("report") != ""), "Facts, found by parsing:\n", _text("report"), "\n\n"),
        _if(shows("code"), joined("code")), _if(shows("signatures"), joined("signatures")), _if(shows("callers"), "Callers:\n", joined("callers"), "\n"), _if(shows("relations"), RELATIONS, relations, "\n"),
        F.lit("Answer with one JSON object of these fields: "), choice({k: schemas["safety_check" if k == "safety_check" else "patch_plan" if k == "patch" else k] for k in ASKS}),
    )
    return requests.join(told, "request_id", "left").withColumn("prompt", prompt).drop("parts")
