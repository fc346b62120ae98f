"""The query API that an agent calls (U3, U4), edit plans (U5) and prompts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import verdicts as V
from ..operators import graph, lookup, retrieval
from ..schema import EDIT_OPS

#: Response schemas as DDL.
RESPONSE_SCHEMAS = {
    "safety_verdict": "confidence DOUBLE, verdict STRING, risks ARRAY<STRUCT<description: STRING, severity: STRING, mitigation: STRING>>, needs ARRAY<STRING>, feedback STRING",
    "refactor": "code_blocks ARRAY<STRUCT<`class`: STRING, method: STRING, code: STRING>>, explanation STRING, breaking_changes ARRAY<STRING>, missing_references ARRAY<STRING>",
    "analysis": "dependencies ARRAY<STRING>, impact STRING, missing_references ARRAY<STRING>",
    "safety_check": "explanation STRING, breaking_changes ARRAY<STRING>",
    "patch_plan": f"ops ARRAY<STRUCT<{', '.join(p.replace(' ', ': ', 1) for p in EDIT_OPS.split(', '))}>>, rationale STRING",
    "self_review": "assumptions ARRAY<STRUCT<assumption: STRING, why: STRING, risk: STRING, needs: ARRAY<STRING>>>, summary STRING",
}


@dataclass
class Tools:
    """All calls give tables; ids are resolved by J2."""

    chunks: DataFrame
    classes: DataFrame
    fields: DataFrame
    edges: DataFrame
    embeddings: DataFrame
    embed: object = None
    chat: object = None
    config: Config = field(default_factory=Config)

    def _ids(self, identifier: str) -> DataFrame:
        asked = self.chunks.sparkSession.createDataFrame([(identifier,)], "identifier string")
        return lookup.find_methods(self.chunks, asked, dotted=True).select("chunk_id")

    def _one(self, identifier: str) -> str | None:
        row = self._ids(identifier).first()
        return row[0] if row else None

    def _anchors(self, identifier: str) -> DataFrame:
        return self._ids(identifier).withColumnRenamed("chunk_id", "anchor")

    def retrieve_code(self, query: str, top_k: int | None = None) -> DataFrame:
        asked = self.chunks.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
        row = lookup.query_anchor(self.chunks, asked).first()
        found = retrieval.retrieve(self.chunks, self.embeddings, self.edges, self.embed(query), row["chunk_id"] if row else None, top_k, self.config)
        return found.join(self.chunks, "chunk_id").orderBy("position")

    def retrieve_code_by_id(self, identifier: str, depth: int = 1, most: int = 10) -> DataFrame:
        return graph.neighbourhood(self.edges, self._anchors(identifier), self.chunks, depth, most).join(self.chunks, F.col("node") == F.col("chunk_id"))

    def method_callers(self, identifier: str) -> DataFrame:
        return graph.callers(self.edges, self._one(identifier) or "")

    def method_callees(self, identifier: str) -> DataFrame:
        return graph.callees(self.edges, self._one(identifier) or "")

    def call_path(self, source: str, target: str, hops: int = 6) -> DataFrame:
        return graph.path_or_undirected(self.edges, self._one(source) or "", self._one(target) or "", hops, self.config.max_paths)

    def trace_call_chain(self, identifier: str, depth: int = 2, callers: bool = False) -> DataFrame:
        return graph.call_chain(self.edges, self._anchors(identifier), depth, callers)

    def subgraph_topology(self, identifier: str, depth: int = 2) -> DataFrame:
        return graph.neighbourhood_topology(self.edges, self._anchors(identifier), self.chunks, depth, self.config.max_topology_edges)

    def class_overview(self, identifier: str) -> DataFrame:
        asked = self.chunks.sparkSession.createDataFrame([(identifier,)], "identifier string")
        row = lookup.find_classes(self.classes, asked).first()
        return lookup.class_overview(self.classes, self.fields, self.chunks, row["fq_name"] if row else "")

    def expand_node(self, identifier: str) -> DataFrame:
        return graph.neighbours(self.edges, self._one(identifier) or "", graph.NEIGHBOUR_TYPES)

    def self_review(self, code: str) -> str:
        return self.chat("self_review", code)

    def self_review_context(self, needs: list[str], have: DataFrame, anchor: str) -> DataFrame:
        asked = self.chunks.sparkSession.createDataFrame([(n,) for n in needs], "identifier string")
        near = graph.expand(self.edges, self._anchors(anchor), graph.MAX_EXPANSION, self.chunks)
        return lookup.missing_context(self.chunks, self.edges, asked, have, near)

    def refactor_code(self, task: str, context: str) -> str:
        """U4: the generator stands behind `chat`."""
        return self.chat("refactor", f"{context}\n\nTask: {task}")


@dataclass
class EditPlan:
    """Operations are collected, then committed through a gate and an applier, or discarded."""

    ops: list[dict] = field(default_factory=list)

    def _stage(self, kind: str, **values: str) -> EditPlan:
        self.ops.append({"kind": kind, **values})
        return self

    def replace_method(self, fq_class_name: str, method_name: str, original_signature: str, new_code: str) -> EditPlan:
        return self._stage("replace_method", fq_class_name=fq_class_name, method_name=method_name, original_signature=original_signature, new_code=new_code)

    def add_method(self, fq_class_name: str, new_code: str) -> EditPlan:
        return self._stage("add_method", fq_class_name=fq_class_name, new_code=new_code)

    def delete_method(self, fq_class_name: str, method_name: str, original_signature: str = "") -> EditPlan:
        return self._stage("delete_method", fq_class_name=fq_class_name, method_name=method_name, original_signature=original_signature)

    def add_import(self, file_path: str, import_decl: str) -> EditPlan:
        return self._stage("add_import", file_path=file_path, import_decl=import_decl)

    def create_file(self, rel_path: str, content: str) -> EditPlan:
        return self._stage("create_file", rel_path=rel_path, content=content)

    def commit(self, applier, gate=None):
        """gate: allow(ops) -> bool, U6."""
        if gate is not None and not gate(self.ops):
            return None
        done = applier.apply(self.ops)
        if done.ok:
            self.ops = []
        return done

    def discard(self) -> None:
        self.ops = []

    def table(self, spark) -> DataFrame:
        names = [c.split(" ")[0] for c in EDIT_OPS.split(", ")]
        return spark.createDataFrame([tuple(o.get(n) for n in names) for o in self.ops], EDIT_OPS)


def plan_from_response(responses: DataFrame, chunks: DataFrame) -> DataFrame:
    """(response_id, op): the ops of a response, else its code blocks as replacements of methods that J2 finds."""
    r = F.col("response")
    listed = responses.select("response_id", F.explode(V.edit_ops(r)).alias("op")).select("response_id", "op.*")
    rest = responses.join(listed.select("response_id").distinct(), "response_id", "left_anti")
    blocks = rest.select("response_id", F.posexplode(V.code_blocks(r)).alias("place", "b")).select("response_id", "place", F.when(F.col("b.class") != "", F.concat("b.class", F.lit("#"), "b.method")).otherwise(F.col("b.method")).alias("identifier"), F.col("b.code").alias("new_code"))
    found = lookup.find_methods(chunks, blocks)
    own = blocks.join(found, "identifier").join(chunks.select("chunk_id", "fq_class_name", "method_name", "method_signature"), "chunk_id")
    none = lambda n: F.lit(None).cast("string").alias(n)
    made = own.select("response_id", F.lit("replace_method").alias("kind"), "fq_class_name", "method_name", F.col("method_signature").alias("original_signature"), "new_code", none("file_path"), none("import_decl"), none("rel_path"), none("content"))
    return listed.unionByName(made)


def prompt_text(system: str, context: str, query: str, schema: str) -> str:
    """A prompt that asks for one of RESPONSE_SCHEMAS."""
    return f"{system}\n\n{context}\n\nTask: {query}\n\nAnswer with one JSON object of these fields: {RESPONSE_SCHEMAS[schema]}"
