"""Sinks: the graph tables, exports, reports, and edits of source files."""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import prompt
from ..operators.delta import upsert

#: Key of each table; a key occurs once.
KEYS = {"packages": ("name",), "classes": ("fq_name",), "fields": ("fq_name",), "chunks": ("chunk_id",), "embeddings": ("chunk_id",), "edges": ("edge_type", "src", "dst")}
RECORDS = 500_000
RULE = "═" * 72


class GraphStore:
    """Parquet tables in one folder; edges are partitioned by edge_type. A batch writes new versions of its tables and then one
    manifest, under the next number, that names the versions of all tables: the batch is in or not, whatever fails in between.
    Manifests are never changed or replaced; readers take the last one. Versions stay until vacuum(), so that running readers and tasks
    that are computed again still find their files. There is one writer at a time: of two with the same number the second fails."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, pattern: str) -> list[str]:
        path = self._path(f"{self.folder}/{pattern}")
        return [f.getPath().getName() for f in self._fs(path).globStatus(path) or []]

    def manifests(self) -> list[int]:
        return sorted(int(n.rsplit("-", 1)[1]) for n in self._listed("MANIFEST-*") if n.rsplit("-", 1)[1].isdigit())

    def versions(self, number: int | None = None) -> dict[str, str]:
        """The version of each table in a manifest, the last one by default; none without any."""
        numbers = self.manifests()
        if not numbers:
            return {}
        return json.loads(self.spark.read.text(f"{self.folder}/MANIFEST-{numbers[-1] if number is None else number:020d}").first()[0])

    def exists(self, name: str) -> bool:
        return name in self.versions()

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/{self.versions()[name]}")

    def replace(self, tables: dict[str, DataFrame]) -> None:
        """K6, K8, K9: writes versions of the tables and commits them together. Rows of one key are reduced to one."""
        before, now = self.manifests(), self.versions()
        for name, df in tables.items():
            now[name] = f"v-{uuid.uuid4().hex}"
            writer = df.dropDuplicates(list(KEYS[name])).write.option("maxRecordsPerFile", RECORDS)
            (writer.partitionBy("edge_type") if name == "edges" else writer).parquet(f"{self.folder}/{name}/{now[name]}")
        self._commit(before[-1] + 1 if before else 1, now)

    def _commit(self, number: int, versions: dict[str, str]) -> None:
        new, last = self._path(f"{self.folder}/.{uuid.uuid4().hex}"), self._path(f"{self.folder}/MANIFEST-{number:020d}")
        fs = self._fs(last)
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(versions).encode()))
        out.close()
        if fs.exists(last) or not fs.rename(new, last):
            fs.delete(new, False)
            raise RuntimeError(f"another writer has committed batch {number}")

    def overwrite(self, name: str, df: DataFrame) -> None:
        self.replace({name: df})

    def merged(self, name: str, df: DataFrame) -> DataFrame:
        """K4, K5, K7: the stored rows with those of df in place of equal keys."""
        return upsert(self.read(name), df, *KEYS[name]) if self.exists(name) else df

    def merge(self, name: str, df: DataFrame) -> None:
        self.replace({name: self.merged(name, df)})

    def vacuum(self, keep: int = 2) -> None:
        """Deletes manifests but the last `keep`, and versions that none of these names. For times without readers of older ones."""
        numbers = self.manifests()
        used = {(name, v) for n in numbers[-keep:] for name, v in self.versions(n).items()}
        for n in numbers[:-keep]:
            path = self._path(f"{self.folder}/MANIFEST-{n:020d}")
            self._fs(path).delete(path, False)
        for name in KEYS:
            for v in self._listed(f"{name}/v-*"):
                if (name, v) not in used:
                    path = self._path(f"{self.folder}/{name}/{v}")
                    self._fs(path).delete(path, True)

    def clean(self) -> None:
        """K8."""
        path = self._path(self.folder)
        self._fs(path).delete(path, True)

    def violations(self, name: str) -> DataFrame:
        """K9: keys that occur more than once."""
        return self.read(name).groupBy(*KEYS[name]).count().where("count > 1")


def embed(chunks: DataFrame, embedder) -> DataFrame:
    """(chunk_id, embedding); embedder is a factory of objects with embed_batch(list[str]) -> list[list[float]]."""
    import pandas as pd

    from ..functions.text import embedding_text
    from .tables import ship

    ship(chunks.sparkSession)

    def run(frames):
        own = embedder()
        for pdf in frames:
            out = []
            for at in range(0, len(pdf), 64):
                out += own.embed_batch(pdf["text"].iloc[at : at + 64].tolist())
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "embedding": out})

    texts = chunks.select("chunk_id", embedding_text(F.col("class_name"), F.col("method_signature"), F.col("code")).alias("text"))
    return texts.mapInPandas(run, "chunk_id string, embedding array<float>")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """K1."""
    chunks.write.mode("overwrite").json(path)


def graph_document(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """K2: one JSON text for each package (its classes and methods), then edges and totals by type."""
    methods = chunks.groupBy("package_name", "fq_class_name").agg(F.sort_array(F.collect_set("chunk_id")).alias("methods"))
    packages = methods.groupBy("package_name").agg(F.sort_array(F.collect_list(F.struct(F.col("fq_class_name").alias("class"), "methods"))).alias("classes"))
    rows = packages.select(F.lit("package").alias("kind"), F.col("package_name").alias("key"), F.to_json(F.struct(F.col("package_name").alias("package"), "classes")).alias("json"))
    links = edges.select(F.lit("edge").alias("kind"), F.concat_ws("|", "edge_type", "src", "dst").alias("key"), F.to_json(F.struct("edge_type", "src", "dst")).alias("json"))
    totals = edges.groupBy("edge_type").count().select(F.lit("total").alias("kind"), F.col("edge_type").alias("key"), F.to_json(F.struct("edge_type", "count")).alias("json"))
    return rows.union(links).union(totals)


def readable_chunks(chunks: DataFrame) -> DataFrame:
    """K3: (chunk_id, value): a rule and the prompt text."""
    return chunks.select("chunk_id", F.concat(F.lit(RULE + "\n"), prompt()).alias("value"))


def write_runs(runs: DataFrame, path: str, order: Column | None = None) -> None:
    """One JSON object a line, by as many tasks as there are. order: a whole number that tells which of two runs is the later one;
    it is written with each run, as files have no order."""
    (runs if order is None else runs.withColumn("sequence", order.cast("long"))).write.mode("overwrite").json(path)


def summary_text(rollup: DataFrame, modes: DataFrame) -> str:
    """A report of a rollup (a row for each metric name)."""
    lines = [f"{r['mode']}: {r['fixtures']} fixtures, {r['errors']} errors" for r in modes.collect()]
    for r in rollup.orderBy("name").collect():
        number = lambda x: "-" if x is None else f"{x:.4f}"
        lines.append(f"{r['name']}: pass {r['pass']}, fail {r['fail']}, error {r['error']}, not run {r['not_run']}, pass rate {number(r['pass_rate'])}, mean {number(r['mean_value'])}")
    return "\n".join(lines) + "\n"


def summary_json(rollup: DataFrame, modes: DataFrame) -> str:
    """K12."""
    by_metric = {r["name"]: {"pass": r["pass"], "fail": r["fail"], "error": r["error"], "notRun": r["not_run"], "passRate": r["pass_rate"], "meanValue": r["mean_value"]} for r in rollup.collect()}
    by_mode = {r["mode"]: {"fixtures": r["fixtures"], "errors": r["errors"]} for r in modes.collect()}
    return json.dumps({"fixtureCount": sum(m["fixtures"] for m in by_mode.values()), "byMode": by_mode, "byMetric": by_metric}, indent=2, sort_keys=True)


def diff_json(report: dict) -> str:
    """Of evaluate.diff_report."""
    return json.dumps(report, indent=2)


def write_diff(lines: DataFrame, path: str) -> None:
    """K13 of any size: of evaluate.diff_lines, as text files whose names and lines are in the report's order."""
    order = ["place", "what"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("text").write.mode("overwrite").text(path)


def diff_text(report: dict) -> str:
    """Counts, then each list under its name; empty lists are left out."""
    lines = [f"Baseline: {report['baselineFixtures']} fixtures, current: {report['currentFixtures']}, unchanged: {report['unchanged']}"]
    for name, title in (("regressions", "Regressions"), ("wins", "Wins"), ("verifierWired", "Verifiers wired"), ("anchorChanges", "Anchor changes")):
        if report[name]:
            lines += [f"{title} ({len(report[name])}):", *(f"  {x}" for x in report[name])]
    return "\n".join(lines) + "\n"


def manifest(options: dict, started: datetime, fixtures: int) -> str:
    """K14."""
    return json.dumps({"startedAt": started.astimezone(timezone.utc).isoformat(), "fixtures": fixtures, **options}, indent=2, sort_keys=True)


def run_folder(base: str, now: datetime) -> str:
    return f"{base}/{now.astimezone(timezone.utc):%Y%m%dT%H%M%SZ}"


@dataclass
class Applied:
    ok: bool = True
    dry_run: bool = False
    ops: list[dict] = field(default_factory=list)
    staged: dict[str, str] = field(default_factory=dict)
    changed: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


class PatchApplier:
    """Edits of files under a root, all staged in memory and scanned again before the first is written; one failed operation
    stops everything. New files are staged like all others. Works on the driver's file system."""

    def __init__(self, root: str, class_files: dict[str, str], dry_run: bool = False, backup: bool = True):
        self.root, self.class_files, self.dry_run, self.backup = os.path.realpath(root), class_files, dry_run, backup

    def apply(self, ops: list[dict]) -> Applied:
        out = Applied(dry_run=self.dry_run)
        if not ops:
            return self._fail(out, "empty patch plan")
        for op in ops:
            why = self._one(op, out.staged)
            out.ops.append({"kind": op.get("kind"), "ok": not why or why == "already present", "note": why})
            if why and why != "already present":
                return self._fail(out, f"{op.get('kind')}: {why}")
        from .java import ScanError, Scanner

        for path, text in out.staged.items():
            if path.endswith(".java"):
                try:
                    Scanner(text).scan()
                except (ScanError, IndexError, KeyError) as e:
                    return self._fail(out, f"{path} doesn't parse after the edits: {e}")
        for path, text in out.staged.items():
            if not self.dry_run:
                if self.backup and os.path.exists(path):
                    shutil.copyfile(path, path + ".bak")
                os.makedirs(os.path.dirname(path), exist_ok=True)
                temporary = f"{path}.{uuid.uuid4().hex}"
                with open(temporary, "w", encoding="utf-8") as f:
                    f.write(text)
                os.replace(temporary, path)
            out.changed.append(path)
        return out

    @staticmethod
    def _fail(out: Applied, why: str) -> Applied:
        out.ok, out.errors = False, [*out.errors, why]
        return out

    def _inside(self, rel: str) -> str | None:
        path = os.path.realpath(os.path.join(self.root, rel))
        return path if path.startswith(self.root + os.sep) else None

    def _text(self, path: str, staged: dict[str, str]) -> str:
        if path not in staged:
            with open(path, encoding="utf-8") as f:
                return f.read()
        return staged[path]

    def _one(self, op: dict, staged: dict[str, str]) -> str | None:
        kind = op.get("kind")
        if kind == "create_file":
            path = self._inside(op["rel_path"])
            if path is None:
                return "the target is outside the root"
            if path in staged or os.path.exists(path):
                return "the file exists"
            staged[path] = op["content"]
            return None
        if kind == "add_import":
            path = self._inside(op["file_path"])
            return "file not found" if path is None or not (path in staged or os.path.exists(path)) else self._import(path, op["import_decl"], staged)
        if kind not in ("replace_method", "add_method", "delete_method"):
            return "unknown kind"
        rel = self.class_files.get(op["fq_class_name"])
        path = self._inside(rel) if rel else None
        if path is None:
            return "class not found in graph"
        return self._method(kind, op, path, staged)

    def _import(self, path: str, declaration: str, staged: dict[str, str]) -> str | None:
        from .java import Scanner

        text, plain = self._text(path, staged), lambda d: re.sub(r"\s*;+\s*$", "", re.sub(r"^import\s+", "", d.strip()))
        scanner = Scanner(text).scan()
        if plain(declaration) in {plain(i) for i in scanner.imports}:
            return "already present"
        line = f"import {plain(declaration)};\n"
        last = max((text.index(i) + len(i) for i in scanner.imports), default=None)
        if last is None:
            m = re.search(r"^\s*package\s[^;]*;", text, re.M)
            last = m.end() if m else 0
        staged[path] = text[:last] + ("\n" if last else "") + line.rstrip("\n" if last else "") + text[last:]
        return None

    def _method(self, kind: str, op: dict, path: str, staged: dict[str, str]) -> str | None:
        from .java import ScanError, Scanner, methods_of

        text = self._text(path, staged)
        own = next((t for t in Scanner(text).scan().types if t.name == op["fq_class_name"].rsplit(".", 1)[-1]), None)
        if own is None:
            return "type declaration not found"
        if kind != "delete_method":
            try:
                if len(methods_of(op["new_code"])) != 1:
                    return "the code is no single method"
            except (ScanError, IndexError, KeyError):
                return "the code doesn't parse as a method"
        squeeze = lambda s: " ".join(s.split())
        if kind == "add_method":
            names = [m["code"] for m in own.methods]
            at = text.index(names[-1]) + len(names[-1]) if names else text.index("{", text.index(own.name)) + 1
            staged[path] = text[:at] + "\n\n    " + op["new_code"].strip() + text[at:]
            return None
        named = [m for m in own.methods if m["name"] == op["method_name"]]
        wanted = squeeze(op.get("original_signature") or "")
        found = next((m for m in named if squeeze(m["signature"]) == wanted), named[0] if len(named) == 1 or named and not wanted else None)
        if found is None:
            return "method not found"
        staged[path] = text.replace(found["code"], op["new_code"].strip() if kind == "replace_method" else "", 1)
        return None


def write_each(rows: DataFrame, path: str, text: str) -> int:
    """Writes the column `text` of each row to the file that its column `path` names, by the tasks that have the rows; gives the number of
    files. A path without a scheme is of the session's default file system, as it is for Spark's readers. A task that runs again writes the
    same files again."""
    base = rows.sparkSession.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/")

    def write(batches):
        from urllib.parse import quote

        from pyarrow import fs

        made = set()
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # a name without a scheme would be taken as it is quoted
                store, where = fs.FileSystem.from_uri(quote(name if re.match("[A-Za-z][A-Za-z0-9+.-]*:", name) else (f"{base}//{name}" if base == "file:" else base + name), safe=":/"))
                folder = where.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(where) as out:
                    out.write((body or "").encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, schema=pa.schema([("n", pa.int64())]))

    import pyarrow as pa

    return rows.select(path, text).mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
