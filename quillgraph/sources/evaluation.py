"""Evaluation inputs: fixtures, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FIXTURES, RUNS


def _normal(fixtures: DataFrame) -> DataFrame:
    """Missing lists and structs count as empty."""
    none = F.array().cast("array<string>")
    gold = F.struct(F.col("gold.anchor").alias("anchor"), F.coalesce("gold.relevant", none).alias("relevant"))
    expected = F.struct(F.col("expected.analyzer").alias("analyzer"), F.col("expected.compile").alias("compile"), F.coalesce("expected.tests", none).alias("tests"))
    return fixtures.withColumns({"gold": gold, "expected": expected, "tags": F.coalesce("tags", none)})


def fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """All *.json of a folder, with the file's name to sort by."""
    read = spark.read.schema(FIXTURES).option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder)
    return _normal(read).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).orderBy("file")


def listed_fixtures(spark: SparkSession, index: str) -> DataFrame:
    """The files that an index names, beside it; blank lines and lines that begin with # are skipped. An index is a small text."""
    lines = [r[0].strip() for r in spark.read.text(index).collect()]
    names = [x for x in lines if x and not x.startswith("#")]
    base = index.rsplit("/", 1)[0]
    if not names:
        return _normal(spark.createDataFrame([], FIXTURES)).withColumn("file", F.lit(None).cast("string"))
    read = spark.read.schema(FIXTURES).option("multiLine", "true").json([f"{base}/{n}" for n in names])
    return _normal(read).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def runs(spark: SparkSession, path: str) -> DataFrame:
    """A run log, one JSON object a line; blank lines are skipped; of equal ids the last one counts: that of the largest sequence where
    the log has one, else the last in the file."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.monotonically_increasing_id().alias("place"))
    parsed = lines.select("place", F.from_json("value", RUNS + ", sequence BIGINT").alias("r"))
    return parsed.groupBy(F.col("r.fixtureId").alias("fixtureId")).agg(F.max_by("r", F.struct("r.sequence", "place")).alias("r")).select("r.*").drop("sequence")


def metrics(runs: DataFrame) -> DataFrame:
    """(fixture_id, name, value, status, note)."""
    return runs.select(F.col("fixtureId").alias("fixture_id"), F.explode("metrics").alias("m")).select("fixture_id", "m.*")
