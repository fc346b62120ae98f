"""The corpus pipeline: quality rules, quality classifier, near-duplicates, mixing, packing.

All stages: a null or empty text has no words, so the rules reject it; null ids stay as they are and are never joined; repeated rows
are one document for the near-duplicates, before them each is judged for itself; ties are broken as the operators say; an empty table
gives an empty table; columns beside those of documents are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import importance, mixing, order_minhash, packing, quality_rules
from quillgraph.llm.base import saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without the lines they remove; n_chars follows the text."""
    judged = quality_rules.apply(docs.select(COLUMNS)).where("kept")
    changed = F.col("n_removed_lines") > 0
    return judged.select("doc_id", F.when(changed, F.col("clean_text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.length("clean_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws. A document without words has no ratio and goes; without labels all others stay."""
    return importance.select(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id, and of its repeated rows one."""
    return order_minhash.select(docs.select(COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0, 1 or 2 times). A null source is a source; rows of null or equal ids are told apart."""
    # a key made for this stage and written: ids may be null or repeated
    keyed = saved(docs.select(F.monotonically_increasing_id().alias("key"), *COLUMNS), "keyed")
    drawn = mixing.apply(keyed.select("key", "doc_id", "text", "source"), key="key").where("copies > 0").select("key", "copies")
    # the draws grow with the data, so they are never broadcast
    return keyed.join(drawn.hint("merge"), "key").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix in sequences of at most 4096 tokens; a document taken twice is packed twice."""
    return packing.apply(docs.select("doc_id", "text"), tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", rules), ("quality classifier", classifier), ("near-duplicates", near_duplicates), ("mixing", mix), ("packing", pack),
]

#: Classifier, alignment, balanced sampling and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name.replace(" ", "-"))
    return docs
