"""Operator 11, exact dedup by a tree-merge of sorted digest runs.

  digest   every row's normalised text becomes a SHA-256 and a length in bytes; only they, the id and a row number go on, texts are read once;
  runs     each task sorts its rows by digest and folds equal ones to one entry: the identifier that stays, and how many rows it stands for;
  rounds   the tasks are nodes whose number has digits of a base up to FAN. In round r the nodes that differ in digit r alone exchange their
           runs: an entry goes to the node whose digit r is that of its digest. Each node sorts the FAN runs that it gets into one and folds
           again. After the last round a node's number is the digest's, so equal digests have met, and no task ever held more than its share
           of the digest space (a binomial tree with its root in one task would hold all of it);
  down     groups of several rows go back to the entries of the first runs, and from there to the rows.
An entry is folded into another only if all 256 bits and the lengths agree: the few bits that choose nodes decide nothing. A text that a
third of all rows share is one entry of each task and salt after the first fold, so it never meets in one task, up or down.

Edge cases: a null text counts as empty, so null and empty texts are one group; only A to Z are lower-cased; a null id is smaller than all
others, so it stays only where the group has no other; of rows that repeat the id that stays, one stays (the last by row number); the
largest id stays, or the smallest with largest=False; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import saved, ship, shuffle_width

#: Runs that a node merges in one round, at most; parts of a task's first run, so that rows of one digest go back by several ways.
FAN, SALTS = 16, 16


def normalised(text: Column) -> Column:
    """A to Z lower-cased, all else as it is; null is empty. Texts of ASCII alone take the quick way."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.length(whole) == F.octet_length(whole), F.lower(whole)).otherwise(F.translate(whole, string.ascii_uppercase, string.ascii_lowercase))


def radix(width: int, fan: int = FAN) -> tuple[int, int]:
    """(base, rounds) with base ** rounds nodes, at least `width`, and base at most `fan`."""
    rounds = 1
    while fan**rounds < width:
        rounds += 1
    base = max(2, round(width ** (1 / rounds)))
    while base**rounds < width:
        base += 1
    return base, rounds


def _folded(batches):
    """One entry for each run of equal (digest, size, node, salt) in sorted batches: its last id and row, and the sum of n. A run may go on over
    any number of batches, so the last entry waits."""
    wait = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if wait is not None:
            batch = pa.Table.from_batches([wait, batch]).combine_chunks().to_batches()[0]
        digest = batch.column("digest")
        words = np.frombuffer(digest.buffers()[2], dtype=np.uint8)[digest_start(digest) :][: 32 * len(digest)].view(np.uint64).reshape(-1, 4)
        new = (words[1:] != words[:-1]).any(axis=1)
        for name in ("size", "node", "salt"):
            value = batch.column(name).to_numpy()
            new |= value[1:] != value[:-1]
        first = np.r_[0, np.flatnonzero(new) + 1]
        last = np.r_[first[1:] - 1, len(words) - 1]
        out = batch.take(pa.array(last))
        n = pa.array(np.add.reduceat(batch.column("n").to_numpy(), first))
        out = pa.RecordBatch.from_arrays([n if name == "n" else out.column(name) for name in out.schema.names], schema=out.schema)
        if len(first) > 1:
            yield out.slice(0, len(first) - 1)
        wait = out.slice(len(first) - 1)
    if wait is not None:
        yield wait


def digest_start(digest: pa.Array) -> int:
    """The byte at which a binary array's values begin."""
    width = 8 if pa.types.is_large_binary(digest.type) else 4
    at = digest.offset * width
    return int.from_bytes(digest.buffers()[1].to_pybytes()[at : at + width], "little")


def _fold(runs: DataFrame, largest: bool) -> DataFrame:
    """Sorts what a task has and folds it; nothing is shuffled."""
    order = [F.col("id").asc_nulls_first() if largest else F.col("id").desc_nulls_first(), F.col("row")]
    return runs.sortWithinPartitions("digest", "size", "node", "salt", *order).mapInArrow(_folded, runs.schema)


def entries(docs: DataFrame, id: str = "doc_id", text: str = "text", largest: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, runs, groups): each row with its digest; the entries of the first runs; one entry for each digest of all."""
    spark = docs.sparkSession
    ship(spark)
    base, rounds = radix(shuffle_width(spark))
    clean = normalised(F.col(f"`{text}`"))
    made = docs.select(F.col(f"`{id}`").cast("long").alias("id"), clean.alias("clean")).select(
        "id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2("clean", 256)).alias("digest"), F.octet_length("clean").cast("long").alias("size"),
        F.pmod(F.spark_partition_id(), F.lit(base**rounds)).alias("node"))
    rows = saved(made.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")), "digests")
    runs = saved(_fold(rows.withColumn("n", F.lit(1).cast("long")).select("node", "salt", "digest", "size", "id", "row", "n"), largest), "runs")
    # 60 bits of the digest, of which each round takes a digit
    head = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")
    level = runs.withColumn("salt", F.lit(0))
    for r in range(rounds):
        place = base**r
        digit = lambda value: F.pmod(F.floor(value / F.lit(place)), F.lit(base))  # noqa: B023, E731
        to = F.col("node") + (digit(F.pmod(head, F.lit(base**rounds))) - digit(F.col("node"))) * F.lit(place)
        level = _fold(level.withColumn("node", to.cast("int")).repartitionById(base**rounds, "node"), largest)
    return rows, runs, level


def apply(docs: DataFrame, id: str = "doc_id", text: str = "text", largest: bool = True) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row."""
    rows, runs, groups = entries(docs, id, text, largest)
    several = groups.where("n > 1").select("digest", "size", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"))
    # every entry of a first run is one row here, so a digest meets as many rows as there are tasks and salts
    down = runs.select("node", "salt", "digest", "size").distinct().join(several, ["digest", "size"])
    told = rows.join(down.hint("merge"), ["node", "salt", "digest", "size"], "left")
    alone = F.col("group_size").isNull()
    return told.select(
        F.col("id").alias(id), F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
