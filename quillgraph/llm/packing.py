"""Operator 2, best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

Lengths are whole numbers up to the capacity, so the fit is decided for all pieces of one length together: the driver holds a
count for each length, finds the tightest open sequences in the tree, and gives runs of equal pieces to runs of sequences. The
result is that of best-fit decreasing, piece by piece, over the whole table. What the driver holds is bounded by the capacity,
whatever the data. Each piece then finds its run by its rank among the pieces of its length; a common length is ranked in parts.

Edge cases: null and empty texts are the end id alone; only a document longer than the capacity is cut; equal lengths are ranked
by id, piece and checksum; repeated rows are packed one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import saved, ship, whole, with_long
from .tokens import encoder, groups

CAPACITY = 4096
#: Pieces of one length that one task ranks.
PART = 20_000
_BIG = 1 << 48


class Remaining:
    """Segment tree over remaining capacities: which have an open sequence, and the tightest that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, length: int) -> int | None:
        """The least capacity of at least length that is open."""
        i = length + self.leaves
        if self.count[i]:
            return length
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, first sequence, pieces a sequence, offset in it), sorted; counts: pieces of each length."""
    tree = Remaining(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(capacity_left: int, first: int, n: int) -> None:
        if capacity_left and n:
            open_.setdefault(capacity_left, []).append((first, n))
            tree.add(capacity_left, 1)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = capacity, sequences
                n = -(-left // (capacity // length))
                sequences += n
            else:
                first, n = open_[room].pop()
                tree.add(room, -1)
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:
                runs.append((length, rank, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, n - full)
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)


def _pieces(path: str, end_id: int, capacity: int):
    def run(frames):
        encode = encoder(path, end_id).encode
        for pdf in frames:
            ids, texts = pdf["id"].tolist(), pdf["text"].tolist()
            for a, b in groups(texts):
                rows = []
                for doc, data in zip(ids[a:b], encode(texts[a:b]), strict=True):
                    for at in range(0, len(data), 4 * capacity):
                        part = data[at : at + 4 * capacity]
                        rows.append((doc, at // (4 * capacity), at // 4, len(part) // 4, zlib.crc32(part)))
                yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])

    return run


def _placed(runs: np.ndarray):
    keys = runs[:, 0] * _BIG + runs[:, 1]

    def run(frames):
        for pdf in frames:
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            r = runs[np.searchsorted(keys, length * _BIG + rank, side="right") - 1]
            inside = rank - r[:, 1]
            pdf["sequence_id"] = r[:, 2] + inside // r[:, 3]
            pdf["offset"] = r[:, 4] + inside % r[:, 3] * length
            yield pdf.drop(columns=["rank"])

    return run


def apply(docs: DataFrame, tokenizer: str, end_id: int = 1, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, part: int = PART) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece. tokenizer: a file that all executors have."""
    ship(docs.sparkSession)
    source = docs.select(whole(id).alias("id"), F.col(f"`{text}`").alias("text"))
    pieces = saved(with_long(source.mapInPandas(_pieces(tokenizer, end_id, capacity), "id string, piece int, start long, length long, ids_crc32 long")), "pieces")
    counts = dict(pieces.groupBy("length").count().collect())
    runs = plan(counts, capacity)
    salts = max(1, -(-max(counts.values(), default=1) // part))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)))
    before = salted.groupBy("length", "salt").count()
    before = before.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("base"))
    out = ranked.select(whole("id").alias("id"), "piece", "start", "length", "ids_crc32", "rank").mapInPandas(_placed(runs), "id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return with_long(out).withColumnRenamed("id", id)
