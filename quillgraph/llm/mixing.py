"""Operator 1, mixing sources to target weights by balanced sampling with the cube method.

A source with target t and s words in all takes every document floor(t / s) times and some once more: with inclusion
probability t / s - floor(t / s), balanced on two totals, documents and words. The flight phase moves the probabilities of three
documents at a time along the null space of their two constraints until one is 0 or 1. It runs in blocks of a source (hot sources
have many), then on what the blocks left, and so on until a source is one block. There HELD documents, spread over the sizes, sit the
flight out; with the two at most that it leaves they are the landing problem, solved by trying all their subsets: of those
that miss the documents' total by less than one, the one with the least imbalance of words.

Edge cases: null text has size 0; null is a source of its own, the last; documents of size 0 take 0 words whatever is drawn; a
source without words has target 0; repeated rows are drawn one by one; an empty table gives an empty table; only the named
columns are read. The draws are seeded by the block, so reruns agree; of rows with equal id and size the text's hash decides, then
the number among equal rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import WORD, ranked, saved, ship

WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
#: Documents that one flight takes.
BLOCK = 5000
#: Documents that the landing decides besides the two that a flight leaves.
HELD = 12
_NEAR = 1e-9


def _step(p: list[float], u: list[float], rng) -> list[float]:
    """One move along u, in one of its two directions, so that the mean stays."""
    ahead = min((1 - x) / d if d > 0 else -x / d for x, d in zip(p, u, strict=True) if d)
    back = min(x / d if d > 0 else (x - 1) / d for x, d in zip(p, u, strict=True) if d)
    go = ahead if rng.random() * (ahead + back) < back else -back
    moved = [x + go * d for x, d in zip(p, u, strict=True)]
    return [0.0 if x < _NEAR else 1.0 if x > 1 - _NEAR else x for x in moved]


def fly(sizes: np.ndarray, probabilities: np.ndarray, rng, land: bool) -> np.ndarray:
    """Probabilities after the flight: all but two at most are 0 or 1, and the totals of documents and words are as before.

    land: settle the last ones too, with HELD more that sit the flight out.
    """
    p = probabilities.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    held = open_[np.unique(np.linspace(0, len(open_) - 1, min(HELD, len(open_))).astype(int))] if land and len(open_) else open_[:0]
    queue = iter(np.setdiff1d(open_, held).tolist())
    window: list[int] = []
    while True:
        while len(window) < 3 and (i := next(queue, None)) is not None:
            window.append(i)
        s = [float(sizes[i]) for i in window]
        if len(window) == 3:
            u = [s[2] - s[1], s[0] - s[2], s[1] - s[0]]
            u = u if any(u) else [1.0, -1.0, 0.0]
        elif len(window) == 2 and s[0] == s[1]:
            u = [1.0, -1.0]
        else:
            break
        for i, x in zip(window, _step([p[i] for i in window], u, rng), strict=True):
            p[i] = x
        window = [i for i in window if 0 < p[i] < 1]
    if land and (last := np.r_[held, np.array(window, dtype=int)]).size:
        subsets = np.arange(1 << len(last))[:, None] >> np.arange(len(last)) & 1
        words, docs = subsets @ sizes[last] - p[last] @ sizes[last], subsets.sum(axis=1) - p[last].sum()
        docs = np.abs(docs)
        p[last] = subsets[np.lexsort((docs, np.abs(words), docs > 1 - _NEAR))[0]]
    return p


def _flight(step: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        by = ["size", "id", "p", "tie", "key"]
        pdf = pdf.sort_values(by, ascending=[c != "size" for c in by], kind="stable", na_position="last").reset_index(drop=True)
        rng = np.random.Generator(np.random.PCG64(zlib.crc32(f"{step}|{key[0]}|{key[1]}".encode())))
        pdf["p"] = fly(pdf["size"].to_numpy(), pdf["p"].to_numpy(), rng, bool(pdf["blocks"].iloc[0] == 1))
        return pdf

    return run


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds target to (source, n, words): shares by weight, none above cap times its words. Newton steps on the water level."""
    place = F.pmod("rank", F.lit(len(weights)))
    weighed = ranked(totals, [F.col("source").isNull(), F.col("source")], "sources")
    weighed = saved(weighed.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (place + 1).cast("int"))).withColumn("most", F.col("words") * F.lit(float(cap))), "sources")
    words, w = weighed.agg(F.sum("words"), F.sum("w")).first()
    wanted = min(share, cap) * float(words or 0)
    level, full = wanted / w if w else 0.0, -1
    while True:
        over = F.col("most") <= F.col("w") * F.lit(level)
        n, held, rest = weighed.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).first()
        if n == full or rest == 0:
            break
        full, level = n, (wanted - held) / rest
    return weighed.select("source", "n", "words", F.least(F.col("most"), F.col("w") * F.lit(level)).alias("target"))


def apply(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, key: str | None = None) -> DataFrame:
    """(id, size, source_size, target, taken, source, copies) of every row; taken = size * copies.

    key: a column of unique values that tells rows of null or repeated ids apart; it comes last.
    """
    ship(docs.sparkSession)
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    told, kind = [F.col(f"`{key}`").alias("key")] if key else [], docs.select(F.col(f"`{id}`")).schema[0].dataType
    # ids go through Python as text: pandas makes doubles of longs beside a null
    sized = docs.select(F.col(f"`{id}`").cast("string").alias("id"), F.col(f"`{source}`").cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(f"`{text}`")).alias("tie"), *told)
    if not key:
        # equal rows are numbered, so that they are drawn one by one and dealt to many blocks
        equal = sized.groupBy("id", "source", "size", "tie").agg(F.count("*").alias("n"))
        sized = equal.select("id", "source", "size", "tie", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("key"))
    sized, carried = saved(sized, "sized"), ["tie", "key"]
    goals = targets(sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words")), weights, share, cap)
    goals = saved(goals.withColumnRenamed("source", "goal"), "goals")
    ratio = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0)
    whole = F.floor(ratio + _NEAR).cast("double")
    left = sized.join(goals, sized["source"].eqNullSafe(goals["goal"])).select(
        "id", "source", "size", F.col("words").alias("source_size"), "target", whole.alias("base"), F.greatest(ratio - whole, F.lit(0.0)).alias("p"), F.ceil(F.col("n") / block).cast("long").alias("blocks"), *carried)
    done, step = None, 0
    while True:
        dealt = F.pmod(F.xxhash64("id", "size", "tie", *([] if key else ["key"]), F.lit(step)), "blocks").alias("block")
        flown = saved(left.groupBy("source", dealt).applyInPandas(_flight(step), left.schema), "flown")
        fixed = flown.where("p = 0 or p = 1")
        done = fixed if done is None else done.union(fixed)
        rest = flown.where("p > 0 and p < 1")
        if rest.isEmpty():
            break
        n = rest.groupBy(F.col("source").alias("s")).agg(F.ceil(F.count("*") / block).cast("long").alias("b"))
        left = rest.join(n, rest["source"].eqNullSafe(n["s"])).select("id", "source", "size", "source_size", "target", "base", "p", F.col("b").alias("blocks"), *carried)
        step += 1
    copies = (F.col("base") + F.col("p")).cast("long")
    return done.select(F.col("id").cast(kind).alias(id), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), F.col("source").alias(source), copies.alias("copies"), *([F.col("key").alias(key)] if key else []))
