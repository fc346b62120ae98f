"""Operator 5, quality classifier by importance resampling.

Hashed uni- and bigrams of words and punctuation give two generative models: of the labelled good texts (a bounded sample) and of
all raw texts. A document's log-weight is the sum of the log-ratios of its n-grams; Gumbel noise on it and a cut at the k-th largest
draw k documents without replacement, in proportion to their weights. Two parameters temper this: `even`, if given, is the number of
n-grams that every document is weighed as having (the mean ratio counts `even` times), so that long documents don't outweigh short
ones; the smaller it is, the more the draw is by chance: at EVEN the noise decides on 2 to 3 of 100 documents, which stand near the cut,
and 99 of 100 labelled good ones are drawn. `k` is the number of documents; if it isn't given, as many are drawn as are
at least as near the target as a threshold that separates the labelled sample best.

Edge cases: null, empty and blank texts have no n-grams, a null ratio, and are rejected; without good labelled rows all ratios
are 0 and every text with n-grams is kept; without bad ones the threshold is the target's lowest percentile; ties at the cut all
stay; repeated rows get equal scores; an empty table gives no rows; clashing names don't matter, only the named columns are read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import kth_largest, saved, ship

BUCKETS, EVEN, SMOOTH, SEED = 1 << 15, 20.0, 1.0, 17
#: Labelled rows at most that fit the target and the threshold.
SAMPLE = 20_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Memory(dict):
    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) >= 150_000:
            self.clear()
        code = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        self[token] = code
        return code


_memory = _Memory()


def features(text: str | None) -> np.ndarray:
    """Buckets of the text's uni- and bigrams."""
    tokens = _TOKEN.findall(text or "")
    h = np.fromiter(map(_memory.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
    both = np.concatenate([h, pairs])
    both = (both ^ (both >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (both >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _counts(frames):
    raw, good = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for pdf in frames:
        for text, is_good in zip(pdf["text"], pdf["good"], strict=True):
            n = np.bincount(features(text), minlength=BUCKETS)
            raw += n
            if is_good:
                good += n
    at = np.flatnonzero(raw)
    yield pd.DataFrame({"bucket": at, "raw": raw[at], "good": good[at]})


class Model:
    """Log-ratios of the buckets, the threshold and the k-th largest score."""

    def __init__(self, ratios: np.ndarray, even: float | None = EVEN):
        self.ratios, self.even, self.threshold, self.cut = ratios, even, None, None

    def ratio(self, text: Column) -> Column:
        """(mean, n): mean log-ratio of a text's n-grams, null if it has none, and their number."""
        ratios = self.ratios

        def mean(texts: pd.Series) -> pd.DataFrame:
            out, n = np.full(len(texts), np.nan), np.zeros(len(texts), dtype=np.int64)
            for i, t in enumerate(texts):
                f = features(t)
                if len(f):
                    out[i], n[i] = ratios[f].mean(), len(f)
            return pd.DataFrame({"mean": out, "n": n})

        return F.pandas_udf(mean, "mean double, n long")(text)

    def score(self, ratio: Column, n: Column, id: Column, seed: int = SEED) -> Column:
        """The weight's logarithm with Gumbel noise; null without n-grams."""
        u = (F.shiftrightunsigned(F.xxhash64(id, F.lit(seed)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
        weight = ratio * (n if self.even is None else F.lit(float(self.even)))
        return F.when(n > 0, weight - F.log(-F.log(u)))

    def keeps(self, score: Column) -> Column:
        return F.coalesce(score >= F.lit(self.cut), F.lit(False)) if self.cut is not None else F.lit(False)


def _labelled(labels: DataFrame, sample: int) -> DataFrame:
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return F.broadcast(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("l_id"), (F.col("quality") > 0).alias("good")))


def _threshold(rows: list[tuple[float, bool]]) -> float:
    """Parts good from bad with the best mean of the two rates; in the middle of the gap."""
    good, bad = (np.sort([r for r, g in rows if g is want]) for want in (True, False))
    if not len(good):
        return -np.inf
    if not len(bad):
        return float(np.percentile(good, 1))
    values = np.unique(np.r_[good, bad])
    cuts = np.r_[values[0] - 1, (values[1:] + values[:-1]) / 2]
    rates = (len(good) - np.searchsorted(good, cuts)) / len(good) + np.searchsorted(bad, cuts) / len(bad)
    best = cuts[rates >= rates.max() - 1e-12]
    return float(best[len(best) // 2])


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE, k: int | None = None, even: float | None = EVEN) -> tuple[Model, DataFrame]:
    """The model, and (id, log_ratio, score) of every row."""
    ship(docs.sparkSession)
    known = _labelled(labels, sample)
    source = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    marked = source.join(known, source["id"] == known["l_id"], "left")
    rows = marked.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInPandas(_counts, "bucket long, raw long, good long")
    counts = rows.groupBy("bucket").agg(F.sum("raw"), F.sum("good")).collect()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, g in counts:
        raw[b], good[b] = r, g
    if not good.any():
        good = raw
    smooth = lambda n: np.log((n + SMOOTH) / (n.sum() + SMOOTH * BUCKETS))
    model = Model(smooth(good) - smooth(raw), even)
    ratio = marked.select("id", "good", model.ratio(F.col("text")).alias("r")).select("id", "good", F.when(F.col("r.n") > 0, F.col("r.mean")).alias("log_ratio"), F.col("r.n").alias("n"))
    scored = saved(ratio, "ratios").withColumn("score", model.score(F.col("log_ratio"), F.col("n"), F.col("id")))
    model.threshold = _threshold([(r, bool(g)) for r, g in scored.where("good is not null and log_ratio is not null").select("log_ratio", "good").limit(2 * sample).collect()])
    k = scored.where(F.col("log_ratio") >= F.lit(model.threshold)).count() if k is None else k
    model.cut = kth_largest(scored, "score", k)
    return model, scored.drop("good", "n")


def apply(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE, k: int | None = None, even: float | None = EVEN) -> DataFrame:
    """(id, log_ratio, score, kept) of every row. even: None for plain sums."""
    model, scored = fit(docs, labels, id, text, sample, k, even)
    return scored.select(F.col("id").alias(id), "log_ratio", "score", model.keeps(F.col("score")).alias("kept"))


def select(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE, k: int | None = None, even: float | None = EVEN) -> DataFrame:
    """The rows of docs that are kept, as they are. Scores are computed again, so that no text is shuffled."""
    model, _ = fit(docs, labels, id, text, sample, k, even)
    weighed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), model.ratio(F.col(f"`{text}`")).alias("r"))
    return weighed.where(model.keeps(model.score(F.col("r.mean"), F.col("r.n"), F.col(f"row.`{id}`").cast("long")))).select("row.*")
