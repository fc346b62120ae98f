"""Connected components of a table of links, by alternating large-star and small-star steps in tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, saved, ship

SALTS = 16


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours. The centre of a large star has a third of all links: they are dealt by salts,
    minima are taken by salt first, and only salts that a node has get the minimum of all."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    part = salted.groupBy("u", "salt").agg(F.min("v").alias("part"))
    least = part.groupBy("u").agg(F.min("part").alias("least"))
    return salted.join(part.select("u", "salt").join(least, "u"), ["u", "salt"]).select("u", "v", F.least("u", "least").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _min_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")


def _contracted(frames):
    """Links of a batch as stars around the least node that they reach inside it."""
    for pdf in frames:
        nodes, place = np.unique(np.r_[pdf["u"].to_numpy(), pdf["v"].to_numpy()], return_inverse=True)
        a, b, root = place[: len(pdf)], place[len(pdf) :], np.arange(len(nodes))
        while True:
            before = root.copy()
            np.minimum.at(root, a, root[b])
            np.minimum.at(root, b, root[a])
            root = root[root]
            if (root == before).all():
                break
        keep = root != np.arange(len(nodes))
        yield pd.DataFrame({"u": nodes[keep], "v": nodes[root[keep]]})


def _small_star(edges: DataFrame) -> DataFrame:
    """Every u has smaller neighbours only; they and u are hung on the least of them."""
    seen = _min_neighbour(edges)
    return seen.select(F.col("v").alias("u"), F.col("m").alias("v")).union(seen.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; the component is the smallest node that links reach.

    Null ends and loops are no links; repeated links count once. Links are first
    contracted batch by batch; each round then writes a table in the shared folder.
    """
    ship(links.sparkSession)
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u > v")
    edges, before = saved(edges.mapInPandas(_contracted, "u long, v long").distinct(), "links"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, last = now, edges
        edges = saved(_small_star(_large_star(edges)), "links")
        discard(last)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
