"""Operator 6, near-duplicate vectors through a robust-pruned flat graph, verified by cosine in double precision.

Only vectors of one label are compared. Equal vectors of a label stand behind one representative (the least id). Then:
  cells   a label of over CELL representatives is parted by pivots, fitted on a bounded sample (SAMPLE rows in all, PIVOTS pivots in
          all, k-means); a vector's home is its nearest pivot, and it also joins the shard of the second nearest (overlap);
  build   each shard links its members by robust pruning (ALPHA, DEGREE), and back from the BACK nearest, so that every node can be
          reached; the adjacency lists of a vector are united: the flat graph;
  search  every representative is a query in the PROBES nearest cells and all within MARGIN of the nearest; a greedy search starts at
          the medoids of the cell and at the query itself, then expands everything in range until no more is found;
  verify  hits are counted where they are at home, so once, if their cosine is at least COSINE;
  audit   AUDIT sampled queries and as many that have links are compared with all rows; where less than RECALL of a query's links is
          found in the mean, the search is repeated over more cells; if even all cells don't suffice, without the graph, which is exact.
A cell of over SHARD members is parted by hash and a query goes to every part; queries of a cell are parted too. So a task holds a
bounded number of vectors, whatever a label or a ball of near copies holds, and no pair leaves its task: only counts and local
components do. Components of the whole come from these.

Edge cases: rows whose label is null or whose vector is null, empty, zero or has null or non-finite components link with nothing and
are their own component; vectors of different lengths don't compare; -0.0 equals 0.0; a repeated row is the same vector, so it is no
link of itself; a row with a null id links with nothing; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import saved, ship
from .components import components

COSINE, CELL, SHARD, QUERIES = 0.93, 3000, 8000, 8000
PIVOTS, SAMPLE = 8192, 32_768
PROBES, MARGIN, OVERLAP = 4, 0.1, 2
ALPHA, DEGREE, POOL, BACK = 1.2, 24, 96, 4
#: Greedy steps, nodes expanded in each, entry points, and how far below the limit the range search goes on.
STEPS, WIDTH, MEDOIDS, SLACK = 5, 8, 8, 0.04
AUDIT, RECALL, SEED = 200, 0.99, 11
#: Tasks that deal a vector shared by very many rows.
SALTS = 16


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1), dtype=np.float32)


def robust_prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, pool: int = POOL) -> list[np.ndarray]:
    """Adjacency lists of unit vectors: from its `pool` nearest each node keeps the nearest one left, and drops those that are nearer
    (by the factor alpha) to one kept than to itself."""
    n, lists = len(x), []
    if n < 2:
        return [np.zeros(0, dtype=np.int64)] * n
    pool = min(pool, n - 1)
    for at in range(0, n, 512):
        sims = x[at : at + 512] @ x.T
        rows = np.arange(len(sims))
        sims[rows, rows + at] = -2
        near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, axis=1), axis=1, kind="stable"), axis=1)
        far = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(sims, near, axis=1), 0))
        between = np.einsum("ijd,ikd->ijk", x[near], x[near])
        between = np.sqrt(np.maximum(2 - 2 * between, 0))
        alive, kept = np.ones(near.shape, dtype=bool), np.zeros(near.shape, dtype=bool)
        for j in range(pool):
            take = alive[:, j] & (kept.sum(axis=1) < degree)
            kept[take, j] = True
            alive[take] &= alpha * between[take, j] > far[take]
        lists += [near[i, kept[i]] for i in rows]
    back: list[list[int]] = [[] for _ in range(n)]
    for i, to in enumerate(lists):
        for j in to[:BACK].tolist():
            back[j].append(i)
    return [np.union1d(to, np.array(more, dtype=np.int64)) for to, more in zip(lists, back, strict=True)]


def medoids(x: np.ndarray, count: int = MEDOIDS) -> np.ndarray:
    """The members nearest to the means of `count` parts."""
    seeds = np.linspace(0, len(x) - 1, min(count, len(x))).astype(int)
    part = (x @ x[seeds].T).argmax(axis=1)
    return np.unique([i[(x[i] @ x[i].mean(axis=0)).argmax()] for k in range(len(seeds)) if len(i := np.flatnonzero(part == k))])


def search(queries: np.ndarray, own: np.ndarray, x: np.ndarray, table: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) pairs near the limit or above it. own: a query's place among the members or -1; table: padded adjacency, -1 last."""
    entry, found_q, found_m = medoids(x), [], []
    for at in range(0, len(queries), 256):
        q, self_ = queries[at : at + 256], own[at : at + 256]
        rows = np.arange(len(q))
        sims = np.full((len(q), len(x)), -2, dtype=np.float32)
        done = np.zeros(sims.shape, dtype=bool)
        sims[:, entry] = q @ x[entry].T
        here = self_ >= 0
        sims[rows[here], self_[here]] = 1

        def expand(every, nodes, q=q, sims=sims, done=done):
            done[every, nodes] = True
            step = max(1, 1_000_000 // table.shape[1])
            for a in range(0, len(every), step):
                to = table[nodes[a : a + step]]
                r = np.repeat(every[a : a + step], to.shape[1])
                to = to.ravel()
                new = to >= 0
                new[new] = sims[r[new], to[new]] < -1.5
                flat = np.unique(r[new] * len(x) + to[new])
                r, to = flat // len(x), flat % len(x)
                for k in range(0, len(r), 100_000):
                    sims[r[k : k + 100_000], to[k : k + 100_000]] = np.einsum("ij,ij->i", q[r[k : k + 100_000]], x[to[k : k + 100_000]])

        for _ in range(STEPS):
            open_ = np.where(done, np.float32(-3), sims)
            k = min(WIDTH, len(x))
            best = np.argpartition(-open_, k - 1, axis=1)[:, :k]
            ok = np.take_along_axis(open_, best, axis=1) > -1.5
            if not ok.any():
                break
            expand(np.repeat(rows, k).reshape(best.shape)[ok], best[ok])
        while len((todo := np.nonzero((sims >= cosine - SLACK) & ~done))[0]):
            expand(*todo)
        r, m = np.nonzero(sims >= cosine - 1e-3)
        found_q.append(r + at)
        found_m.append(m)
    return np.concatenate(found_q or [np.zeros(0, int)]), np.concatenate(found_m or [np.zeros(0, int)])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows, in double precision."""
    out = np.empty(len(a))
    for at in range(0, len(a), 100_000):
        x, y = a[at : at + 100_000].astype(np.float64), b[at : at + 100_000].astype(np.float64)
        out[at : at + 100_000] = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
    return out


def _roots(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each place the least id that links a-b reach."""
    root = ids.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        if (root == before).all():
            return root


def _build(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id").reset_index(drop=True)
    ids, lists = pdf["id"].to_numpy(), robust_prune(_unit(_stack(pdf["v"])))
    return pd.DataFrame({"id": ids, "to": [ids[x].tolist() for x in lists]})


def _all(queries: np.ndarray, x: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """What search gives, from every pair."""
    found = [(r + at, m) for at in range(0, len(queries), 256) for r, m in [np.nonzero(queries[at : at + 256] @ x.T >= cosine - 1e-3)]]
    return np.concatenate([r for r, _ in found]), np.concatenate([m for _, m in found])


def _searched(cosine: float, exact: bool):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        members = pdf[pdf["query"] == 0].sort_values("id").reset_index(drop=True)
        asks = pdf[pdf["query"] == 1].sort_values("id").reset_index(drop=True)
        empty = pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        if not len(members) or not len(asks):
            return empty
        ids, v, qv = members["id"].to_numpy(), _stack(members["v"]), _stack(asks["v"])
        q, m = _all(_unit(qv), _unit(v), cosine) if exact else walked(members, asks, ids, v, qv)
        ask_ids = asks["id"].to_numpy()
        ok = members["home"].to_numpy()[m] & (ask_ids[q] != ids[m])
        q, m = q[ok], m[ok]
        ok = cosines(qv[q], v[m]) >= cosine
        q, m = q[ok], m[ok]
        if not len(q):
            return empty
        links = np.bincount(q, weights=members["copies"].to_numpy()[m], minlength=len(asks)).astype(np.int64)
        every, inverse = np.unique(np.r_[ask_ids[q], ids[m]], return_inverse=True)
        root = _roots(inverse[: len(q)], inverse[len(q) :], every)
        hit = np.flatnonzero(links)
        return pd.concat([pd.DataFrame({"id": ask_ids[hit], "links": links[hit], "root": ask_ids[hit]}), pd.DataFrame({"id": every, "links": 0, "root": root})])

    def walked(members: pd.DataFrame, asks: pd.DataFrame, ids: np.ndarray, v: np.ndarray, qv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = pd.Series(np.arange(len(ids)), index=ids)
        width = max(1, max((len(t) for t in members["to"] if t is not None), default=1))
        table = np.full((len(ids), width), -1, dtype=np.int64)
        for i, to in enumerate(members["to"]):
            if to is not None and len(to):
                known = place.reindex(np.asarray(to)).dropna().to_numpy().astype(np.int64)
                table[i, : len(known)] = known
        own = place.reindex(asks["id"].to_numpy()).fillna(-1).to_numpy().astype(np.int64)
        return search(_unit(qv), own, _unit(v), table, cosine)

    return run


def fit_pivots(reps: DataFrame, sizes: list[tuple], cell: int, dims: int) -> dict:
    """{label: unit pivots} of labels with over one cell, by k-means on a bounded sample."""
    big = sorted(((n, label) for label, n in sizes if n > 2 * cell), reverse=True, key=lambda x: (x[0], str(x[1])))
    total = sum(n for n, _ in big)
    if not total:
        return {}
    share = min(1.0, SAMPLE / total)
    rate = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    sample = reps.where(rate & F.col("label").isin([label for _, label in big[:PIVOTS]])).select("label", "id", "v").orderBy(F.xxhash64("id", F.lit(SEED))).limit(2 * SAMPLE).toPandas()
    out = {}
    for label, part in sample.groupby("label"):
        x = _unit(_stack(part.sort_values("id")["v"]))
        n = next(n for n, other in big if other == label)
        count = min(len(x), max(1, min(n // cell, PIVOTS * n // total)))
        centre = x[np.linspace(0, len(x) - 1, count).astype(int)]
        for _ in range(8):
            near = (x @ centre.T).argmax(axis=1)
            sums = np.zeros_like(centre)
            np.add.at(sums, near, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centre = np.where(size > 0, sums / np.maximum(size, 1e-12), centre).astype(np.float32)
        out[label] = centre
    return out


def _placed(pivots: dict, probes: int, margin: float):
    def run(frames):
        for pdf in frames:
            near: dict[int, list[int]] = {}
            for label, part in pdf.groupby("label", sort=False):  # a label's vectors have one length
                centre = pivots.get(label)
                if centre is None:
                    near |= dict.fromkeys(part.index, [0])
                    continue
                for i, sims in zip(part.index, _unit(_stack(part["v"])) @ centre.T, strict=True):
                    order = np.argsort(-sims, kind="stable")
                    near[i] = order[: max(probes, int((sims >= sims.max() - margin).sum()))].tolist()
            cells = [near[i] for i in pdf.index]
            yield pdf.assign(home=[c[0] for c in cells], overlap=[c[:OVERLAP] for c in cells], probed=cells)

    return run


def _rounds(reps: DataFrame, pivots: dict, cosine: float, probes: int, margin: float, vtype: str, exact: bool) -> DataFrame:
    """(id, links, root): links found in each task, and local components."""
    placed = saved(reps.mapInPandas(_placed(pivots, probes, margin), f"label string, id long, copies long, v {vtype}, home int, overlap array<int>, probed array<int>"), "placed")
    sizes = placed.select("label", F.explode("overlap").alias("cell")).groupBy("label", "cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))
    asked = placed.select("label", F.explode("probed").alias("cell")).groupBy("label", "cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("turns"))
    cells = saved(sizes.join(asked, ["label", "cell"]), "cells")
    members = placed.select("label", "id", "copies", "v", "home", F.explode("overlap").alias("cell")).join(cells, ["label", "cell"])
    members = members.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), "parts").cast("int"))
    graph = members.groupBy("label", "cell", "part").applyInPandas(_build, "id long, to array<long>")
    graph = saved(graph.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("to")), "graph")
    shard = members.join(graph, "id", "left").select("label", "cell", "part", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "id", "copies", "v", "to", (F.col("home") == F.col("cell")).alias("home"), F.lit(0).alias("query"))
    asks = placed.select("label", "id", "copies", "v", F.explode("probed").alias("cell")).join(cells, ["label", "cell"])
    asks = asks.select("label", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("id", F.lit(2)), "turns").cast("int").alias("turn"), "id", "copies", "v", F.lit(None).cast("array<long>").alias("to"), F.lit(False).alias("home"), F.lit(1).alias("query"))
    return saved(shard.union(asks).groupBy("label", "cell", "part", "turn").applyInPandas(_searched(cosine, exact), "id long, links long, root long"), "hits")


def audit(reps: DataFrame, hits: DataFrame, cosine: float, sample: int) -> float:
    """Mean share of the true links of a query, counted against all rows, that hits has: over `sample` queries and as many with links,
    of which those that have true links count; 1 if there are none."""
    order = [F.xxhash64("id", F.lit(SEED + 1)), F.col("id")]
    linked = reps.join(hits.where("links > 0").select("id").distinct(), "id", "left_semi")
    asks = reps.orderBy(*order).limit(sample).union(linked.select(reps.columns).orderBy(*order).limit(sample)).select("label", "id", "v").toPandas().drop_duplicates("id")
    if not len(asks):
        return 1.0
    by_label = {label: (part["id"].to_numpy(), _stack(part["v"])) for label, part in asks.groupby("label")}

    def count(frames):
        total: dict[int, int] = {}
        for pdf in frames:
            for label, part in pdf.groupby("label"):
                if label in by_label:
                    ids, v = by_label[label]
                    own, x, n = part["id"].to_numpy(), _stack(part["v"]).astype(np.float64), part["copies"].to_numpy()
                    q = v.astype(np.float64)
                    sims = q @ x.T / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
                    for i, row in zip(ids.tolist(), ((sims >= cosine) & (ids[:, None] != own[None, :])) @ n, strict=True):
                        total[i] = total.get(i, 0) + int(row)
        yield pd.DataFrame({"id": list(total), "n": list(total.values())}).astype("int64")

    true = {r[0]: r[1] for r in reps.mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n")).collect()}
    ids = asks[["id"]]
    found = {r[0]: r[1] for r in hits.join(F.broadcast(reps.sparkSession.createDataFrame(ids)), "id").groupBy("id").agg(F.sum("links")).collect()}
    shares = [min(found.get(i, 0), n) / n for i, n in true.items() if n]
    return float(np.mean(shares)) if shares else 1.0


def apply(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, cell: int = CELL, report: dict | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) of every row. report gets the audited recall and how it was reached."""
    ship(vectors.sparkSession)
    source = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").alias("raw"))
    fine = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("raw", lambda x: x != 0)
    usable = source.where("id is not null and label is not null and raw is not null").where(fine)
    vtype = source.schema["raw"].dataType.simpleString()
    # vectors of one label and of one length compare; equal vectors are told by 128 bits
    keyed = usable.select("id", F.concat_ws(":", F.size("raw"), "label").alias("label"), F.transform("raw", lambda x: x + F.lit(0.0).cast(x_type(vtype))).alias("v"))
    keyed = keyed.select("*", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(SEED), "v").alias("i"))
    # a vector may be that of a third of all rows: its copies are dealt by salts, and only salts that it has are joined to it
    rows = saved(keyed.groupBy("label", "h", "i", "id").agg(F.count("*").alias("rows")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")), "rows")
    salted = rows.groupBy("label", "h", "i", "salt").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    first = salted.groupBy("label", "h", "i").agg(F.min("least").alias("rep"), F.sum("copies").alias("copies"))
    own = keyed.select("id", "v", "h", "i", "label").join(first.select(F.col("rep").alias("id"), "label", "h", "i", "copies"), ["id", "label", "h", "i"])
    # several vectors may stand under one id: they are one node, and each of them is compared
    reps = saved(own.dropDuplicates(["id", "label", "h", "i"]).select("label", "id", "copies", "v"), "reps")
    sizes = reps.groupBy("label").count().where(F.col("count") > 2 * cell).orderBy(F.desc("count"), "label").limit(PIVOTS).collect()
    pivots = fit_pivots(reps, [(r[0], r[1]) for r in sizes], cell, 0)
    most = max((len(p) for p in pivots.values()), default=1)
    probes, margin, exact = PROBES, MARGIN, False
    while True:
        hits = _rounds(reps, pivots, cosine, probes, margin, vtype, exact)
        recall = audit(reps, hits, cosine, AUDIT)
        if recall >= RECALL or exact:
            break
        exact = probes >= most
        probes, margin = min(2 * probes, most), 2 * margin
    if report is not None:
        report |= {"recall": recall, "cells probed at least": probes, "exact": exact}
    links = hits.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(hits.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    classes = first.join(links, F.col("rep") == F.col("id"), "left").join(joined, F.col("rep") == F.col("node"), "left").select("label", "h", "i", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    classes = salted.select("label", "h", "i", "salt").join(classes, ["label", "h", "i"])
    linked = rows.join(classes, ["label", "h", "i", "salt"]).select("id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("component").alias("component_id"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_row")).drop("_row")
    ok = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("raw").isNotNull() & fine
    alone = source.where(~F.coalesce(ok, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def x_type(array: str) -> str:
    """The element type of an array type's name."""
    return array.removeprefix("array<").removesuffix(">")
