"""Operator 13, centroid clustering by dual-tree Lloyd rounds in whole numbers.

  blocks    each task cuts its vectors into blocks of BLOCK rows and builds one cover tree over the distinct vectors of each: a node covers
            its points within its radius, its children are a greedy net at a fraction of the radius, so they lie further apart than that.
            Blocks are written once, with their points in the order of the tree, and read again by every round;
  rounds    the driver builds a cover tree over the k centroids and broadcasts it. A task walks pairs of (vector node, centroid node) from
            the roots down: a pair goes if even its least distance is over the greatest that another pair of the vector node allows; the
            side with the larger radius is opened; a node left with one centroid is assigned as a whole; pairs of leaves are compared
            exactly. Tasks return counts and sums for each centroid;
  end       the last assignment is written, and the k sums of distances are joined to it.
Bounds are doubles with a slack over their rounding error, and only what is strictly further goes: ties reach the exact comparison, where
the smaller number wins. The driver holds k centroids and gets k * DIMS sums; a vector that a third of all rows share is one point of each
block.

Edge cases: vectors that are null, hold null or non-finite components, are not of DIMS components or hold one over MOST (so that distances
fit in a long) are dropped; a row with a null id can't be a first centroid but is clustered; rows that repeat an id are vectors like
others; of equal centroids the smaller number takes all; fewer than k vectors give fewer centroids, vectors without any centroid get a
null cluster; a sum over a long is null; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import saved, ship
from .grid import whole_rows

DIMS, CENTROIDS, ROUNDS, SCALE, SALT = 64, 16, 3, 64, "1:"
#: Rows of a block, points of a leaf, radius of a net by that of its node, components' bound; exact in doubles up to EXACT.
BLOCK, LEAF, NET, MOST, EXACT = 2048, 16, 0.5, 1 << 27, 1 << 20
#: Pairs that one exact comparison holds.
PAIRS = 1 << 16


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All squared distances of whole-number rows as doubles; exact for components up to EXACT."""
    if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) <= EXACT:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return np.maximum((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1), 0)
    return np.stack([((row - y).astype(np.float64) ** 2).sum(axis=1) for row in x]) if len(x) else np.zeros((0, len(y)))


class CoverTree:
    """Nodes by number, parents first: point (the centre's place in `order`'s sense), radius, start and end of the points below, first
    child and number of children, which stand together; 0 children make a leaf."""

    FIELDS = ("point", "radius", "start", "end", "first", "count")

    def __init__(self, **fields: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, fields[name])

    @classmethod
    def build(cls, x: np.ndarray, leaf: int = LEAF) -> tuple[CoverTree, np.ndarray]:
        """The tree over distinct rows, and their order; a node's points are those from start to end in this order."""
        n = len(x)
        far = np.sqrt(squared(x, x))
        order, nodes = np.arange(n), {name: [] for name in cls.FIELDS}

        def add(point: int, start: int, end: int) -> int:
            for name, value in (("point", point), ("radius", far[point, order[start:end]].max()), ("start", start), ("end", end), ("first", 0), ("count", 0)):
                nodes[name].append(value)
            return len(nodes["point"]) - 1

        middle = int(squared(x, np.floor(x.mean(axis=0, keepdims=True)).astype(np.int64))[:, 0].argmin())
        order[[0, middle]] = order[[middle, 0]]
        todo = [add(middle, 0, n)]
        while todo:
            node = todo.pop()
            start, end, reach = nodes["start"][node], nodes["end"][node], nodes["radius"][node]
            if end - start <= leaf:
                continue
            parts = []
            while len(parts) < 2:  # a net of one child is no level of its own
                reach, parts, left = reach * NET, [], order[start:end]
                left = np.r_[nodes["point"][node], left[left != nodes["point"][node]]]
                while len(left):
                    near = far[left[0], left] <= reach
                    parts.append(left[near])
                    left = left[~near]
            order[start:end] = np.concatenate(parts)
            nodes["first"][node], nodes["count"][node] = len(nodes["point"]), len(parts)
            at = start
            for part in parts:
                todo.append(add(int(part[0]), at, at + len(part)))
                at += len(part)
        tree = cls(**{name: np.array(v, dtype=np.float64 if name == "radius" else np.int32) for name, v in nodes.items()})
        place = np.empty(n, dtype=np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        tree.point = place[tree.point]  # by the tree's own order from here on
        return tree, order

    def children(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, child): the children of each node, and whose they are."""
        count = self.count[node]
        which = np.repeat(np.arange(len(node)), count)
        return which, self.first[node][which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


class Centroids:
    """Centroids and the tree over the distinct ones; of equal ones the smallest number stands for all."""

    def __init__(self, x: np.ndarray):
        self.all = x
        distinct, number = np.unique(x, axis=0, return_index=True)
        self.tree, order = CoverTree.build(distinct, leaf=1)
        self.x, self.number = distinct[order], number[order].astype(np.int64)


def assign(tree: CoverTree, x: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid of each row of x, which stand in the tree's order; pairs of nodes bounded and pairs compared exactly)."""
    best = np.full(len(x), -1, dtype=np.int64)  # places in c.x
    found = np.full(len(x), np.iinfo(np.int64).max, dtype=np.int64)
    bound = np.full(len(tree.point), np.inf)
    v = u = np.zeros(1, dtype=np.int64)
    work = np.zeros(2, dtype=np.int64)
    size = max(np.abs(x).max(initial=0), np.abs(c.x).max(initial=0))
    slack = 1e-9 * (1 + float(size) * x.shape[1] ** 0.5)  # far over the rounding of a root of a sum
    while len(v):
        work[0] += len(v)
        far = np.sqrt(((x[tree.point[v]] - c.x[c.tree.point[u]]).astype(np.float64) ** 2).sum(axis=1))
        np.minimum.at(bound, v, far + tree.radius[v] + c.tree.radius[u])
        keep = far - tree.radius[v] - c.tree.radius[u] <= bound[v] + slack
        v, u = v[keep], u[keep]
        node, first, count = np.unique(v, return_index=True, return_counts=True)
        inner = c.tree.count[u] > 0
        some_inner, widest = np.logical_or.reduceat(inner, first), np.maximum.reduceat(c.tree.radius[u], first)
        leaf = tree.count[node] == 0
        alone = (count == 1) & ~some_inner
        for i in np.flatnonzero(alone).tolist():
            best[tree.start[node[i]] : tree.end[node[i]]] = c.tree.point[u[first[i]]]
        done = leaf & ~some_inner & ~alone
        open_u = some_inner & (leaf | (widest >= tree.radius[node]))
        open_v = ~alone & ~done & ~open_u
        of = np.repeat(np.arange(len(node)), count)
        pairs = np.flatnonzero(done[of])
        work[1] += _compare(tree, x, c, v[pairs], u[pairs], best, found)
        parts_v, parts_u = [], []
        own = np.flatnonzero(open_u[of])
        which, child = c.tree.children(u[own])
        parts_v += [v[own][which], v[own][~inner[own]]]
        parts_u += [child, u[own][~inner[own]]]
        own = np.flatnonzero(open_v[of])
        which, child = tree.children(v[own])
        bound[child] = np.minimum(bound[child], bound[v[own][which]])
        parts_v.append(child)
        parts_u.append(u[own][which])
        v, u = np.concatenate(parts_v), np.concatenate(parts_u)
        order = np.lexsort((u, v))
        v, u = v[order], u[order]
    return c.number[best], work


def _compare(tree: CoverTree, x: np.ndarray, c: Centroids, v: np.ndarray, u: np.ndarray, best: np.ndarray, found: np.ndarray) -> int:
    """Every point of leaf v against the centroid of leaf u, in whole numbers; ties go to the smaller number."""
    n = (tree.end[v] - tree.start[v]).astype(np.int64)
    ends = np.cumsum(n)
    for low in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        at = np.arange(low, min(low + PAIRS, int(ends[-1])))
        pair = np.searchsorted(ends, at, side="right")
        point, centre = tree.start[v[pair]] + at - (ends - n)[pair], c.tree.point[u[pair]].astype(np.int64)
        distance = ((x[point] - c.x[centre]) ** 2).sum(axis=1)
        order = np.lexsort((c.number[centre], distance, point))
        order = order[np.r_[True, point[order][1:] != point[order][:-1]]]
        point, distance, centre = point[order], distance[order], centre[order]
        better = (distance < found[point]) | ((distance == found[point]) & (c.number[centre] < c.number[best[point]]))
        found[point[better]], best[point[better]] = distance[better], centre[better]
    return int(ends[-1]) if len(ends) else 0


def _block(ids: pa.Array, x: np.ndarray) -> dict:
    distinct, at = np.unique(x, axis=0, return_inverse=True)
    tree, order = CoverTree.build(distinct)
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    small = np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.int32
    nodes = {name: getattr(tree, name).tobytes() for name in CoverTree.FIELDS}
    return {"ids": ids, "at": place[at.ravel()], "width": np.dtype(small).itemsize, "x": distinct[order].astype(small).tobytes()} | nodes


def _unpacked(batch: pa.RecordBatch, i: int, dims: int) -> tuple[pa.Array, np.ndarray, np.ndarray, CoverTree]:
    """(ids, place of each row's vector, distinct vectors in the tree's order, tree)."""
    get = lambda name: batch.column(name)[i].as_py()
    x = np.frombuffer(get("x"), dtype=np.int16 if get("width") == 2 else np.int32).reshape(-1, dims).astype(np.int64)
    tree = CoverTree(**{name: np.frombuffer(get(name), dtype=np.float64 if name == "radius" else np.int32) for name in CoverTree.FIELDS})
    return batch.column("ids")[i].values, batch.column("at")[i].values.to_numpy(), x, tree


def blocks(vectors: DataFrame, id: str, vector: str, dims: int) -> DataFrame:
    """The written table of blocks."""
    source = vectors.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    kind = source.schema["id"].dataType.simpleString()
    names = ["ids", "at", "width", "x", *CoverTree.FIELDS]

    def build(batches):
        waiting_ids, waiting, n = [], [], 0

        def made(whole: bool):
            nonlocal waiting_ids, waiting, n
            ids, x, low = pa.concat_arrays(waiting_ids), np.concatenate(waiting), 0
            while n - low >= BLOCK or whole and low < n:
                row = _block(ids.slice(low, BLOCK), x[low : low + BLOCK])
                lists = {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if k == "ids" else pa.array(v)) for k, v in row.items() if k in ("ids", "at")}
                rest = {k: pa.array([v], pa.int32() if k == "width" else pa.binary()) for k, v in row.items() if k not in lists}
                yield pa.RecordBatch.from_arrays([(lists | rest)[k] for k in names], names=names)
                low += BLOCK
            waiting_ids, waiting, n = [ids.slice(low)], [x[low:]], max(0, n - low)

        for batch in batches:
            at, x = whole_rows(batch.column("v"), dims, SCALE, MOST)
            if not len(at):
                continue
            waiting_ids.append(batch.column("id").take(pa.array(at)))
            waiting.append(x)
            n += len(x)
            if n >= BLOCK:
                yield from made(False)
        if n:
            yield from made(True)

    return saved(source.mapInArrow(build, f"ids array<{kind}>, at array<int>, width int, x binary, point binary, radius binary, start binary, end binary, first binary, count binary"), "cover-trees")


def first_centroids(vectors: DataFrame, id: str, vector: str, dims: int, k: int) -> np.ndarray:
    """The k usable vectors whose ids hash least."""
    v = F.col(f"`{vector}`").cast("array<double>")
    usable = vectors.select(F.col(f"`{id}`").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dims)).where(F.forall("v", lambda c: c.isNotNull() & (F.abs(F.floor(F.when(F.abs(c) < 1e18 / SCALE, c).otherwise(1e18 / SCALE) * SCALE)) <= MOST)))
    rows = usable.select(F.sha2(F.concat(F.lit(SALT), F.col("id").cast("string")), 256).alias("h"), F.transform("v", lambda c: F.floor(c * SCALE)).alias("x")).orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64).reshape(-1, dims)


def _round(trees: DataFrame, x: np.ndarray, dims: int) -> tuple[dict[int, tuple[int, list[int]]], dict[str, int]]:
    """({centroid: (count, sums)}, how many pairs were bounded and compared)."""
    shared = trees.sparkSession.sparkContext.broadcast(Centroids(x))

    def sums(batches):
        c = shared.value
        total, counts, work = np.zeros((len(c.all), dims), dtype=np.int64), np.zeros(len(c.all), dtype=np.int64), np.zeros(2, dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                _, at, points, tree = _unpacked(batch, i, dims)
                cluster, pairs = assign(tree, points, c)
                work += pairs
                copies = np.bincount(at, minlength=len(points))
                counts += np.bincount(cluster, weights=copies, minlength=len(counts)).astype(np.int64)
                order = np.argsort(cluster, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(cluster[order]) != 0])
                total[cluster[order][first]] += np.add.reduceat((points * copies[:, None])[order], first)
        # the work is a row of its own, of no cluster
        own = np.flatnonzero(counts)
        rows = [*total[own].tolist(), [*work.tolist(), *[0] * (dims - 2)]]  # at least two numbers
        yield pa.RecordBatch.from_arrays([pa.array([*own.tolist(), -1], pa.int32()), pa.array([*counts[own].tolist(), 0], pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    parts = trees.mapInArrow(sums, "cluster int, n long, s array<long>").select("cluster", "n", F.posexplode("s").alias("dim", "s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        out.setdefault(r["cluster"], (r["n"], [0] * (dims if r["cluster"] >= 0 else max(dims, 2))))[1][r["dim"]] = r["s"]
    _, work = out.pop(-1, (0, [0, 0]))
    return out, {"bounded": work[0], "compared": work[1]}


def apply(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", dims: int = DIMS, k: int = CENTROIDS, rounds: int = ROUNDS, report: dict | None = None) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector. report gets the pairs of nodes that
    each round bounded and the pairs of a vector and a centroid that it compared exactly."""
    spark = vectors.sparkSession
    ship(spark)
    trees = blocks(vectors, id, vector, dims)
    x = first_centroids(vectors, id, vector, dims, k)
    kind = trees.schema["ids"].dataType.elementType.simpleString()
    for _ in range(rounds if len(x) else 0):
        found, work = _round(trees, x, dims)
        if report is not None:
            report.setdefault("pairs", []).append(work)
        for number, (n, sums) in found.items():
            x[number] = [s // n for s in sums]
    shared = spark.sparkContext.broadcast(Centroids(x) if len(x) else None)

    def last(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, at, points, tree = _unpacked(batch, i, dims)
                if shared.value is None:
                    cluster = distance = pa.nulls(len(ids), pa.int64())
                else:
                    own, _ = assign(tree, points, shared.value)
                    cluster, distance = pa.array(own[at]), pa.array(((points - shared.value.all[own]) ** 2).sum(axis=1)[at])
                yield pa.RecordBatch.from_arrays([ids, cluster.cast(pa.int32()), distance], names=["id", "cluster", "distance"])

    assigned = saved(trees.mapInArrow(last, f"id {kind}, cluster int, distance long"), "clusters")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: int(r["s"]) for r in assigned.where("cluster is not null").groupBy("cluster").agg(exact.alias("s")).collect()}
    long = lambda s: s if s < 1 << 63 else None
    told = [(i, long(sums.get(i, 0)), long(sum(sums.values())), hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for i, row in enumerate(x)]
    # k rows
    ends = F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return assigned.join(ends, "cluster", "left").select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
