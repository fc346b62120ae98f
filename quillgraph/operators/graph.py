"""Graph traversal over an edge table (edge_type, src, dst). Depths are bounded; each hop is one join with the frontier, whose rows are
written down, so that plans stay small and no hop is computed twice."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut, ship

NEIGHBOUR_TYPES = ("CALLS", "CALLED_BY", "BELONGS_TO")
MAX_PATH_HOPS, MAX_EXPANSION, MAX_CHAIN, PATHS = 6, 3, 4, 3
#: Hops that one plan holds.
PLANNED = 2
#: Rows of each side that are paired at once, and pairs that one task makes; as many tasks as that takes, up to MOST_TASKS.
BLOCK, TASK_PAIRS, MOST_TASKS = 2000, 20_000_000, 10_000


def by_type(edges: DataFrame, *types: str) -> DataFrame:
    """Edges of the types; with a table partitioned by edge_type this prunes partitions."""
    return edges.where(F.col("edge_type").isin(*types))


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, edge_type, direction): each edge as it is (OUT) and turned (IN)."""
    ahead = edges.select("src", "dst", "edge_type", F.lit("OUT").alias("direction"))
    return ahead.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type", F.lit("IN").alias("direction")))


def _reach(pairs: DataFrame, anchors: DataFrame, depth: int) -> DataFrame:
    """(anchor, node, hop): least hops over pairs (src, dst) from each anchor, up to depth.

    Up to PLANNED hops are one plan; of longer walks each further hop drops nodes met before and is written down.
    """
    seen = front = anchors.select("anchor", F.col("anchor").alias("node"), F.lit(0).alias("hop")).distinct()
    for k in range(1, depth + 1):
        step = front.join(pairs, front["node"] == pairs["src"]).select("anchor", F.col("dst").alias("node")).distinct()
        if k < PLANNED or k == depth <= PLANNED:
            # one aggregation at the end costs less than an anti join at each of so few hops
            front = step.withColumn("hop", F.lit(k))
            seen = seen.unionByName(front)
            continue
        if k == PLANNED:
            seen = seen.groupBy("anchor", "node").agg(F.min("hop").alias("hop"))
        front = step.join(seen.select("anchor", "node"), ["anchor", "node"], "left_anti").withColumn("hop", F.lit(k))
        if k < depth:
            front = cut(front)
        seen = seen.unionByName(front)
    return seen.groupBy("anchor", "node").agg(F.min("hop").alias("hop")) if depth <= PLANNED else seen


def _owned(rows: DataFrame, id: str, name: str) -> DataFrame:
    """(id, owner, name) of rows (id, owner), each once; name: all owners of the id if there are several, else null."""
    every = rows.groupBy(id).agg(F.sort_array(F.collect_set("owner")).alias("_every"))
    return every.select(id, F.explode("_every").alias("owner"), F.when(F.size("_every") > 1, F.col("_every")).alias(name))


def _members(edges: DataFrame) -> DataFrame:
    """(node, owner) of BELONGS_TO."""
    return by_type(edges, "BELONGS_TO").select(F.col("src").alias("node"), F.col("dst").alias("owner"))


def crossed(left: DataFrame, right: DataFrame, inside: DataFrame | None = None) -> DataFrame:
    """(anchor, node): pairs of left (anchor, owner) and right (node, owner) with an owner in common, each once, without those of inside
    (anchor, node) and without a node itself.

    Pairs are made where they stay: no shuffle, sort or aggregation holds them. Rows of large owners are dealt to blocks, and each pair of
    blocks is a key of the join, so neither side nor the pairs of one owner are one task. Of several common owners the least makes the pair.
    """
    spark = left.sparkSession
    left, right = cut(_owned(left, "anchor", "hubs")), cut(_owned(right, "node", "owners"))
    sizes = cut(left.groupBy("owner").agg(F.count("*").alias("m")).join(right.groupBy("owner").agg(F.count("*").alias("n")), "owner"))
    pairs = sizes.agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0
    tasks = min(MOST_TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs // TASK_PAIRS))
    # fewer than the rows of both sides / BLOCK
    large = F.broadcast(sizes.where((F.col("m") > BLOCK) | (F.col("n") > BLOCK)).select("owner", F.ceil(F.col("m") / BLOCK).cast("int").alias("m"), F.ceil(F.col("n") / BLOCK).cast("int").alias("n")))
    blocks = lambda n: F.coalesce(F.col(n), F.lit(1))
    block = lambda id, n: F.pmod(F.xxhash64(id), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    keys = ["owner", "a", "b"]
    dealt_left = left.join(large, "owner", "left").select("anchor", "hubs", "owner", block("anchor", "m").alias("a"), every("n").alias("b"))
    dealt_right = right.join(large, "owner", "left").withColumn("b", block("node", "n"))
    if inside is not None:
        # at most the nodes of a block
        met = inside.select("anchor", "node").join(dealt_right.select("node", "owner", "b"), "node").join(left.select("anchor", "owner"), ["anchor", "owner"])
        dealt_left = dealt_left.join(met.groupBy("anchor", "owner", "b").agg(F.collect_set("node").alias("met")), ["anchor", "owner", "b"], "left")
    dealt_right = dealt_right.select("node", "owners", "owner", every("m").alias("a"), "b")
    # a broadcast would hold all blocks of a side
    found = dealt_left.repartition(tasks, *keys).join(dealt_right.repartition(tasks, *keys).hint("merge"), keys)
    once = F.col("hubs").isNull() | F.col("owners").isNull() | (F.array_min(F.array_intersect("hubs", "owners")) == F.col("owner"))
    found = found.where((F.col("anchor") != F.col("node")) & once)
    if inside is not None:
        found = found.where(F.col("met").isNull() | ~F.array_contains("met", F.col("node")))
    return found.select("anchor", "node")


def expand(edges: DataFrame, anchors: DataFrame, depth: int, methods: DataFrame | None = None, types: tuple[str, ...] = NEIGHBOUR_TYPES) -> DataFrame:
    """G1 (with A3, O6): undirected expansion; only methods are returned (if a table with chunk_id is given), the anchor at 0.

    The last hop from types to their members, the one that makes most pairs, is crossed(): what was met before is left out there."""
    own = by_type(edges, *types)
    pairs = both_ways(own).select("src", "dst")
    kept = (lambda df: df.join(methods.select(F.col("chunk_id").alias("node")), "node", "left_semi")) if methods is not None else lambda df: df
    if "BELONGS_TO" not in types or depth < 1:
        return kept(_reach(pairs, anchors, depth)).select("anchor", "node", "hop")
    before = cut(_reach(pairs, anchors, depth - 1))
    front = before.where(F.col("hop") == depth - 1)
    last = both_ways(own.where("edge_type <> 'BELONGS_TO'")).select("src", "dst").union(by_type(own, "BELONGS_TO").select("src", "dst"))
    step = front.join(last, front["node"] == last["src"]).select("anchor", F.col("dst").alias("node"), F.lit(depth).alias("hop"))
    near = cut(kept(before.unionByName(step).groupBy("anchor", "node").agg(F.min("hop").alias("hop"))).select("anchor", "node", "hop"))
    members = _members(edges)
    hubs = front.select("anchor", F.col("node").alias("owner")).join(members.select("owner"), "owner", "left_semi")
    return near.unionByName(crossed(hubs, kept(members), near).withColumn("hop", F.lit(depth)))


def context(edges: DataFrame, anchors: DataFrame, chunks: DataFrame, depth: int) -> DataFrame:
    """Expansion over callees and callers; ids without a chunk are dropped from the result, not from the walk."""
    return expand(edges, anchors, depth, chunks, ("CALLS",)).orderBy("anchor", "hop", "node")


def siblings(edges: DataFrame, anchors: DataFrame, but: DataFrame | None = None) -> DataFrame:
    """(anchor, node) in the same class; no nodes of `but` (chunk_id)."""
    own = _members(edges)
    mine = own.withColumnRenamed("node", "anchor").join(anchors.select("anchor").distinct(), "anchor", "left_semi")
    return crossed(mine, own if but is None else own.join(but.select(F.col("chunk_id").alias("node")), "node", "left_anti"))


def _beside(edges: DataFrame, anchors: DataFrame, near: DataFrame, methods: DataFrame, depth: int) -> DataFrame:
    """(anchor, node, hop 1): siblings that the expansion `near` to depth lacks. Two hops reach all of them that are methods."""
    if depth >= 2:
        return siblings(edges, anchors, methods).withColumn("hop", F.lit(1))
    return siblings(edges, anchors).join(near.select("anchor", "node"), ["anchor", "node"], "left_anti").withColumn("hop", F.lit(1))


def crowds(edges: DataFrame, methods: DataFrame, least: int) -> DataFrame:
    """(chunk_id, owner): methods of types with more than `least` of them. A type counts only if all that belongs to it are methods
    (chunk_id, fq_class_name) of its name."""
    own = by_type(edges, "BELONGS_TO").select(F.col("src").alias("chunk_id"), F.col("dst").alias("owner")).distinct()
    told = own.join(methods.select("chunk_id", F.col("fq_class_name").alias("own")).distinct(), "chunk_id", "left")
    full = told.groupBy("owner").agg(F.count("*").alias("n"), F.count_if(F.col("own") == F.col("owner")).alias("named")).where((F.col("n") > least) & (F.col("n") == F.col("named")))
    return own.join(full.select("owner"), "owner", "left_semi").select("chunk_id", "owner")


def retrieval_expansion(edges: DataFrame, anchors: DataFrame, methods: DataFrame, depth: int, top_k: int) -> DataFrame:
    """G3 (with O8): G1; one hop more for anchors with fewer than top_k // 2 neighbours; siblings at 1 where they are absent."""
    few = anchors.select("anchor").distinct()
    if depth >= 2:
        # all methods of an anchor's types are within two hops, so anchors in types with enough of them needn't be counted
        members = _members(edges)
        full = members.distinct().join(methods.select(F.col("chunk_id").alias("node")), "node", "left_semi").groupBy("owner").agg(F.count("*").alias("n")).where(F.col("n") > top_k // 2)
        few = few.join(members.join(full, "owner", "left_semi").select(F.col("node").alias("anchor")), "anchor", "left_anti")
    few = cut(few)
    counts = few if few.isEmpty() else cut(expand(edges, few, depth, methods).groupBy("anchor").agg((F.count("*") - 1).alias("n")).where(F.col("n") < top_k // 2).select("anchor"))
    if counts.isEmpty():
        found = expand(edges, anchors, depth, methods)
    else:
        found = expand(edges, anchors.join(counts, "anchor", "left_anti"), depth, methods).unionByName(expand(edges, counts, depth + 1, methods))
    return found.unionByName(_beside(edges, anchors, found, methods, depth))


def _steps(edges: DataFrame, types: tuple[str, ...], directed: bool) -> DataFrame:
    own = by_type(edges, *types)
    steps = both_ways(own) if not directed else own.select("src", "dst", "edge_type", F.lit("OUT").alias("direction"))
    return steps.distinct()


def shortest_paths(edges: DataFrame, source: str, target: str, hops: int = MAX_PATH_HOPS, cap: int = PATHS, directed: bool = True) -> DataFrame:
    """All shortest paths from source to target, `cap` at most in the order of their text: (nodes, edges, length).

    Only steps that lie on a shortest path are followed: those whose distances from the source and to the target add up; and of the ways
    to a node only the `cap` least. So the work is that of the layers' edges, not of the paths, whose number grows with every layer.
    """
    hops = max(1, min(MAX_PATH_HOPS, hops))
    steps = cut(_steps(edges, ("CALLS",) if directed else ("CALLS", "CALLED_BY"), directed))
    spark = edges.sparkSession
    one = lambda x: spark.range(1).select(F.lit(x).alias("anchor"))
    none = F.array().cast("array<struct<src:string,dst:string,rel_type:string,direction:string>>")
    back = _reach(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct(), one(target), hops).select(F.col("node").alias("dst"), F.col("hop").alias("b"))
    row = back.where(F.col("dst") == source).first()
    if row is None:
        return spark.createDataFrame([], "nodes array<string>, edges array<struct<src:string,dst:string,rel_type:string,direction:string>>, length int")
    length = row["b"]
    ahead = _reach(steps.select("src", "dst").distinct(), one(source), length).select(F.col("node").alias("src"), F.col("hop").alias("a"))
    onto = steps.join(ahead, "src").join(back, "dst").where(F.col("a") + 1 + F.col("b") == length)
    onto = cut(onto.select("a", "src", "dst", F.struct("src", "dst", F.col("edge_type").alias("rel_type"), "direction").alias("e")))
    # the text of a path to the target begins with that of its way to any node on it, so a path that isn't among the least `cap` up to a
    # node is none of the least `cap` in the end: each node of a layer keeps that many, however many ways lead to it
    text = F.concat_ws("\n", F.array_join("nodes", "\n"), F.to_json("edges"))
    place = F.row_number().over(Window.partitionBy(F.element_at("nodes", -1)).orderBy(text))
    paths = spark.range(1).select(F.array(F.lit(source)).alias("nodes"), none.alias("edges"))
    for k in range(length):
        grown = paths.join(onto.where(F.col("a") == k), F.element_at("nodes", -1) == F.col("src"))
        grown = grown.select(F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("edges", F.array("e")).alias("edges"))
        paths = grown.withColumn("place", place).where(F.col("place") <= cap).drop("place")
    return paths.withColumn("length", F.lit(length)).orderBy(text).limit(cap)


def path_or_undirected(edges: DataFrame, source: str, target: str, hops: int = MAX_PATH_HOPS, cap: int = PATHS) -> DataFrame:
    """Directed paths, else undirected ones."""
    found = shortest_paths(edges, source, target, hops, cap)
    directed = not found.isEmpty()
    return (found if directed else shortest_paths(edges, source, target, hops, cap, directed=False)).withColumn("directed", F.lit(directed))


def paths_from_anchor(edges: DataFrame, anchor: str, targets: DataFrame, hops: int = MAX_PATH_HOPS) -> DataFrame:
    """(node, path) of one shortest CALLS path to each target, 0 hops up to `hops`; targets out of reach are missing.

    Of several paths the least by its nodes: the least path to a node goes over the least path to its parent.
    """
    hops = max(1, min(MAX_PATH_HOPS, hops))
    steps = by_type(edges, "CALLS").select("src", "dst").distinct()
    steps = cut(steps)
    seen = front = cut(edges.sparkSession.range(1).select(F.lit(anchor).alias("node"), F.array(F.lit(anchor)).alias("path")))
    for _ in range(hops):
        step = front.join(steps, front["node"] == steps["src"]).groupBy("dst").agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        front = cut(step.withColumnRenamed("dst", "node").join(seen.select("node"), "node", "left_anti"))
        seen = seen.unionByName(front)
    return seen.join(targets.select(F.col("chunk_id").alias("node")).distinct(), "node", "left_semi")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct CALLS edges among ids (chunk_id); fewer than two ids have none."""
    own = ids.select("chunk_id").distinct()
    found = by_type(edges, "CALLS").join(own.select(F.col("chunk_id").alias("src")), "src", "left_semi").join(own.select(F.col("chunk_id").alias("dst")), "dst", "left_semi")
    two = own.limit(2).agg(F.count("*").alias("k")).where("k = 2")  # one row at most
    return found.select("edge_type", "src", "dst").distinct().join(F.broadcast(two)).drop("k")


def topology(edges: DataFrame, limit: int = 200) -> DataFrame:
    """O2, O3: distinct (src, dst, edge_type) in order, the first max(1, limit), with the number of those left out."""
    own = edges.select("src", "dst", "edge_type").distinct()
    total = own.agg(F.count("*").alias("n"))
    return own.orderBy("src", "dst", "edge_type").limit(max(1, limit)).join(F.broadcast(total)).select("src", "dst", "edge_type", F.greatest(F.col("n") - max(1, limit), F.lit(0)).alias("omitted"))


def neighbours(edges: DataFrame, node: str, types: tuple[str, ...] = ("CALLS",)) -> DataFrame:
    """(node, edge_type, direction) one hop away."""
    return both_ways(by_type(edges, *types)).where(F.col("src") == node).select(F.col("dst").alias("node"), "edge_type", "direction").distinct()


def callers(edges: DataFrame, node: str) -> DataFrame:
    """Incoming CALLS only."""
    return by_type(edges, "CALLS").where(F.col("dst") == node).select(F.col("src").alias("chunk_id")).distinct()


def callees(edges: DataFrame, node: str) -> DataFrame:
    return by_type(edges, "CALLS").where(F.col("src") == node).select(F.col("dst").alias("chunk_id")).distinct()


def call_chain(edges: DataFrame, anchors: DataFrame, depth: int, callers: bool = False) -> DataFrame:
    """Pre-order walk (anchor, position, node, depth), each node at its first visit; children in the order of their ids.

    First-visit depth is that of the walk, not the shortest. The walk of an anchor reads the edges within `depth` hops of it.
    """
    depth = max(1, min(MAX_CHAIN, depth))
    steps = by_type(edges, "CALLS").select(*(("dst", "src") if callers else ("src", "dst"))).toDF("src", "dst").distinct()
    near = _reach(steps, anchors, depth - 1)
    region = near.join(steps, near["node"] == steps["src"]).select("anchor", "src", "dst")
    region = anchors.select("anchor").distinct().join(region, "anchor", "left")

    ship(edges.sparkSession)

    def walk(key, pdf: pd.DataFrame) -> pd.DataFrame:
        children = {s: sorted(g) for s, g in pdf.dropna().groupby("src")["dst"]}
        seen, rows, todo = set(), [], [(key[0], 0)]
        while todo:
            node, at = todo.pop()
            if node in seen:
                continue
            seen.add(node)
            rows.append((key[0], len(rows), node, at))
            if at < depth:
                todo += [(c, at + 1) for c in reversed(children.get(node, []))]
        return pd.DataFrame(rows, columns=["anchor", "position", "node", "depth"])

    kind = dict(anchors.dtypes)["anchor"]
    return region.groupBy("anchor").applyInPandas(walk, f"anchor {kind}, position int, node {kind}, depth int")


def neighbourhood_topology(edges: DataFrame, anchors: DataFrame, methods: DataFrame, depth: int, limit: int = 200) -> DataFrame:
    """G1 to 1-3 hops, then the CALLS edges inside."""
    near = expand(edges, anchors, max(1, min(MAX_EXPANSION, depth)), methods)
    return topology(induced(edges, near.select(F.col("node").alias("chunk_id"))), limit)


def neighbourhood(edges: DataFrame, anchors: DataFrame, methods: DataFrame, depth: int, most: int) -> DataFrame:
    """G12 (with O10): G1 and siblings, by (hop, id), `most` at most for each anchor."""
    near = expand(edges, anchors, max(1, min(MAX_EXPANSION, depth)), methods)
    beside = _beside(edges, anchors, near, methods, max(1, min(MAX_EXPANSION, depth)))
    place = F.row_number().over(Window.partitionBy("anchor").orderBy("hop", "node"))
    return near.unionByName(beside).withColumn("place", place).where(F.col("place") <= most)


def coverage(edges: DataFrame, anchors: DataFrame, methods: DataFrame, retrieved: DataFrame, caller_depth: int, callee_depth: int, most: int) -> DataFrame:
    """What the expansions (both undirected) and the siblings hold beyond `retrieved` (chunk_id), `most` at most.

    Only a node's least hop from any anchor counts, so one walk starts from all of them: rows are nodes, not pairs of anchor and node."""
    pairs = both_ways(by_type(edges, *NEIGHBOUR_TYPES)).select("src", "dst")
    seen = front = cut(anchors.select(F.col("anchor").alias("node")).distinct().withColumn("hop", F.lit(0)))
    own = by_type(edges, "BELONGS_TO")
    start = front.select(F.col("node").alias("src"), F.lit(True).alias("is_anchor"))
    owners = own.join(start, "src").groupBy("dst").agg(F.count_distinct("src").alias("n"))
    # an anchor is beside another one only
    beside = own.join(owners, "dst").join(start, "src", "left").where("is_anchor is null or n > 1").select(F.col("src").alias("node")).distinct().withColumn("hop", F.lit(1))
    for k in range(1, max(caller_depth, callee_depth) + 1):
        step = pairs.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").withColumn("hop", F.lit(k)))
        seen = seen.unionByName(front)
    found = seen.join(methods.select(F.col("chunk_id").alias("node")), "node", "left_semi").unionByName(beside)
    found = found.groupBy("node").agg(F.min("hop").alias("hop")).where("hop > 0")
    return found.join(retrieved.select(F.col("chunk_id").alias("node")), "node", "left_anti").orderBy("hop", "node").limit(most)


def requested_context(edges: DataFrame, resolved: DataFrame, methods: DataFrame, most: int) -> DataFrame:
    """Ids that were asked for (request, chunk_id) with one hop each, by request; no further request is begun once `most` are in."""
    anchors = resolved.select(F.col("chunk_id").alias("anchor"))
    near = expand(edges, anchors, 1, methods).join(resolved.withColumnRenamed("chunk_id", "anchor"), "anchor")
    first = near.groupBy("node").agg(F.min(F.struct("request", "hop")).alias("f")).select("node", F.col("f.request").alias("request"), F.col("f.hop").alias("hop"))
    counts = first.groupBy("request").agg(F.count("*").alias("n"))
    # one row for each request
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("request").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return first.join(before.where(F.col("before") < most).select("request"), "request", "left_semi").select("request", "node", "hop")


def fan_in(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """A1: callers of each id, 0 without. Counts are summed before the join."""
    n = by_type(edges, "CALLS").select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("n"))
    return ids.select("chunk_id").distinct().join(n, F.col("chunk_id") == F.col("dst"), "left").select("chunk_id", F.coalesce("n", F.lit(0)).alias("fan_in"))


def fan_out(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """A2."""
    n = by_type(edges, "CALLS").select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("n"))
    return ids.select("chunk_id").distinct().join(n, F.col("chunk_id") == F.col("src"), "left").select("chunk_id", F.coalesce("n", F.lit(0)).alias("fan_out"))


def fans(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """A1, A2: (chunk_id, fan_in, fan_out) of the ids alone: edges that touch none of them are dropped before anything is counted."""
    own = ids.select("chunk_id").distinct()
    calls = by_type(edges, "CALLS").select("src", "dst")
    into = calls.join(own, calls["dst"] == own["chunk_id"], "left_semi").distinct().groupBy(F.col("dst").alias("chunk_id")).agg(F.count("*").alias("fan_in"))
    out = calls.join(own, calls["src"] == own["chunk_id"], "left_semi").distinct().groupBy(F.col("src").alias("chunk_id")).agg(F.count("*").alias("fan_out"))
    return own.join(into, "chunk_id", "left").join(out, "chunk_id", "left").na.fill(0, ["fan_in", "fan_out"])


def summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A5, A10: (what, kind, n) of edges by type and nodes (kind) by kind; only those that occur."""
    e = edges.groupBy(F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "kind", "n")
    return e.unionByName(nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", "n"))


def hierarchy(chunks: DataFrame) -> DataFrame:
    """(package_name, fq_class_name, methods) with the methods of a class in order."""
    base = F.regexp_replace("chunk_id", r"#part\d+$", "")
    return chunks.groupBy("package_name", "fq_class_name").agg(F.sort_array(F.collect_set(base)).alias("methods"))
