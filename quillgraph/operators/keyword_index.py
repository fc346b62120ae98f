"""W7 by an index: the grams of three characters of each chunk's name, class, code and id, as a table of the graph in parts. A part is sorted
by gram, so a search reads the row groups with its grams, and only chunks that hold all of them are read and searched for the keyword itself.
The rows are those of lookup.search; a keyword of under three characters has no gram and is searched for in all chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.parted import PartedGraph, owner
from ..sources.tables import cut, ship
from . import lookup

SEARCHED, WIDE = ("method_name", "class_name", "code", "chunk_id"), 3
#: Characters of the texts of one task: under as many grams, of about 72 bytes each while they are sorted.
TASK_CHARS = 8_000_000
#: Grams that a task gives at once.
RUN = 2000


def _keys(row: list[str]) -> np.ndarray:
    """Distinct grams of a row's texts, sorted, each as one number of three code points."""
    out = []
    for text in row:
        if len(text) >= WIDE:
            c = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
            out.append(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.uint64)


def _run(ids: pa.Array, keys: list[np.ndarray]):
    """(gram, ids) of some rows, sorted by gram."""
    every, row = np.concatenate(keys), np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys])
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    starts = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, dtype=int)
    ends, own = np.append(starts[1:], len(every)), every[starts]
    for at in range(0, len(own), RUN):
        some, low, high = own[at : at + RUN], starts[at], ends[min(at + RUN, len(own)) - 1]
        points = np.stack([some >> np.uint64(42), some >> np.uint64(21) & np.uint64(0x1FFFFF), some & np.uint64(0x1FFFFF)], axis=1).astype("<u4")
        text = points.tobytes().decode("utf-32-le")
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts[at : at + RUN], high) - low, pa.int32()), ids.take(pa.array(row[low:high])))
        yield pa.RecordBatch.from_arrays([pa.array([text[i : i + WIDE] for i in range(0, len(text), WIDE)], pa.string()), lists], names=["gram", "ids"])


def grams(chunks: DataFrame) -> DataFrame:
    """(gram, chunk_id), once for each row of chunks; sorted by gram in runs of about TASK_CHARS characters of text."""
    ship(chunks.sparkSession)
    most = TASK_CHARS

    def cut_up(batches):
        ids, keys, chars = [], [], 0
        for batch in batches:
            name = batch.column("chunk_id").cast(pa.string())
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows = list(zip(*(some.column(f"text{i}").to_pylist() for i in range(len(SEARCHED))), strict=True))
                ids.append(name.slice(at, 256))
                keys += map(_keys, rows)
                chars += sum(len(t) for r in rows for t in r)
                if chars >= 2 * most:
                    yield from _run(pa.concat_arrays(ids), keys)
                    ids, keys, chars = [], [], 0
        if keys:
            yield from _run(pa.concat_arrays(ids), keys)

    own = chunks.select("chunk_id", *(F.lower(F.coalesce(c, F.lit(""))).alias(f"text{i}") for i, c in enumerate(SEARCHED)))
    return own.mapInArrow(cut_up, "gram string, ids array<string>").select("gram", F.explode("ids").alias("chunk_id"))


def _dealt(graph: PartedGraph, chunks: DataFrame) -> DataFrame:
    """Texts of the chunks, dealt to tasks of one part each and of about TASK_CHARS characters. Texts go out, not their grams, which are many
    times their size; a task's grams fit its memory when they are sorted."""
    own = chunks.select(*SEARCHED)
    chars = F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in SEARCHED), F.lit(0).cast("long")))
    # one row for each part
    sizes = own.groupBy(graph.place("grams").alias("part")).agg(chars.alias("n")).orderBy("part").collect()
    runs = [(r["part"], max(1, -(-r["n"] // TASK_CHARS))) for r in sizes]
    if not runs:
        return own
    first = [sum(n for _, n in runs[:i]) for i in range(len(runs))]
    told = F.element_at(F.create_map(*(x for (p, n), at in zip(runs, first, strict=True) for x in (F.lit(p), F.struct(F.lit(at).alias("at"), F.lit(n).alias("n"))))), graph.place("grams"))
    return own.repartitionById(first[-1] + runs[-1][1], (told["at"] + F.pmod(F.xxhash64("chunk_id"), told["n"])).cast("int"))


def put(graph: PartedGraph, chunks: DataFrame, owners: DataFrame | None = None) -> dict[str, set[int]]:
    """Files the chunks of some types in place of all that was filed of them: owners (fq) names types whose chunks may be gone, beside those
    of the chunks. Only the parts of these types are written; what stays in them is written by the tasks that read it."""
    own = chunks.select(F.substring_index("chunk_id", "#", 1).alias("fq"))
    own = cut((own if owners is None else own.union(owners.select("fq"))).distinct())
    touched = {r[0] for r in own.select(graph.part(F.col("fq"))).distinct().collect()}
    rest = graph.stored("grams", touched).withColumn("fq", owner("grams")).join(own, "fq", "left_anti").select("gram", "chunk_id")
    # what is cut up comes sorted
    rest = rest.sortWithinPartitions(graph.place("grams"), "gram")
    return graph.commit({"grams": rest.unionByName(grams(_dealt(graph, chunks)))}, {"grams": touched}, dealt=("grams",))


def search(graph: PartedGraph, chunks: DataFrame, keyword: str) -> DataFrame:
    """The rows of lookup.search over chunks, which are those of the index."""
    low = keyword.lower()
    wanted = sorted({low[i : i + WIDE] for i in range(len(low) - WIDE + 1)})
    if not wanted:
        return lookup.search(chunks, keyword)
    hits = graph.stored("grams").where(F.col("gram").isin(wanted)).groupBy("chunk_id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted))
    return lookup.search(chunks.join(hits.select("chunk_id"), "chunk_id", "left_semi"), keyword)
