"""Operator 10, near-duplicates by Order MinHash.

Sketch: k-mers of words are labelled with their occurrence number; each hash order picks the PICKED least labelled k-mers and keeps
them in text order, so that a shared sketch means shared words in a shared order. Two families of orders: k-mers of five words, which
hardly ever agree by chance, and of SHORT words of LETTERS letters or more, which edits spread evenly over a text can't all break.
Texts with an equal sketch are candidates; a banded alignment of their words verifies them: a link has an edit distance in words of
at most (1 - SIMILARITY) of the longer text.

Words are runs of letters, digits and underscores in lower case; a text that has none takes its white-space words. Exact copies
(equal words) meet by a digest of all words and stand behind one representative. Within a bucket every text is compared with the
most popular one (that whose buckets are largest: in a group of near copies, the one nearest to all); then every two texts of a
bucket that links don't join yet. Where such a bucket has over SMALL texts (they share a passage), its texts meet block by block, in
the first bucket that two of them share, and are aligned unless their lengths or their bags of words already rule a link out, by exact
bounds; so no bucket has a cap or loses a link. Groups are connected components.

Edge cases: null, empty and blank texts have no words and each stays alone; a text of fewer words than a k-mer has one k-mer of all
its words; very long texts are sketched whole, some tables at a time; ties between hashes go to the earlier place; of repeated rows
(one id, equal words) one is kept; texts that differ under one id are one node of the links, and each of them is kept if the id is;
rows with a null id get a null group and stay; further columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import copied, dealt, hot_level, saved, ship, shuffle_width
from .components import components

K, SIMILARITY = 5, 0.8
#: Words of a short k-mer, and the least letters of each; all words count where fewer than a third are so long.
SHORT, LETTERS = 2, 4
#: K-mers of a sketch, and orders of each family. An order of texts that share a part J of their labelled k-mers agrees with J ** 3.
#: At an edit similarity of 0.81 with evenly spread edits J is 0.45 for short k-mers: 0.97 of such pairs meet.
PICKED, TABLES, SHORT_TABLES = 3, 16, 36
#: Tasks that deal a digest shared by very many rows.
SALTS = 16
#: Above this size the texts of a bucket meet block by block, with bags, instead of in a join.
SMALL = 16
#: Texts of a block that meet those of another in one task; buckets of words in a bag, and in the coarse bag that is looked at before.
BLOCK, BAG, COARSE = 1000, 512, 32
SEED = 20_240_501
_WORDS_KEPT = 150_000


class _Memory(dict):
    """64-bit codes of words, bounded."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= _WORDS_KEPT:
            self.clear()
        code = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        self[word] = code
        return code


_memory = _Memory()
_word = None


def normalised(text: str | None) -> list[str]:
    global _word
    import re

    _word = _word or re.compile(r"\w+")
    return _word.findall((text or "").lower()) or (text or "").split()


def _coded(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_memory.__getitem__, words), dtype=np.uint64, count=len(words))


def word_codes(text: str | None) -> np.ndarray:
    """Codes of a text's normalised words, in order."""
    return _coded(normalised(text))


def _long_words(words: list[str], codes: np.ndarray) -> np.ndarray:
    """The codes that short k-mers are made of."""
    long = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) >= LETTERS
    return codes[long] if 3 * np.count_nonzero(long) >= len(codes) else codes


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(codes: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-word windows, in order; of all words if there are fewer."""
    k = min(k, len(codes))
    out = np.zeros(len(codes) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = (out + codes[i : len(codes) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
        out ^= out >> np.uint64(29)
    return _mix(out)


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Each hash mixed with its occurrence number: the second of two equal k-mers differs from the first."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    if first.all():
        return _mix(hashes)
    at = np.arange(len(hashes))
    number = np.empty(len(hashes), dtype=np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return _mix(hashes + number * np.uint64(0xD6E8FEB86659FD93))


def _family(codes: np.ndarray, k: int, picked: int, tables: int) -> list[int]:
    base = kmers(codes, k)
    own = (labelled(base) >> np.uint64(32)).astype(np.uint32)
    rng = np.random.Generator(np.random.PCG64(SEED + k))
    odd = rng.integers(0, 2**31, size=tables, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    picked = min(picked, len(own))
    out: list[int] = []
    step = max(1, 4_000_000 // len(own))
    for at in range(0, tables, step):
        values = own[None, :] * odd[at : at + step, None]
        places = np.empty((len(values), picked), dtype=np.int64)
        rows = np.arange(len(values))
        for j in range(picked):
            places[:, j] = values.argmin(axis=1)
            values[rows, places[:, j]] = np.uint32(2**32 - 1)
        places.sort(axis=1)
        sign = (np.arange(at, at + len(values), dtype=np.uint64) + np.uint64(1 + 1000 * k)) * np.uint64(0xA0761D6478BD642F)
        for j in range(picked):
            sign = _mix(sign * np.uint64(0xE7037ED1A0B428DB) + base[places[:, j]])
        out.extend(sign.view(np.int64).tolist())
    return out


def sketch(codes: np.ndarray, long: np.ndarray | None = None) -> list[int]:
    """One hash an order: of the least PICKED labelled k-mers, in text order. long: codes of the long words, if not all are."""
    return _family(codes, K, PICKED, TABLES) + _family(codes if long is None else long, SHORT, PICKED, SHORT_TABLES)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences if at most `most`, else most + 1: bit-parallel dynamic programming over a band of 2 * most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a) if len(a) <= most else most + 1
    most_here = min(most, len(a))
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    width = 2 * most_here + 1
    mask, top, across = (1 << width) - 1, 1 << width - 1, 1 << width - 2 if width > 1 else 0
    vp, vn, score = (mask << width - most_here - 1) & mask, 0, most_here
    start = most_here + 1 - width
    for i, x in enumerate(b):
        p = places.get(x, 0)
        p = (p >> start if start >= 0 else p << -start) & mask
        d0 = ((((p & vp) + vp) ^ vp) | p | vn) & mask
        hp, hn = (vn | ~(d0 | vp)) & mask, d0 & vp
        if i < len(a) - most_here:
            score += not d0 & top
            if score > 2 * most_here + len(b):
                break
        else:
            score += bool(hp & across)
            score -= bool(hn & across)
            across >>= 1
        vp, vn = (hn | ~((d0 >> 1) | hp)) & mask, (d0 >> 1) & hp
        start += 1
    return score if score <= most else most + 1


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    longest = max(len(a), len(b))
    most = int(longest * (1 - similarity) + 1e-9)
    return abs(len(a) - len(b)) <= most and bag_distance(bag(a), bag(b)) <= most and edit_distance(a, b, most) <= most


def _digest(codes: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_intdigest(codes.tobytes())
    return (d >> 64) - 2**63, (d & 2**64 - 1) - 2**63


def _sketches(frames):
    """A row for each text; one without words has n = 0."""
    for pdf in frames:
        rows = []
        for doc, text in zip(pdf["id"], pdf["text"], strict=True):
            words = normalised(text)
            codes = _coded(words)
            rows.append((doc, len(codes), *_digest(codes), sketch(codes, _long_words(words, codes)) if words else []))
        yield pd.DataFrame(rows, columns=["id", "n", "d1", "d2", "sketch"])


def _codes(frames):
    for pdf in frames:
        yield pd.DataFrame({"id": pdf["id"], "codes": [word_codes(t).tobytes() for t in pdf["text"]]})


def bag(codes: np.ndarray) -> np.ndarray:
    """Counts of words by bucket, at most 255 each."""
    return np.minimum(np.bincount((codes >> np.uint64(40)).astype(np.int64) % BAG, minlength=BAG), 255).astype(np.int16)


def bag_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """No edit distance is below it: words of one bag beyond those of the other must be deleted, inserted or replaced."""
    more = a - b
    return np.maximum(np.maximum(more, 0).sum(axis=-1, dtype=np.int32), np.maximum(-more, 0).sum(axis=-1, dtype=np.int32))


def _bags(frames):
    for pdf in frames:
        yield pdf[["id", "n", "c", "sketch"]].assign(bag=[bag(np.frombuffer(x, dtype=np.uint64)).tobytes() for x in pdf["codes"]])


def _possible(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a bucket (of two of its blocks) that no link joins, at the first table they share, if lengths and bags allow a link."""
    _, table, i, j = key
    pdf = pdf.sort_values(["n", "id"]).reset_index(drop=True)
    block = pdf["block"].to_numpy()
    signs, bags = np.stack(pdf["sketch"].to_numpy())[:, :table], np.stack([np.frombuffer(x, dtype=np.int16) for x in pdf["bag"]])
    # merged buckets give a lower bound of the distance of the bags
    coarse = bags.reshape(len(bags), COARSE, -1).sum(axis=2, dtype=np.int32)
    ids, n, c = pdf["id"].to_numpy(), pdf["n"].to_numpy(), pdf["c"].to_numpy()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    lengths = n[right]
    found: list[tuple[int, int]] = []
    for x in left.tolist():
        y = right[np.searchsorted(lengths, n[x] * SIMILARITY - 1e-6) : np.searchsorted(lengths, (n[x] + 1e-6) / SIMILARITY, "right")]
        y = y[(c[y] != c[x]) & ((y > x) | (i != j))]
        most = np.maximum(n[x], n[y]) * (1 - SIMILARITY) + 1e-6
        for own in (coarse, bags):
            near = bag_distance(own[x], own[y]) <= most
            y, most = y[near], most[near]
        y = y[~(signs[y] == signs[x]).any(axis=1)]
        found += [(min(ids[x], z), max(ids[x], z)) for z in ids[y].tolist()]
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _verified(frames):
    for pdf in frames:
        read = lambda x: np.frombuffer(x, dtype=np.uint64)
        ok = [similar(read(x), read(y)) for x, y in zip(pdf["ca"], pdf["cb"], strict=True)]
        yield pdf.loc[ok, ["a", "b"]]


def _verify(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """Pairs (a, b) of a written table whose words align. The centre of a large star may be in a third of all pairs: both ends are dealt."""
    level, out = hot_level(pairs.count()), pairs
    for end, other in ("ab", "ba"):
        hot = saved(pairs.groupBy(end).agg(F.count("*").alias("k")).where(F.col("k") > level), "stars")
        own = codes.select(F.col("id").alias(end), F.col("codes").alias(f"c{end}")).join(F.broadcast(hot), end, "left")
        out = dealt(out.join(F.broadcast(hot), end, "left"), "k", level, other).drop("k").join(copied(own, "k", level).drop("k"), [end, "salt"]).drop("salt")
    return out.select("a", "b", "ca", "cb").mapInPandas(_verified, "a long, b long")


def _across(rows: DataFrame) -> DataFrame:
    """Every two texts of a bucket that no link joins."""
    other = rows.select("s", F.col("id").alias("b"), F.col("n").alias("m"), F.col("c").alias("d"))
    return rows.join(other, "s").where("c <> d and id < b").where(_near("n", "m")).select(F.col("id").alias("a"), "b")


def _near(n: str, m: str):
    """Lengths that an alignment at SIMILARITY allows."""
    return F.least(n, m) >= F.greatest(n, m) * F.lit(SIMILARITY) - 1e-6


def apply(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, group_id, copy_of, kept) of every row: group_id is the least id of its group, copy_of that of its exact copies."""
    ship(docs.sparkSession)
    source = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    every = saved(source.where("id is not null").mapInPandas(_sketches, "id long, n int, d1 long, d2 long, sketch array<long>"), "sketches")
    own = every.where("n > 0")
    reps = own.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    buckets = saved(reps.select(F.posexplode("sketch").alias("t", "s"), "id", "n"), "buckets")
    sizes = saved(buckets.groupBy("s").agg(F.count("*").alias("k")).where("k > 1"), "sizes")
    # a bucket may hold a third of all texts: those over the level, which are few, are dealt by salts in every join on s
    level = hot_level(buckets.count())
    hot = F.broadcast(sizes.where(F.col("k") > level))
    shared = saved(dealt(buckets.join(hot, "s", "left"), "k", level, "id").drop("k").join(copied(sizes, "k", level), ["s", "salt"]).drop("salt"), "shared")
    popular = shared.groupBy("id").agg(F.sum("k").alias("p"))
    ranked = shared.join(popular, "id")
    centres = ranked.groupBy("s", "k").agg(F.max(F.struct("p", (-F.col("id")).alias("i"), "n")).alias("c")).select("s", "k", (-F.col("c.i")).alias("cid"), F.col("c.n").alias("cn"))
    members = saved(dealt(shared, "k", level, "id").join(copied(centres, "k", level).drop("k"), ["s", "salt"]).drop("salt"), "members")
    first = saved(members.where("id <> cid").where(_near("n", "cn")).select(F.col("cid").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    involved = members.select("id").distinct()
    codes = saved(source.join(involved, "id").mapInPandas(_codes, "id long, codes binary").dropDuplicates(["id", "codes"]), "codes")
    links = saved(_verify(first, codes), "links")
    joined = saved(components(links), "joined")
    placed = members.join(joined, members["id"] == joined["node"], "left").select("s", "t", "id", "n", "k", F.coalesce("component", "id").alias("c"))
    split = placed.groupBy("s", "k").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("s", "k")
    rest = saved(dealt(placed, "k", level, "id").join(copied(split, "k", level).drop("k"), ["s", "salt"]).drop("salt"), "split")
    crowd = rest.where(F.col("k") > SMALL)
    # of buckets with the same texts one is enough, that of the first table; equal sets are told by 128 bits
    alike = crowd.groupBy("s", "t").agg(F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"), F.count("*").alias("k"))
    alike = alike.groupBy("x", "y", "k").agg(F.min(F.struct("t", "s")).alias("m")).select("m.s", "k", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
    # dealt by id: the texts of one crowd lie together in `codes`
    texts = codes.join(crowd.select("id", "n", "c").distinct(), "id").join(reps.select("id", "sketch"), "id").repartition(shuffle_width(docs.sparkSession), "id")
    bags = saved(texts.mapInPandas(_bags, "id long, n int, c long, sketch array<long>, bag binary"), "bags")
    met = dealt(crowd.select("s", "t", "id", "k"), "k", level, "id").join(copied(alike, "k", level).drop("k"), ["s", "salt"]).drop("k", "salt").join(bags, "id").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    possible = met.groupBy("s", "t", "i", "j").applyInPandas(_possible, "a long, b long")
    second = _across(rest.where(F.col("k") <= SMALL)).union(possible).distinct().join(first, ["a", "b"], "left_anti")
    more = saved(_verify(saved(second, "pairs"), codes), "links")
    final = components(links.union(more))
    # a digest may be that of a third of all rows: it is dealt by salts, and only salts that it has are joined to it
    rows = own.groupBy("d1", "d2", "id").agg(F.count("*").alias("copies")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    least = own.groupBy("d1", "d2", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")).agg(F.min("id").alias("least"))
    rep = least.groupBy("d1", "d2").agg(F.min("least").alias("rep")).join(final, F.col("rep") == final["node"], "left").select("d1", "d2", "rep", F.coalesce("component", "rep").alias("group_id"))
    found = rows.join(least.drop("least").join(rep, ["d1", "d2"]), ["d1", "d2", "salt"])
    grouped = found.select("id", "group_id", F.col("rep").alias("copy_of"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    alone = every.where("n = 0").select("id").union(source.where("id is null").select("id")).select("id", F.col("id").alias("group_id"), F.col("id").alias("copy_of"), F.lit(1).cast("long").alias("copy"))
    kept = F.coalesce(F.col("id") == F.col("group_id"), F.lit(True)) & (F.col("copy") == 1)
    return grouped.union(alone).select(F.col("id").alias(id), "group_id", "copy_of", kept.alias("kept"))


def _digests(texts: pd.Series) -> pd.DataFrame:
    codes = [word_codes(t) for t in texts]
    return pd.DataFrame([(len(c), *_digest(c)) for c in codes], columns=["n", "d1", "d2"])


def select(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are kept, as they are; of repeated rows one."""
    verdict = saved(apply(docs, id, text).select(F.col(f"`{id}`").alias("_id"), "group_id", "kept"), "verdicts")
    own, columns = F.col(f"`{id}`").cast("long"), [F.col(f"`{c}`") for c in docs.columns]
    rest = docs.join(verdict.where("_id <> group_id").select("_id").distinct(), own == F.col("_id"), "left_anti")
    twice = verdict.where("_id = group_id and not kept").select("_id").distinct()
    if twice.isEmpty():
        return rest
    digest = F.pandas_udf(_digests, "n int, d1 long, d2 long")
    again = rest.join(twice, own == F.col("_id"), "left_semi").select(F.struct(*columns).alias("row"), digest(F.col(f"`{text}`")).alias("d"))
    one = again.where("d.n > 0").groupBy(F.col(f"row.`{id}`"), "d.d1", "d.d2").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return rest.join(twice, own == F.col("_id"), "left_anti").unionByName(one).unionByName(again.where("d.n = 0").select("row.*"))
