"""Operator 7, token ids in binary files under one canonical Huffman code whose lengths have a limit.

Texts are encoded once and their ids written down; then ids are counted (partial sums, then at most one row for each id of the
vocabulary reaches the driver) and each document is coded. Coded documents are dealt to shards by ranges of their id and written in order. Reading needs no other state.

Files, all numbers little-endian:
  codebook: magic QHUFCODE, u32 size of the alphabet, one u8 code length for each id (0: no code). Codes are canonical: by length,
    then by id.
  shard: magic QHUFSHRD, u32 documents, u32 blocks, u64 payload bytes; for each document i64 id, u8 1 (0: the id is null), u64 ids;
    for each block u32 payload bytes; u32 checkpoints; the payload. Columns are stored one after the other.
A document is cut into blocks of BLOCK ids (the last is shorter). Each starts on a byte and decodes on its own. Checkpoints are bit
offsets from the block's start, one for every STRIDE ids, at which decoding may begin; the decoder follows them all in step through a
table of 2 ** LIMIT entries.

A task writes files under names of its own; the manifest, a written table, names those of the tasks that were committed, so retries
and lost executors leave unread files at worst. Folders are opened with pyarrow.fs on the executors.

Edge cases: null and empty texts are the end id alone; null ids come first; repeated rows are stored one by one; a hot id is cut into
further shards; very long texts have many blocks; an empty table writes a codebook without codes, no shard, and gives no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import discard, saved, scratch, ship, whole, with_long
from .tokens import encoder, groups

LIMIT, BLOCK, STRIDE = 16, 8192, 512
#: Payload bytes of a shard.
SHARD = 16 << 20
_BOOK, _SHARD = b"QHUFCODE", b"QHUFSHRD"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no length over `limit`, by package-merge; 0 where the count is 0."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit in codes of {limit} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    level, is_leaf = leaves, []
    for step in range(limit):
        is_leaf.append(np.ones(len(leaves), dtype=bool))
        if step:
            packed = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
            level = np.concatenate([leaves, packed])
            order = np.argsort(level, kind="stable")
            level, is_leaf[-1] = level[order], order < len(leaves)
    take = 2 * len(leaves) - 2
    for chosen in reversed(is_leaf):
        n = int(chosen[:take].sum())
        lengths[used[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id, in its low bits."""
    codes, code, before = np.zeros(len(lengths), dtype=np.uint32), 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.lexsort((used, lengths[used]))].tolist():
        code <<= int(lengths[i]) - before
        codes[i], before = code, int(lengths[i])
        code += 1
    return codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For each `limit` bits that may come next: id << 8 | code length."""
    table, codes = np.zeros(1 << limit, dtype=np.uint32), canonical(lengths)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (limit - lengths[order].astype(np.int64))
    filled = np.repeat(order.astype(np.uint32) << np.uint32(8) | lengths[order].astype(np.uint32), spans)
    assert not len(order) or codes[order[0]] == 0
    table[: len(filled)] = filled
    return table


def encode(documents: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> list[bytes]:
    """Each document as its block sizes, checkpoints and payload."""
    ids = np.concatenate(documents)
    sizes = np.array([len(d) for d in documents])
    n = lengths[ids].astype(np.int64)
    starts = np.concatenate([np.arange(0, s, BLOCK) + at for s, at in zip(sizes, np.cumsum(sizes) - sizes, strict=True)])
    bits = np.add.reduceat(n, starts)
    block_bytes = (bits + 7) // 8
    block_at = np.cumsum(block_bytes) - block_bytes
    block_ids = np.diff(np.r_[starts, len(ids)])
    inside = np.cumsum(n) - n
    inside -= np.repeat(inside[starts], block_ids)
    at = inside + np.repeat(block_at * 8, block_ids)
    # codes lie in text order: those that begin in one 32-bit word are summed, and what runs over goes to the next word
    word, total = at >> 5, int(block_bytes.sum())
    value = codes[ids].astype(np.uint64) << (64 - n - (at & 31)).astype(np.uint64)
    begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    sums, word = np.bitwise_or.reduceat(value, begin), word[begin]
    words = np.zeros(total // 4 + 3, dtype=np.uint32)
    words[word] = sums >> np.uint64(32)
    words[word + 1] |= (sums & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = words.astype(">u4").view(np.uint8)[:total]
    number = np.arange(len(ids)) - np.repeat(starts, block_ids)
    marks = inside[number % STRIDE == 0].astype("<u4")
    packed, b, m, at = [], 0, 0, 0
    for s in sizes.tolist():
        blocks = -(-s // BLOCK)
        points = sum(-(-min(BLOCK, s - k * BLOCK) // STRIDE) for k in range(blocks))
        size = int(block_bytes[b : b + blocks].sum())
        packed.append(block_bytes[b : b + blocks].astype("<u4").tobytes() + marks[m : m + points].tobytes() + out[at : at + size].tobytes())
        b, m, at = b + blocks, m + points, at + size
    return packed


def _blocks(n: np.ndarray) -> np.ndarray:
    """Ids of each block of documents of n ids."""
    count = -(-n // BLOCK)
    sizes = np.full(int(count.sum()), BLOCK, dtype=np.int64)
    sizes[np.cumsum(count) - 1] = n - (count - 1) * BLOCK
    return sizes


def decode(n: np.ndarray, block_bytes: np.ndarray, marks: np.ndarray, payload: np.ndarray, table: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """All ids of documents of n ids, one after the other."""
    sizes = _blocks(n)
    points = -(-sizes // STRIDE)
    block_at = (np.cumsum(block_bytes) - block_bytes).astype(np.int64) * 8
    where = np.repeat(block_at, points) + marks.astype(np.int64)
    left = np.full(len(marks), STRIDE, dtype=np.int64)
    left[np.cumsum(points) - 1] = sizes - (points - 1) * STRIDE
    to = np.cumsum(left) - left
    order = np.argsort(-left, kind="stable")
    where, left, to = where[order], left[order], to[order]
    p = np.r_[payload, np.zeros(4, dtype=np.uint8)].astype(np.uint32)
    window = p[:-2] << np.uint32(16) | p[1:-1] << np.uint32(8) | p[2:]
    out = np.empty(int(sizes.sum()), dtype="<u4")
    active = len(left) - np.searchsorted(left[::-1], np.arange(STRIDE), side="right")
    for step in range(STRIDE):
        k = active[step]
        if not k:
            break
        at = where[:k]
        hit = table[window[at >> 3] >> (24 - limit - (at & 7)).astype(np.uint32) & np.uint32((1 << limit) - 1)]
        out[to[:k] + step] = hit >> np.uint32(8)
        where[:k] += hit & np.uint32(255)
    return out


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_codebook(folder: str, lengths: np.ndarray) -> None:
    files, path = _open(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/codebook") as f:
        f.write(_BOOK + struct.pack("<I", len(lengths)) + lengths.astype(np.uint8).tobytes())


def read_codebook(folder: str) -> np.ndarray:
    files, path = _open(folder)
    with files.open_input_file(f"{path}/codebook") as f:
        data = f.read()
    if data[:8] != _BOOK:
        raise ValueError(f"{folder} has no codebook")
    return np.frombuffer(data, dtype=np.uint8, offset=12)


def _write_shard(folder: str, rows: list[tuple]) -> tuple[str, int]:
    """rows: (id or None, ids, coded bytes). The file's name and size."""
    ids = np.array([0 if r[0] is None else r[0] for r in rows], dtype="<i8")
    valid = np.array([r[0] is not None for r in rows], dtype=np.uint8)
    n = np.array([r[1] for r in rows], dtype="<u8")
    block_bytes, marks, payload = [], [], []
    for _, size, data in rows:
        sizes = _blocks(np.array([size]))
        b, m = 4 * len(sizes), 4 * int((-(-sizes // STRIDE)).sum())
        block_bytes.append(data[:b])
        marks.append(data[b : b + m])
        payload.append(data[b + m :])
    body = b"".join(payload)
    head = _SHARD + struct.pack("<IIQ", len(rows), sum(map(len, block_bytes)) // 4, len(body))
    files, path = _open(folder)
    name = f"shard-{uuid.uuid4().hex}"
    with files.open_output_stream(f"{path}/{name}") as f:
        f.write(b"".join([head, ids.tobytes(), valid.tobytes(), n.tobytes(), *block_bytes, *marks, body]))
    return name, len(body)


def read_shard(folder: str, name: str, table: np.ndarray, limit: int = LIMIT):
    """(id or None, ids) of each document, in order; some documents are decoded at a time."""
    files, path = _open(folder)
    with files.open_input_file(f"{path}/{name}") as f:
        data = f.read()
    if data[:8] != _SHARD:
        raise ValueError(f"{name} is no shard")
    docs, blocks, size = struct.unpack_from("<IIQ", data, 8)
    at = 24

    def column(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype=kind, count=count, offset=at)
        at += out.nbytes
        return out

    ids, valid, n = column("<i8", docs), column("u1", docs), column("<u8", docs).astype(np.int64)
    per_doc = -(-n // BLOCK)
    sizes = _blocks(n)
    points = -(-sizes // STRIDE)
    block_bytes, marks, payload = column("<u4", blocks).astype(np.int64), column("<u4", int(points.sum())), column("u1", size)
    ends = np.cumsum(n)
    block_end, doc_block = np.r_[0, np.cumsum(block_bytes)], np.r_[0, np.cumsum(per_doc)]
    mark_end = np.r_[0, np.cumsum(points)]
    first = 0
    while first < docs:
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + 2_000_000, side="right")))
        b0, b1 = doc_block[first], doc_block[last]
        got = decode(n[first:last], block_bytes[b0:b1], marks[mark_end[b0] : mark_end[b1]], payload[block_end[b0] : block_end[b1]], table, limit)
        at_id = 0
        for i in range(first, last):
            yield (int(ids[i]) if valid[i] else None), got[at_id : at_id + n[i]]
            at_id += n[i]
        first = last


def _tokens(path: str, end_id: int):
    """(id, n, ids, counts): little-endian ids of two bytes where the vocabulary allows, else four; at the end of each task one row
    with n = 0 and the counts of all its ids as 64-bit numbers."""

    def run(frames):
        own = encoder(path, end_id)
        width = max(own.tokenizer.get_vocab_size(), end_id + 1)
        total = np.zeros(width, dtype="<i8")
        for pdf in frames:
            ids, texts = pdf["id"], pdf["text"].tolist()
            for a, b in groups(texts):
                data = own.encode(texts[a:b])
                n = [len(x) // 4 for x in data]
                flat = np.frombuffer(b"".join(data), dtype="<u4")
                total += np.bincount(flat, minlength=width)
                if width <= 1 << 16:
                    narrow, ends = flat.astype("<u2").tobytes(), (np.cumsum(n) * 2).tolist()
                    data = [narrow[x:y] for x, y in zip([0, *ends], ends, strict=False)]
                yield pd.DataFrame({"id": ids.iloc[a:b], "n": n, "ids": data, "counts": None})
        yield pd.DataFrame({"id": [None], "n": [0], "ids": [None], "counts": [total.tobytes()]})

    return run


def _ids(data, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if len(data) == 2 * n else "<u4")


def _counted(frames):
    """The counts of many tasks as one row for each id."""
    total = None
    for pdf in frames:
        for data in pdf["counts"]:
            c = np.frombuffer(data, dtype="<i8")
            total = c if total is None else total + c
    if total is not None:
        at = np.flatnonzero(total)
        yield pd.DataFrame({"token": at, "n": total[at]})


def _batches(sizes: list[int], most: int = 1_000_000):
    at = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def _coded(lengths: np.ndarray):
    def run(frames):
        codes = canonical(lengths)
        for pdf in frames:
            sizes, data = pdf["n"].tolist(), pdf["ids"].tolist()
            for a, b in _batches(sizes):
                documents = [_ids(x, n) for x, n in zip(data[a:b], sizes[a:b], strict=True)]
                yield pd.DataFrame({"id": pdf["id"].iloc[a:b], "n": sizes[a:b], "coded": encode(documents, lengths, codes)})

    return run


def _sharded(folder: str, most: int):
    def run(frames):
        from pyspark import TaskContext

        part, number, rows, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pd.DataFrame:
            name, _ = _write_shard(folder, rows)
            return pd.DataFrame({"part": [part], "number": [number], "name": [name], "docs": [len(rows)], "ids": [sum(r[1] for r in rows)]})

        for pdf in frames:
            for doc, n, coded in zip(pdf["id"], pdf["n"].tolist(), pdf["coded"], strict=True):
                rows.append((None if doc is None else int(doc), n, bytes(coded)))
                size += len(coded)
                if size >= most:
                    yield flush()
                    number, rows, size = number + 1, [], 0
        if rows:
            yield flush()

    return run


def _read(folder: str):
    def run(frames):
        table = decoding_table(read_codebook(folder))
        for pdf in frames:
            for name, start in zip(pdf["name"], pdf["start"].tolist(), strict=True):
                rows = []
                for doc, ids in read_shard(folder, name, table):
                    rows.append((None if doc is None else str(doc), start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                yield pd.DataFrame(rows, columns=["id", "start", "n_tokens", "ids_crc32"])

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """Writes codebook and shards into a new folder that all executors reach; gives the manifest (part, number, name, docs, ids, start)."""
    ship(docs.sparkSession)
    source = docs.select(whole(id).alias("id"), F.col(f"`{text}`").alias("text"))
    tokens = saved(source.mapInPandas(_tokens(tokenizer, end_id), "id string, n long, ids binary, counts binary"), "tokens")
    counts = tokens.where("n = 0").select("counts").mapInPandas(_counted, "token long, n long").groupBy("token").agg(F.sum("n")).collect()
    total = np.zeros(max((t for t, _ in counts), default=-1) + 1, dtype=np.int64)
    for t, n in counts:
        total[t] = n
    lengths = code_lengths(total)
    write_codebook(folder, lengths)
    coded = saved(with_long(tokens.where("n > 0").select("id", "n", "ids").mapInPandas(_coded(lengths), "id string, n long, coded binary")), "coded")
    discard(tokens)
    size = coded.agg(F.sum(F.length("coded"))).first()[0] or 0
    dealt = coded.repartitionByRange(max(1, -(-size // shard)), "id", "n").sortWithinPartitions("id", "n", "coded")
    manifest = saved(dealt.select(whole("id").alias("id"), "n", "coded").mapInPandas(_sharded(folder, 2 * shard), "part int, number int, name string, docs long, ids long"), "manifest")
    # a row for each shard
    return manifest.withColumn("start", F.sum("ids").over(Window.orderBy("part", "number")) - F.col("ids"))


def read(manifest: DataFrame, folder: str, id: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every stored document, from the files."""
    ship(manifest.sparkSession)
    n = max(1, manifest.count())
    rows = manifest.select("name", "start").repartition(n).mapInPandas(_read(folder), "id string, start long, n_tokens long, ids_crc32 long")
    return with_long(rows).withColumnRenamed("id", id)


def apply(docs: DataFrame, tokenizer: str, end_id: int = 1, id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Writes all documents and reads them back."""
    folder = folder or scratch(docs.sparkSession, "huffman")
    return read(write(docs, folder, tokenizer, end_id, id, text), folder, id)
