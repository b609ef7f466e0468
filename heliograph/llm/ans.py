"""Token-ID files, coded by a static range asymmetric numeral system.

A segment holds the ids of consecutive documents. Layout, all little-endian:

    magic 'HRANS1\\0\\0' | header length u4 | header, zlib: JSON with sizes
    | symbols, frequencies (u4, zlib)         one table for all blocks of the segment
    | document ids (i8), their nulls (u1), lengths (u4), zlib
    | checkpoints: for each block its lanes' first states (u8), words (u4), ids (u4), crc32 (u4)
    | words (u4) of each block

A block is LANES interleaved coders over the shared table and is decoded without any other block; the
checkpoints say where it begins and in which states, and its crc32 is checked when it is read. numpy
codes all lanes of a group of blocks at once. Segments are cells of a Parquet table with columns
(part, segment, before, n_tokens, payload), before the ids of the part's earlier segments, in ascending order of document ids by (part, segment), so any store
that Spark can write to will do, a lost task is run again under Spark's commit protocol, and readers
split the work by segment.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.graph import cut, remove, shared_folder
from heliograph.llm.common import pieces, table, tasks
from heliograph.llm.tokens import ENCODED, default_path, encoder, press, unpress

MAGIC = b"HRANS1\0\0"
SCALE = 18  # bits of the frequency table's total
LANES, STEPS = 512, 512  # a block is LANES * STEPS ids
SEGMENT = 1 << 21  # ids after which a segment is closed
END = 0
SAMPLED = 200  # ids of a range that its bounds are taken from
BEFORE_ALL = -(1 << 63) - 1  # where nulls are among the ids
_LOW = np.uint64(1 << 31)
_SEGMENTS = "part int, segment int, before long, n_tokens long, payload binary"


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies of the symbols counted, each at least 1, of total 2**SCALE."""
    total = 1 << SCALE
    out = np.maximum(1, counts.astype(np.float64) * (total / counts.sum())).astype(np.int64)
    while (extra := int(out.sum()) - total) > 0:
        k = int(out.argmax())
        out[k] -= min(extra, int(out[k]) // 2)
    out[int(out.argmax())] += total - int(out.sum())
    return out


def _encode(symbols: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """symbols: (blocks, steps, lanes). First states (blocks, lanes), words, words of each block."""
    blocks, steps, lanes = symbols.shape
    by_step = np.ascontiguousarray(symbols.transpose(1, 0, 2)).reshape(steps, -1)
    state = np.full(blocks * lanes, _LOW, dtype=np.uint64)
    owner = np.repeat(np.arange(blocks, dtype=np.uint16), lanes)
    limit, rest = freq << np.uint64(63 - SCALE), np.uint64(1 << SCALE) - freq
    words, owners = [], []
    for t in range(steps - 1, -1, -1):
        s = by_step[t]
        full = np.flatnonzero(state >= limit.take(s))
        if len(full):
            x = state.take(full)
            words.append(x.astype(np.uint32))
            owners.append(owner.take(full))
            state[full] = x >> np.uint64(32)
        state += state // freq.take(s) * rest.take(s) + cum.take(s)
    words.reverse()
    owners.reverse()
    words, owners = (np.concatenate(words), np.concatenate(owners)) if words else (np.zeros(0, np.uint32), np.zeros(0, np.uint16))
    return state.reshape(blocks, lanes), words[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=blocks)


def _decode(state: np.ndarray, words: np.ndarray, sizes: np.ndarray, steps: int, freq: np.ndarray, cum: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Symbols (blocks, steps, lanes) from first states (blocks, lanes) and words of the blocks in order."""
    blocks, lanes = state.shape
    at = (np.cumsum(sizes) - sizes)[:, None]
    state, out = state.reshape(-1).copy(), np.empty((blocks, steps, lanes), dtype=slots.dtype)
    mask = np.uint64((1 << SCALE) - 1)
    for t in range(steps):
        slot = state & mask
        s = slots.take(slot.view(np.int64))
        out[:, t] = s.reshape(blocks, lanes)
        state = freq.take(s) * (state >> np.uint64(SCALE)) + slot - cum.take(s)
        need = state < _LOW
        rank = np.cumsum(need.reshape(blocks, lanes), axis=1)
        low = np.flatnonzero(need)
        if len(low):
            take = (at + rank - 1).reshape(-1).take(low)
            if take.max() >= len(words):
                raise ValueError("damaged block: its words run out")
            state[low] = (state.take(low) << np.uint64(32)) | words.take(take)
            at = at + rank[:, -1:]
    if not (state == _LOW).all():
        raise ValueError("damaged block: the coder did not return to its first state")
    return out


def write_segment(documents: list[tuple[int | None, np.ndarray]]) -> bytes:
    """A segment of documents (id or None, ids). Documents and segments may be empty."""
    lengths = np.array([len(x) for _, x in documents], dtype="<u4")
    ids = np.concatenate([np.zeros(0, np.uint32), *(x for _, x in documents)]).astype("<u4")
    symbols, counts = np.unique(ids, return_counts=True)
    place = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 0, dtype=np.int32)
    place[symbols] = np.arange(len(symbols))
    dense = place[ids]
    freq = frequencies(counts).astype(np.uint64) if len(ids) else np.zeros(0, np.uint64)
    cum = np.cumsum(freq) - freq
    size = LANES * STEPS
    whole = len(ids) // size
    states, words, sizes, sums = [], [], [], []
    for a, b in ((0, whole * size), (whole * size, len(ids))):
        if b > a:
            part = dense[a:b]
            blocks, lanes = max(1, (b - a) // size), min(LANES, max(1, (b - a) // 64))
            if a or b < size:  # the last block: filled up with its first id
                part = np.concatenate([part, np.full(-(b - a) % lanes, part[0], dtype=part.dtype)])
            first, own, n = _encode(part.reshape(blocks, -1, lanes), freq, cum)
            states.append(first.astype("<u8").tobytes())
            words.append(own.astype("<u4").tobytes())
            sizes += n.tolist()
            sums += [zlib.crc32(ids[k : min(k + size, b)].tobytes()) for k in range(a, b, size)]
    names = np.array([0 if i is None else i for i, _ in documents], dtype="<i8")
    nulls = np.array([i is None for i, _ in documents], dtype=np.uint8)
    tables = zlib.compress(np.concatenate([np.diff(symbols, prepend=np.uint32(0)), freq]).astype("<u4").tobytes(), 6)
    names = zlib.compress(np.diff(names, prepend=np.int64(0)).astype("<i8").tobytes() + nulls.tobytes() + lengths.tobytes(), 6)
    checks = b"".join(states) + np.array([sizes, sums], dtype="<u4").tobytes()
    head = {"documents": len(documents), "ids": len(ids), "symbols": len(symbols), "scale": SCALE, "lanes": LANES, "steps": STEPS, "tables": len(tables), "names": len(names), "checks": len(checks), "check": zlib.crc32(checks, zlib.crc32(names, zlib.crc32(tables)))}
    head = zlib.compress(json.dumps(head).encode())
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, tables, names, checks, *words])


def read_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, their lengths, all ids), checked against the segment's sums."""
    if payload[:8] != MAGIC:
        raise ValueError("not a segment")
    at = 12 + struct.unpack("<I", payload[8:12])[0]
    head = json.loads(zlib.decompress(payload[12:at]))
    tables, names, checks = (payload[(s := at + sum(head[k] for k in ("tables", "names", "checks")[:j])) : s + head[name]] for j, name in enumerate(("tables", "names", "checks")))
    if zlib.crc32(checks, zlib.crc32(names, zlib.crc32(tables))) != head["check"]:
        raise ValueError("damaged segment: tables or checkpoints")
    words = np.frombuffer(payload, "<u4", offset=at + len(tables) + len(names) + len(checks))
    table_ = np.frombuffer(zlib.decompress(tables), "<u4")
    symbols, freq = np.cumsum(table_[: head["symbols"]], dtype=np.uint32), table_[head["symbols"] :].astype(np.uint64)
    cum = np.cumsum(freq) - freq
    slots = np.repeat(np.arange(len(freq)), freq.astype(np.int64)).astype(np.uint32)
    n, size = head["ids"], head["lanes"] * head["steps"]
    whole, rest = divmod(n, size)
    lanes = min(head["lanes"], max(1, rest // 64))
    count = whole + bool(rest)
    states = np.frombuffer(checks[: len(checks) - 8 * count], "<u8")
    sizes, sums = np.frombuffer(checks[len(checks) - 8 * count :], "<u4").reshape(2, count)
    out = [np.zeros(0, np.uint32)]
    if whole:
        out.append(_decode(states[: whole * head["lanes"]].reshape(whole, -1), words, sizes[:whole].astype(np.int64), head["steps"], freq, cum, slots).reshape(-1))
    if rest:
        own = words[int(sizes[:whole].astype(np.int64).sum()) :]
        out.append(_decode(states[whole * head["lanes"] :].reshape(1, lanes), own, sizes[whole:].astype(np.int64), -(-rest // lanes), freq, cum, slots).reshape(-1)[:rest])
    ids = symbols[np.concatenate(out)].astype("<u4") if n else np.zeros(0, "<u4")
    for k in range(count):
        if zlib.crc32(ids[k * size : (k + 1) * size].tobytes()) != sums[k]:
            raise ValueError(f"damaged block {k}")
    raw, m = zlib.decompress(names), head["documents"]
    keys = np.cumsum(np.frombuffer(raw[: 8 * m], "<i8")).tolist()
    nulls = np.frombuffer(raw[8 * m : 9 * m], np.uint8).tolist()
    return [None if z else k for k, z in zip(keys, nulls)], np.frombuffer(raw[9 * m :], "<u4"), ids


def bounds_of(docs: DataFrame, parts: int) -> list[int]:
    """parts - 1 ascending bounds that deal ids to ranges of like size, as whole numbers, nulls as BEFORE_ALL.

    They are quantiles of a sample of some SAMPLED ids a range, which only balances the ranges: any bounds give the same
    result. An id that many rows have comes as many times as it should have ranges.
    """
    ids = docs.select("doc_id")
    n = ids.count() if parts > 1 else 0
    if not n:
        return []
    share = SAMPLED * parts / n
    taken = (ids.sample(share, seed=17) if share < 1 else ids).collect()
    found = sorted(BEFORE_ALL if r.doc_id is None else r.doc_id for r in taken)
    return [found[k * len(found) // parts] for k in range(1, parts)] if found else []


def write_tokens(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Encode the texts of `docs` and write their ids, each document ended by END, into `folder`.

    Documents are ordered by ascending doc_id, nulls first; rows that repeat a doc_id are documents of
    their own. Null and empty texts have the end id alone; a text of any length is one document; an empty table gives
    no segments; other columns are not looked at. There are as many ranges of doc_id as shuffle partitions; `bounds_of` cuts
    them. Texts are read and encoded once, and only compressed ids are shuffled. A doc_id (or null) that bounds fall on is
    spread over the ranges on either side of them by a hash of the text and, for rows equal in both, by how often the task has met them, so
    that any order of a task's rows deals the same rows to the same ranges; inside a range its rows are in order of their ids.
    """
    path = path or default_path()
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    parts = tasks(docs.sparkSession)
    bounds = bounds_of(docs, parts)

    def place(doc_id: int | None, text: str | None, met: dict[tuple, int]) -> int:
        key = BEFORE_ALL if doc_id is None else doc_id
        low, high = bisect_left(bounds, key), bisect_right(bounds, key)
        if low == high:
            return high
        digest = xxhash.xxh64_intdigest((text or "").encode("utf-8"))
        met[key, digest] = met.get((key, digest), -1) + 1
        return low + (digest + met[key, digest]) % (high - low + 1)

    def encode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.array([END], dtype=encode.dtype).tobytes()
        met: dict[tuple, int] = {}
        for batch in pieces(batches, ENCODED):
            texts = batch["text"].to_pylist()
            ids = [press(x + end, encode.dtype) for x in encode.batch(texts)]
            part = [place(i, x, met) for i, x in zip(batch["doc_id"].to_pylist(), texts)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch["doc_id"], pa.array(ids, pa.binary())], names=["part", "doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, before, held, size = -1, 0, 0, [], 0

        def out() -> pa.RecordBatch:
            columns = [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([write_segment(held)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "segment", "before", "n_tokens", "payload"])

        for batch in batches:
            for p, doc_id, ids in zip(batch["part"].to_pylist(), batch["doc_id"].to_pylist(), batch["ids"].to_pylist()):
                if held and (p != part or size >= SEGMENT):
                    yield out()
                    segment, before, held, size = *((segment + 1, before + size) if p == part else (0, 0)), [], 0
                part = p
                held.append((doc_id, unpress(ids)))
                size += len(held[-1][1])
        if held:
            yield out()

    sent = docs.mapInArrow(encode_all, "part int, doc_id long, ids binary").repartitionById(parts, "part").sortWithinPartitions("part", "doc_id", "ids")
    sent.mapInArrow(write, _SEGMENTS).write.option("compression", "none").parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (int array) of every document written, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for base, names, lengths, ids in _segments(batches):
            starts = np.cumsum(lengths, dtype=np.int64) - lengths
            whole = [ids[s : s + n].tolist() for s, n in zip(starts.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts + base), pa.array(lengths.astype(np.int64)), pa.array(whole, pa.list_(pa.int32()))], names=["doc_id", "start", "n_tokens", "ids"])

    return _placed(spark, folder).mapInArrow(read, "doc_id long, start long, n_tokens long, ids array<int>")


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document written, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for base, names, lengths, ids in _segments(batches):
            starts = np.cumsum(lengths, dtype=np.int64) - lengths
            data = memoryview(ids.tobytes())
            sums = [zlib.crc32(data[4 * s : 4 * (s + n)]) for s, n in zip(starts.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts + base), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(spark, folder).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):  # one payload at a time
            yield (batch["base"][k].as_py(), *read_segment(batch["payload"][k].as_py()))


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """The segments with `base`, the ids of all documents before them."""
    files = spark.read.schema(_SEGMENTS).parquet(folder)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    bases = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # One row for each range, of which there are as many as shuffle partitions.
    return files.join(F.broadcast(bases), F.col("part") == F.col("p")).select((F.col("base") + F.col("before")).alias("base"), "payload")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of all of `documents` from files that are written into the shared folder, read back, and removed."""
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), folder)
    out = cut(token_digests(spark, folder))
    remove(spark, folder)
    return out
