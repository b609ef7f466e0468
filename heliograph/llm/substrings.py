"""Exact removal of passages that repeat, behind a count-min prefilter.

A window is `WINDOW` consecutive words of one document. Its anchor is the smallest hash among its
19 runs of 17 words: equal windows have equal anchors, so the number of places where an anchor is a
window's smallest run is at least the number of windows with that content.

Pass 1 counts the anchors' places in a count-min sketch of a size bound, one part for each task, merged
by cell range. The merged sketch overestimates only. Pass 2 reads the texts again and sends on only
windows whose anchor is estimated to be at two or more places, keyed by 96 bits of hashes of all their
words. Windows that a task meets twice are settled there, and it sends one representative; so a
passage found in a third of all documents arrives at its group once for each task, never once for each
document. Groups are exact: a chance collision of the sketch only costs the work of sending a window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import pieces, table, tasks

WINDOW = 35
RUN = 17
#: Rows of the sketch, and cells (as powers of two) in the part that one merging step holds and in a
#: row at most. The merged sketch has one bit for each cell, so it never exceeds DEPTH * 2**MOST bits, 128 MB.
DEPTH, LOG_PART, MOST = 2, 20, 29
#: Windows that a task gathers before it settles and sends them.
CHUNK = 2_000_000
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Rolling:
    """Polynomial hashes of all runs of a length, for one odd base modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def __call__(self, codes: np.ndarray, length: int) -> np.ndarray:
        n = len(codes)
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, 2 * n), _powers(self.inverse, 2 * n)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes * self.up[:n], out=total[1:])
        return _mix((total[length:] - total[:-length]) * self.down[: n - length + 1])


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each `width` neighbours."""
    done = 1
    while 2 * done <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return x if done == width else pick(x[: len(x) - (width - done)], x[width - done :])


class _Reader:
    """Hashes of the windows of a text: anchors and keys."""

    def __init__(self, window: int):
        self.window, self.run = window, min(RUN, window)
        self.first, self.second = _Rolling(_ODD[0]), _Rolling(_ODD[1])

    def codes(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8").split()
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def anchors(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(runs, anchor of each window); needs at least one window."""
        runs = self.first(codes, self.run)
        return runs, _sliding(runs, self.window - self.run + 1, np.minimum)

    def places(self, codes: np.ndarray) -> np.ndarray:
        """The anchor hash of every place that is the smallest run of some window around it."""
        runs, anchors = self.anchors(codes)
        width = self.window - self.run + 1
        pad = np.zeros(width - 1, dtype=np.uint64)
        return runs[_sliding(np.concatenate([pad, anchors, pad]), width, np.maximum) == runs]


def _cells(anchors: np.ndarray, width: int) -> list[np.ndarray]:
    return [(anchors * np.uint64(_ODD[2]) if row else anchors) >> np.uint64(64 - width) for row in range(DEPTH)]


def width_for(docs: DataFrame) -> int:
    """log2 of a row's cells: four for each anchor that the texts may have, within the bounds.

    A text has an anchor for some 60 characters. Beyond the largest width the sketch still only overestimates,
    and more windows are sent than need be.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(MOST, max(LOG_PART, (4 * chars // 60).bit_length()))


def sketch(docs: DataFrame, width: int, window: int = WINDOW) -> bytes:
    """The merged sketch as bits, row by row: set where a cell counts two places or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, size = _Reader(window), [], 0

        def out() -> pa.RecordBatch:
            places, rows = np.concatenate(held), []
            for row, cells in enumerate(_cells(places, width)):
                cells, n = np.unique(cells, return_counts=True)
                parts = cells >> np.uint64(LOG_PART)
                cuts = np.flatnonzero(np.diff(parts, prepend=parts[:1] + np.uint64(1)))
                for a, b in zip(cuts, [*cuts[1:], len(cells)]):
                    inside = (cells[a:b] & np.uint64((1 << LOG_PART) - 1)).astype("<u4")
                    rows.append(((row << (width - LOG_PART)) + int(parts[a]), inside.tobytes(), np.packbits(n[a:b] > 1).tobytes()))
            return _frame(list(zip(*rows)), (pa.int32(), pa.binary(), pa.binary()), ["part", "cells", "twice"])

        for batch in pieces(batches):
            for text in batch["text"].to_pylist():
                codes = reader.codes(text)
                if len(codes) >= window:
                    held.append(reader.places(codes))
                    size += len(held[-1])
                    if size >= CHUNK:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = -1, np.zeros(1 << LOG_PART, dtype=np.uint8)

        def out() -> pa.RecordBatch:
            return _frame([[part], [zlib.compress(np.packbits(counts > 1).tobytes(), 1)]], (pa.int32(), pa.binary()), ["part", "bits"])

        for batch in batches:
            for p, cells, twice in zip(*(batch[c].to_pylist() for c in ("part", "cells", "twice"))):
                if p != part:
                    if part >= 0:
                        yield out()
                    part, counts = p, np.zeros(1 << LOG_PART, dtype=np.uint8)
                at = np.frombuffer(cells, "<u4")
                more = 1 + np.unpackbits(np.frombuffer(twice, np.uint8), count=len(at))
                counts[at] = np.minimum(counts[at] + more, 2)
        if part >= 0:
            yield out()

    parts = docs.select("text").mapInArrow(count, "part int, cells binary, twice binary")
    merged = parts.repartitionById(tasks(docs.sparkSession), "part").sortWithinPartitions("part").mapInArrow(merge, "part int, bits binary")
    bits = bytearray(DEPTH << (width - 3))
    step = 1 << (LOG_PART - 3)
    for row in merged.toLocalIterator():  # at most DEPTH * 2**(width - LOG_PART) rows
        bits[row.part * step : (row.part + 1) * step] = zlib.decompress(row.bits)
    return bytes(bits)


def _estimated_repeated(bits: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    found, width = np.ones(len(anchors), dtype=bool), (8 * len(bits) // DEPTH).bit_length() - 1
    for row, cells in enumerate(_cells(anchors, width)):
        octets = bits[(row << (width - 3)) + (cells >> np.uint64(3)).astype(np.int64)]
        found &= (octets >> (np.uint64(7) - (cells & np.uint64(7))).astype(np.uint8)) & 1 == 1
    return found


_ROW = np.dtype([("h", "<u8"), ("g", "<u4"), ("doc", "<u8"), ("at", "<u4")])
_SETTLED = 0xFFFFFFFF  #: the position of a representative of windows that a task has settled


def _press(docs: np.ndarray, at: np.ndarray) -> bytes:
    """Positions by document, for rows in order of documents and positions."""
    cuts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    sizes = np.diff(np.r_[cuts, len(docs)])
    steps = np.diff(at.astype("<u4"), prepend=np.uint32(0))
    return np.array([len(cuts), len(docs)], "<u4").tobytes() + zlib.compress(docs[cuts].astype("<u8").tobytes() + sizes.astype("<u4").tobytes() + steps.astype("<u4").tobytes(), 1)


def _unpress(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, number of positions of each, positions)"""
    n, m = np.frombuffer(data, "<u4", 2).tolist()
    raw = zlib.decompress(data[8:])
    return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u4", n, 8 * n), np.cumsum(np.frombuffer(raw, "<u4", m, 12 * n), dtype=np.uint32)


def _by(part: np.ndarray, docs: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, indices) of the rows of each part, in order of documents and positions."""
    order = np.lexsort((at, docs, part))
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1)) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        yield int(part[order[a]]), order[a:b]


def _covers(docs: np.ndarray, at: np.ndarray, n: int) -> list[tuple[int, bytes]]:
    """Positions of repeated windows, one row for each bucket of documents."""
    return [(k, _press(docs[i], at[i])) for k, i in _by((docs % np.uint64(n)).astype(np.int64), docs, at)]


def _frame(columns: list, kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _key(doc_id: int | None, text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8"), (doc_id or 0) & (1 << 64) - 1)


def _repeated(docs: DataFrame, bits: Broadcast, window: int, n: int) -> DataFrame:
    """(bucket, cover): packed positions of windows whose words start elsewhere too.

    A row holds what one task found for one of the `n` buckets of documents, so there are at most as
    many rows as pairs of tasks. Windows are dealt out by their hash.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, size = _Reader(window), [], 0
        seen = np.frombuffer(bits.value, np.uint8)

        def out() -> pa.RecordBatch:
            rows = np.concatenate(held)
            rows = rows[np.lexsort((rows["g"], rows["h"]))]
            first = np.r_[True, (rows["h"][1:] != rows["h"][:-1]) | (rows["g"][1:] != rows["g"][:-1])]
            alone = first & np.r_[first[1:], True]
            local = _covers(rows["doc"][~alone], rows["at"][~alone], n)
            rows, alone = rows[first], alone[first]
            rows["doc"][~alone], rows["at"][~alone] = 0, _SETTLED
            part = ((rows["h"] >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
            sent = [(k, rows["h"][i].tobytes() + rows["g"][i].tobytes(), _press(rows["doc"][i], rows["at"][i])) for k, i in _by(part, rows["doc"], rows["at"])]
            columns = [[*(k for k, _, _ in sent), *(k for k, _ in local)], [*(x for _, x, _ in sent), *(None for _ in local)], [*(x for _, _, x in sent), *(x for _, x in local)]]
            return _frame(columns, (pa.int32(), pa.binary(), pa.binary()), ["part", "hashes", "cover"])

        for batch in pieces(batches):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                codes = reader.codes(text)
                if len(codes) < window:
                    continue
                at = np.flatnonzero(_estimated_repeated(seen, reader.anchors(codes)[1]))
                if not len(at):
                    continue
                rows = np.empty(len(at), dtype=_ROW)
                rows["h"], rows["g"] = reader.first(codes, window)[at], (reader.second(codes, window)[at] >> np.uint64(32)).astype(np.uint32)
                rows["doc"], rows["at"] = _key(doc_id, text), at
                held.append(rows)
                size += len(rows)
                if size >= CHUNK:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            local = []
            for part, hashes, cover in zip(*(batch[c].to_pylist() for c in ("part", "hashes", "cover"))):
                if hashes is None:
                    local.append((part, cover))
                    continue
                docs_, sizes, at = _unpress(cover)
                rows = np.empty(len(at), dtype=_ROW)
                rows["h"], rows["g"] = np.frombuffer(hashes, "<u8", len(at)), np.frombuffer(hashes, "<u4", len(at), 8 * len(at))
                rows["doc"], rows["at"] = np.repeat(docs_, sizes), at
                held.append(rows)
            yield _frame([[k for k, _ in local], [x for _, x in local]], (pa.int32(), pa.binary()), ["bucket", "cover"])
        if held:
            rows = np.concatenate(held)
            held.clear()
            rows = rows[np.lexsort((rows["g"], rows["h"]))]
            new = np.r_[True, (rows["h"][1:] != rows["h"][:-1]) | (rows["g"][1:] != rows["g"][:-1])]
            many = ~(new & np.r_[new[1:], True]) & (rows["at"] != _SETTLED)
            found = _covers(rows["doc"][many], rows["at"][many], n)
            yield _frame([[k for k, _ in found], [x for _, x in found]], (pa.int32(), pa.binary()), ["bucket", "cover"])

    sent = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(send, "part int, hashes binary, cover binary")
    return sent.repartitionById(n, "part").mapInArrow(settle, "bucket int, cover binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`doc_id`, n_words, n_removed and the kept words, joined by one space, of every row of `docs`.

    A word goes if a window that covers it has the word sequence of a window that starts anywhere
    else, in the same document or in another, judged on the input. Words are maximal runs without
    ASCII white space, unchanged. A null or empty text has no words; texts of fewer than `window` words
    stay as they are, and one of any length is read whole. Rows that repeat a document are places of their own, so they lose their
    windows. Other columns of `docs` are not looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bits, n = spark.sparkContext.broadcast(sketch(docs, width_for(docs), window)), tasks(spark)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            bucket = [_key(i, t or "") % n for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), batch["doc_id"], batch["text"]], names=["bucket", "doc_id", "text"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, covers = -1, {}
        for batch in pieces(batches):
            ids, n_words, n_removed, texts = [], [], [], []
            for b, doc_id, text, cover in zip(*(batch[c].to_pylist() for c in ("bucket", "doc_id", "text", "cover"))):
                if b != bucket:
                    bucket, covers = b, {}
                if cover is not None:  # a bucket's positions come before its texts
                    keys, sizes, at = _unpress(cover)
                    for key, own in zip(keys.tolist(), np.split(at, np.cumsum(sizes)[:-1])):
                        covers.setdefault(key, []).append(own)
                    continue
                words = (text or "").encode("utf-8").split()
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                for at in covers.get(_key(doc_id, text or ""), ()):
                    starts = np.unique(at).astype(np.int64)
                    edge[starts] += 1
                    edge[starts + window] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
                ids.append(doc_id)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                texts.append(b" ".join(kept).decode("utf-8"))
            yield _frame([ids, n_words, n_removed, texts], (pa.int64(), pa.int64(), pa.int64(), pa.string()), ["doc_id", "n_words", "n_removed", "kept"])

    texts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(deal, "bucket int, doc_id long, text string")
    rows = _repeated(docs, bits, window, n).selectExpr("bucket", "0 AS kind", "CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", "cover")
    rows = rows.union(texts.selectExpr("bucket", "1 AS kind", "doc_id", "text", "CAST(NULL AS BINARY) AS cover"))
    dealt = rows.repartitionById(n, "bucket").sortWithinPartitions("bucket", "kind")
    return dealt.select("bucket", "doc_id", "text", "cover").mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`remove_repeats` of all of the table `documents`, with a digest of what is kept."""
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same by plain SQL: every window of every document, grouped.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d
), h AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS k FROM s
), r AS (
  SELECT doc_id, i FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)
), g AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS gone FROM r GROUP BY doc_id
), e AS (
  SELECT doc_id, w, list_filter(w, lambda x, j: NOT list_contains(coalesce(gone, []), j)) AS kept FROM d LEFT JOIN g USING (doc_id)
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM e
"""
