"""Packing along a space-filling curve.

A document's token ids are hashed into a count vector, projected to a few dimensions by a fixed random
matrix, and numbered along a Hilbert curve. Documents are range-sorted by that number, so neighbours on
the curve are neighbours in a sequence, and each range is packed as one stream cut every `LENGTH` ids.
The ids are encoded once and kept, compressed, in the shared checkpoint folder; what is sorted is that.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import cut, pieces, table, tasks
from heliograph.llm.tokens import ENCODED, default_path, encoder, press, unpress

LENGTH = 2048
END = 1
#: Hashed features, projected dimensions and bits of a dimension. DIMENSIONS * BITS must stay under 63.
FEATURES, DIMENSIONS, BITS = 1024, 4, 12


@functools.lru_cache(maxsize=4)
def _projection(vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """The feature of each id, and the matrix from features to dimensions."""
    ids = np.arange(vocabulary, dtype=np.uint64)
    return ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64) % FEATURES, np.random.default_rng(7).standard_normal((FEATURES, DIMENSIONS))


def coordinates(ids: np.ndarray, vocabulary: int) -> np.ndarray:
    """A document's cell in the grid; the middle one for a document without ids."""
    feature, matrix = _projection(vocabulary)
    vector = np.log1p(np.bincount(feature[ids], minlength=FEATURES))
    norm = np.sqrt((vector**2).sum())
    at = vector @ matrix / norm if norm else np.zeros(DIMENSIONS)
    return ((np.tanh(at) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Numbers along the Hilbert curve of the rows of `cells` (Skilling's transform, over all rows)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] ^= t if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, curve, ids): ids compressed, with the end id; curve the Hilbert number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.array([END], dtype=encode.dtype).tobytes()
        for batch in pieces(batches, ENCODED):
            ids, cells = [], []
            for own in encode.batch(batch["text"].to_pylist()):
                cells.append(coordinates(np.frombuffer(own, encode.dtype), encode.vocabulary))
                ids.append(press(own + end, encode.dtype))
            curve = hilbert(np.array(cells, dtype=np.int64).reshape(len(cells), DIMENSIONS))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(curve), pa.array(ids, pa.binary())], names=["doc_id", "curve", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, curve long, ids binary")


_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class _Packer:
    """Cuts a stream of documents into sequences; only the open sequence is held."""

    def __init__(self, length: int, first: int):
        self.length, self.next = length, first
        self.open: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.room = length
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at, total = 0, len(ids)
        while at < total:
            part = ids[at : at + self.room]
            self.open.append((doc_id, at, part, total))
            at += len(part)
            self.room -= len(part)
            if not self.room:
                self._close(self.open)
                self.open, self.room = [], self.length

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def finish(self) -> None:
        """The rest goes into sequences of a power of two each, which need no padding."""
        left = self.open
        while size := sum(len(x[2]) for x in left):
            room, pieces, rest = 1 << (size.bit_length() - 1), [], []
            for doc_id, start, ids, total in left:
                if room:
                    pieces.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    rest.append((doc_id, start + room, ids[room:], total))
                room -= min(room, len(ids))
            self._close(pieces)
            left = rest
        self.open = []

    def out(self) -> pa.RecordBatch:
        columns = [list(x) for x in zip(*self.rows)] if self.rows else [[]] * len(_COLUMNS)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=list(_COLUMNS))


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """The pieces of all documents, each in one sequence of at most `length` ids.

    A document's ids are its text's (null: none) and the id 1. Every id lies in exactly one piece, so a
    null or empty text is one piece of one id, and rows that repeat are documents of their own. Columns:
    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Sequences are full but for the
    last ones of each range of the curve, which have a power of two of ids. Rows of one place on the curve
    are sorted and split by doc_id, so a large group of copies spreads over ranges. Texts are taken whole, whatever their
    length; other columns are not looked at; an empty table gives no rows.
    """
    path = path or default_path()
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(length, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist()):
                packer.add(doc_id, unpress(ids).astype("<u4"))
            yield packer.out()
        packer.finish()
        yield packer.out()

    order = ("curve", "doc_id")
    ranged = cut(encoded(docs, path)).repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order)
    return ranged.select("doc_id", "ids").mapInArrow(run, ", ".join(f"{c} long" for c in _COLUMNS))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pack` of all of the table `documents`."""
    return pack(table(spark, sf_dir, "documents"))
