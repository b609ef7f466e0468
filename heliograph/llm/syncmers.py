"""Document fingerprints of closed syncmers.

A run of K characters is an anchor if the smallest of its inner runs of S characters lies at its
left or right edge. That depends on the run's own characters alone, so equal passages have the same
anchors wherever they stand. A fingerprint keeps all anchors of the text, each once, in the order of their
first positions; two fingerprints match on the anchors that both have, as far as they stand in the same
order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import pieces, table, tasks

K, S = 16, 8
#: Texts of fewer than SHORT characters also have the anchors of shorter runs.
SHORT, SHORT_K, SHORT_S = 128, 4, 2
#: Characters whose hashes are held at once; longer texts are taken in overlapping pieces.
PIECE = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _runs(x: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hashes of all runs of `length` (a power of two), by doubling."""
    size, power = 1, base
    while size < length:
        x = x[:-size] * np.uint64(power) + x[size:]
        size, power = 2 * size, power * power % (1 << 64)
    return _mix(x)


def _anchors(codes: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the closed syncmers of a piece of text; k and s are powers of two."""
    inner = _runs(codes, s, 0x9E3779B97F4A7C15)
    width = k - s + 1
    least, done = inner, 1
    while 2 * done <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < width:
        least = np.minimum(least[: len(least) - (width - done)], least[width - done :])
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[width - 1 :] == least))
    return _runs(codes, k, 0xC2B2AE3D27D4EB4F)[at], at


def _firsts(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes in order of their first positions, and these."""
    order = np.lexsort((at, hashes))
    hashes, at = hashes[order], at[order]
    first = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.zeros(0, bool)
    hashes, at = hashes[first], at[first]
    order = np.argsort(at, kind="stable")
    return hashes[order], at[order]


def fingerprint(text: str) -> np.ndarray:
    """All different anchors of a text in order of first position, as 64-bit numbers.

    A text without an anchor has its whole as its one anchor; an empty one has none.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    if not len(codes):
        return np.zeros(0, np.uint64)
    hashes, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a in range(0, max(1, len(codes) - K + 1), PIECE):
        piece = codes[a : a + PIECE + K - 1]
        if len(piece) >= K:
            h, p = _firsts(*_anchors(piece))
            hashes.append(h)
            at.append(p + a)
    if SHORT_K <= len(codes) < SHORT:
        h, p = _anchors(codes, SHORT_K, SHORT_S)
        hashes.append(h)
        at.append(p)
    found = _firsts(np.concatenate(hashes), np.concatenate(at))[0]
    if not len(found):
        return np.frombuffer(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:8], "<u8")
    return found


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share, 0 to 1, of the anchors of both texts together that they have in the same order.

    Two empty fingerprints are alike, an empty one and another are not.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    _, of_a, of_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    places = of_b[np.argsort(of_a)]  # where b has what both have, in the order of a
    both = len(a) + len(b) - len(places)
    if (places[1:] > places[:-1]).all():
        return len(places) / both
    tails: list[int] = []  # the longest increasing run of places
    for k in places.tolist():
        p = bisect_left(tails, k)
        tails[p : p + 1] = [k]
    return len(tails) / both


def text_of(fingerprint: np.ndarray) -> str:
    """All anchors in order, 16 hex digits each."""
    return fingerprint.astype(">u8").tobytes().hex()


def edited(text: str, other: str) -> str:
    """`text` with its last half replaced by as much of the beginning of `other`."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def neighbours(docs: DataFrame) -> DataFrame:
    """(part, guest, doc_id, text): rows dealt to ranges of descending doc_id, each in one task and sorted.

    A range ends with a guest, the first row of the next range (after the last: of the first), so the
    document after each is in its task. Texts are shuffled once. Ties of doc_id are sorted by text.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    parts = tasks(docs.sparkSession)
    bounds = docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = sorted({int(b) for b in bounds})
    place = lambda i: 0 if i is None else int(np.searchsorted(bounds, i, side="right"))

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[int, int | None] = {}
            for i in batch["doc_id"].to_pylist():
                p = place(i)
                if best.get(p) is None or (i is not None and i > best[p]):
                    best[p] = i
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.int64())], names=["part", "doc_id"])

    tops = docs.select("doc_id").mapInArrow(top, "part int, doc_id long").groupBy("part").agg(F.max("doc_id").alias("doc_id"))
    tops = sorted(tops.collect(), key=lambda row: -row.part)  # one row for each range that has rows
    firsts = {row.doc_id: tops[k - 1].part for k, row in enumerate(tops)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids = batch["doc_id"].to_pylist()
            own = [place(i) for i in ids]
            take = [k for k, i in enumerate(ids) if i in firsts]
            index = pa.array([*range(len(ids)), *take], pa.int64())
            part = [*own, *(firsts[ids[k]] for k in take)]
            guest = [0] * len(ids) + [1] * len(take)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(guest, pa.int32()), batch["doc_id"].take(index), batch["text"].take(index)], names=["part", "guest", "doc_id", "text"])

    dealt = docs.mapInArrow(deal, "part int, guest int, doc_id long, text string")
    order = [F.col("part").desc(), F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("text")]
    return dealt.repartitionById(parts, "part").sortWithinPartitions(*order)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next text's are.

    The next document is the one after it by descending doc_id (nulls last, rows of one doc_id by text),
    after the last the first; a single document is its own next. Null texts are empty. Equal texts have
    equal fingerprints. Texts are taken whole, long ones in overlapping pieces. Rows that repeat a doc_id lie in one range, as
    their order asks for. Other columns are not looked at; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, seen = None, None, False
        for batch in pieces(batches):
            rows = []
            for p, guest, doc_id, text in zip(*(batch[c].to_pylist() for c in ("part", "guest", "doc_id", "text"))):
                if p != part:
                    part, before, seen = p, None, False
                if guest and seen:
                    continue  # only the first of rows that share the guest's doc_id is next
                own = fingerprint(text)
                if before is not None:
                    rows.append(_row(*before, text, own))
                before, seen = (None, True) if guest else ((doc_id, text, own), False)
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=[x.split(" ")[0] for x in _SCHEMA.split(", ")])

    return neighbours(docs).mapInArrow(run, _SCHEMA)


def _row(doc_id: int | None, text: str, own: np.ndarray, other: str, others: np.ndarray) -> tuple:
    new = edited(text, other)
    news = own if new == text else fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8")).hexdigest(), text_of(own), text_of(news), likeness(own, news), likeness(own, others)


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`compare_with_next` of all of the table `documents`."""
    return compare_with_next(table(spark, sf_dir, "documents"))
