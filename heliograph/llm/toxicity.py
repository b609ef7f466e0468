"""Toxicity by the nearest labelled examples under TF-IDF cosine.

A bounded sample of the labelled rows of either label is fitted. All terms of these examples, words and their beginnings, make the
vocabulary; labels have no say in it. Document frequencies are counted over all documents, and the
examples become an inverted index whose postings are cut into blocks with the largest weight of each
term in each block. The exact nearest examples of a document are found by summing these into an upper bound for
each block, scoring the most promising blocks, and then only those that can still beat the worst neighbour held.
The neighbours' votes, weighted by cosine, are calibrated by a logistic curve that is fitted on the
examples themselves, each by the votes of the others; the neighbours are the score's evidence.

The index is of at most about MAX_TOXIC + MAX_CLEAN texts, whole, which bounds what is broadcast; scoring is one
reading of the texts without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import give_back, pieces, table, tasks

#: Labelled rows of either label that are fitted at most (about: the sample is by hash).
MAX_TOXIC, MAX_CLEAN = 600, 1_600
#: Neighbours that vote, and of these the ones that are returned as evidence; examples in a block.
NEIGHBOURS, EVIDENCE, BLOCK = 100, 10, 64
#: Postings of a term that one in COMMON examples has are kept as a row of a matrix, by which BATCH texts are multiplied at once.
COMMON, BATCH = 16, 64
#: The weight of the overall rate among the votes.
PRIOR = 0.5
#: Words are terms, and so are their beginnings of these lengths, which inflected forms share.
STEMS = (4, 5)
#: Terms whose document counts travel in one row.
CHUNK = 1 << 14

_WORD = re.compile(r"[^\W\d_]+")
#: For each character below 256 its lower case if that can be in a word, else a space. None of them looks at its neighbours for it.
_LATIN = bytes(ord(c) if _WORD.fullmatch(c) else 32 for c in (chr(k).lower() for k in range(256)))


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case. Texts of characters below 256 are cut as bytes, which takes a third of the time."""
    try:
        return (text or "").encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(text.lower())


def terms_of(text: str | None) -> Counter:
    """All terms of a text: its words in lower case, and their beginnings, marked by a dash."""
    out = Counter(words_of(text))
    for word, n in list(out.items()):
        for k in STEMS:
            if len(word) > k:
                out[word[:k] + "-"] += n
    return out


class Vocabulary(dict):
    """Terms by number, in ascending order. For a word that is no term [] gives its longest beginning that is one, or -1.

    Nothing is remembered of such words, so they may be as many as they like.
    """

    def __init__(self, terms: dict[str, int] = {}):
        super().__init__(terms)
        self.up = np.zeros(0, np.int32)  # for each term the longest of its beginnings that is one, or -1, and -1 for none

    def __reduce__(self):  # terms have no spaces
        return _vocabulary, (zlib.compress(" ".join(self).encode(), 1),)

    def __missing__(self, word: str) -> int:
        for k in reversed(STEMS):
            if len(word) > k and (t := self.get(word[:k] + "-")) is not None:
                return t
        return -1

    def numbers(self, text: str | None) -> np.ndarray:
        """The terms of a text that are known, as often as it has them."""
        if len(self.up) != len(self) + 1:
            self.up = np.array([*(self.__missing__(t.removesuffix("-")) for t in self), -1], np.int32)
        words = words_of(text)
        found = [np.fromiter(map(self.__getitem__, words), np.int32, len(words))]
        for _ in STEMS:
            found.append(self.up[found[-1]])
        every = np.concatenate(found)
        return every[every >= 0]


def _vocabulary(packed: bytes) -> Vocabulary:
    terms = zlib.decompress(packed).decode()
    return Vocabulary({t: k for k, t in enumerate(terms.split(" "))} if terms else {})


def held_out() -> F.Column:
    """Whether a row is kept from fitting: crc32 of its doc_id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Index:
    """Examples by block-max postings. A vector is (terms, weights), of length 1 or empty.

    The postings of terms that many examples have are kept as rows of a matrix, all others as lists.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK):
        self.block, self.blocks = block, -(-len(vectors) // block)
        often = np.bincount(np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)]), minlength=terms)
        self.order = np.array(sorted(range(len(vectors)), key=lambda k: self._like(*vectors[k], often, len(vectors))), dtype=np.int64)
        sizes = [len(vectors[k][0]) for k in self.order]
        term = np.concatenate([np.zeros(0, np.int64), *(vectors[k][0] for k in self.order)])
        weight = np.concatenate([np.zeros(0), *(vectors[k][1] for k in self.order)])
        place = np.repeat(np.arange(len(vectors)), sizes)
        common = np.flatnonzero(often * COMMON > len(vectors))
        self.row = np.full(terms, -1)
        self.row[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.blocks * block))
        full = self.row[term] >= 0
        self.matrix[self.row[term[full]], place[full]] = weight[full]
        by = np.lexsort((place[~full], term[~full]))
        term, self.place, self.weight = term[~full][by], place[~full][by].astype(np.int32), weight[~full][by]
        of = self.place // block
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (of[1:] != of[:-1])]) if len(term) else np.zeros(0, np.int64)
        # For each other term and block that has it the block and the largest weight, and where its postings begin.
        self.of, self.most = of[first], np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.begin = np.r_[first, len(term)].astype(np.int64)
        self.cuts = np.searchsorted(term[first], np.arange(terms + 1))

    @staticmethod
    def _like(terms: np.ndarray, weights: np.ndarray, often: np.ndarray, n: int) -> list[int]:
        """The heaviest of the terms that many examples have, by which like examples come to share blocks."""
        common = np.flatnonzero(64 * often[terms] >= n)
        return terms[common[np.argsort(-weights[common], kind="stable")[:4]]].tolist()

    def common(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the frequent terms of each query add to its cosine with each example."""
        rows = np.zeros((len(queries), len(self.matrix)))
        for own, (terms, weights) in zip(rows, queries):
            row = self.row[terms]
            own[row[row >= 0]] = weights[row >= 0]
        return rows @ self.matrix

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, common: np.ndarray | None = None, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest and all that tie with the last, nearest first.

        Only examples of a positive cosine; `without` is never among them. A block's bound is the most that frequent terms give
        one of its examples, and the largest weights of the other terms in it. Where bounds leave most blocks, all postings of a
        term, which lie together, are summed at once, as to pick them block by block takes longer.
        """
        common = self.common([(terms, weights)])[0] if common is None else common
        few = self.row[terms] < 0
        terms, weights = terms[few], weights[few]
        sizes = self.cuts[terms + 1] - self.cuts[terms]
        top, weight = _runs(self.cuts[terms], sizes), np.repeat(weights, sizes)
        of = self.of[top]
        bound = common.reshape(self.blocks, self.block).max(axis=1, initial=0) + np.bincount(of, weight * self.most[top], self.blocks)
        own = np.flatnonzero(self.order == without) if without >= 0 else np.zeros(0, np.int64)
        front = np.zeros(self.blocks, dtype=bool)
        front[np.argsort(-bound, kind="stable")[: 2 * (k // self.block + 1)]] = True
        inside = np.flatnonzero(front[of])
        cosine = common + self._others(self.begin[top[inside]], self.begin[top[inside] + 1], weight[inside])
        cosine[own] = 0
        # What the front holds so far is a lower bound of the k-th cosine, as the others can only gain.
        rest = ~front & (bound >= self._worst(cosine, k) - 1e-9)
        if 2 * np.count_nonzero(rest) > self.blocks:
            cosine = common + self._others(self.begin[self.cuts[terms]], self.begin[self.cuts[terms + 1]], weights)
        elif len(inside := np.flatnonzero(rest[of])):
            cosine += self._others(self.begin[top[inside]], self.begin[top[inside] + 1], weight[inside])
        cosine[own] = 0
        worst = self._worst(cosine, k)
        found = np.flatnonzero((cosine > 1e-12) & (cosine >= worst - 1e-9))
        found = found[np.argsort(-cosine[found].round(9), kind="stable")]
        return self.order[found], cosine[found]

    @staticmethod
    def _worst(cosine: np.ndarray, k: int) -> float:
        return np.partition(cosine, -k)[-k] if len(cosine) >= k else 0.0

    def _others(self, begin: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What runs of postings, each of one term, add to the cosines."""
        at = _runs(begin, end - begin)
        return np.bincount(self.place[at], np.repeat(weight, end - begin) * self.weight[at], self.blocks * self.block)


class Model:
    """The fitted index with what scoring needs. Built on the driver, sent once to each worker.

    An entry is (terms, counts, toxic examples, examples, smallest doc_id); examples of equal terms and counts are
    one entry with one vote, so copies don't outvote others.
    """

    def __init__(self, number: Vocabulary, idf: np.ndarray, entries: list[tuple[np.ndarray, np.ndarray, int, int, int]], rate: float, neighbours: int = NEIGHBOURS):
        self.number, self.idf, self.neighbours = number, idf, neighbours
        self.entries = [(e[0], e[1], e[3]) for e in entries]
        self.share = np.array([e[2] / e[3] for e in entries])
        self.first = np.array([e[4] for e in entries], dtype=np.int64)
        self.rate = rate  # of all labelled rows
        self.prior = float((self.share.sum() + 0.5) / (len(entries) + 1)) if entries else 0.0  # of the entries
        self.index = Index([self.vector(e[0], e[1]) for e in entries], len(number))
        self.slope, self.shift = 1.0, 0.0

    def __getstate__(self) -> dict:
        """Without the index, which is made again from the counts, and these as steps: a tenth of the size."""
        terms = np.concatenate([np.zeros(0, np.int32), *(np.diff(e[0], prepend=0).astype(np.int32) for e in self.entries)])
        counts = np.concatenate([np.zeros(0, np.int32), *(e[1].astype(np.int32) for e in self.entries)])
        sizes = np.array([(len(e[0]), e[2]) for e in self.entries], dtype=np.int64).reshape(-1, 2)
        return self.__dict__ | {"entries": (zlib.compress(terms.tobytes(), 1), zlib.compress(counts.tobytes(), 1), sizes), "index": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        terms, counts, sizes = state["entries"]
        cuts = np.cumsum(sizes[:, 0])[:-1]
        terms, counts = (np.split(np.frombuffer(zlib.decompress(x), np.int32), cuts) for x in (terms, counts))
        self.entries = [(np.cumsum(t, dtype=np.int32), c, n) for t, c, n in zip(terms, counts, sizes[:, 1].tolist())]
        self.index = Index([self.vector(t, c) for t, c, _ in self.entries], len(self.number))
        give_back()  # making it takes some 60 MB more than it keeps

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = (1 + np.log(counts)) * self.idf[terms]
        return terms, weights / (np.sqrt((weights**2).sum()) or 1.0)

    def known(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The terms of the vocabulary that a text has, in ascending order, and how often."""
        terms, counts = np.unique(self.number.numbers(text), return_counts=True)
        return terms.astype(np.int64), counts.astype(float)

    def vote(self, query: tuple[np.ndarray, np.ndarray], common: np.ndarray | None = None, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """(share of toxic votes, entries, cosines); the share among all entries where none has a term of the text."""
        if not len(query[0]):
            return self.prior, np.zeros(0, np.int64), np.zeros(0)
        found, cosine = self.index.nearest(*query, self.neighbours, common, without)
        return float(((cosine * self.share[found]).sum() + PRIOR * self.prior) / (cosine.sum() + PRIOR)), found, cosine

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, float]]]]:
        """(score, evidence) of each text; evidence holds a doc_id of each of the nearest entries and its cosine."""
        out = []
        for at in range(0, len(texts), BATCH):
            queries = [self.vector(*self.known(x)) for x in texts[at : at + BATCH]]
            for query, common in zip(queries, self.index.common(queries)):
                vote, found, cosine = self.vote(query, common)
                evidence = [(int(i), round(float(c), 6)) for i, c in zip(self.first[found[:EVIDENCE]], cosine)]
                out.append((round(self.calibrated(vote), 9) if len(found) else self.rate, evidence))
        return out

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float]]]:
        return self.scores([text])[0]

    def calibrated(self, vote: float) -> float:
        if not 0 < self.rate < 1:
            return self.rate
        x = self.slope * np.log(vote / (1 - vote)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))

    def calibrate(self, votes: np.ndarray, toxic: np.ndarray) -> None:
        """Fit the logistic curve from votes to labels (shares of toxic copies) by Newton's method.

        Entries of either label weigh as much together as their label does among all labelled rows.
        """
        if not len(votes) or not 0 < toxic.sum() < len(toxic):
            return
        x = np.stack([np.log(votes / (1 - votes)), np.ones(len(votes))])
        weight = len(toxic) * (toxic * self.rate / toxic.sum() + (1 - toxic) * (1 - self.rate) / (1 - toxic).sum())
        w = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (weight * (p - toxic)) + 1e-6 * (w - [1, 0]))
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        if w[0] > 0:  # else the votes say nothing of the labels, and stay as they are
            self.slope, self.shift = map(float, w)


def _examples(docs: DataFrame, labels: DataFrame, most: tuple[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, text) of the sample, and the labelled rows of each label."""
    labels = labels.select(F.col("doc_id").cast("long"), "toxic").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    sizes = {row.toxic: row["count"] for row in labels.groupBy("toxic").count().collect()}
    part = [int(min(1.0, n / max(1, sizes.get(k, 0))) * (1 << 20)) for k, n in enumerate(most)]
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.when(F.col("toxic") == 1, part[1]).otherwise(part[0]))
    return docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id"), sizes  # bounded by `most`


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each example's terms, joined by a space in alphabetical order, and their counts."""
    for batch in pieces(batches, 64):
        found = [sorted(terms_of(x).items()) for x in batch["text"].to_pylist()]
        terms, counts = [" ".join(t for t, _ in x) for x in found], [np.array([n for _, n in x], "<i4").tobytes() for x in found]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(terms, pa.string()), pa.array(counts, pa.binary())], names=["doc_id", "toxic", "terms", "counts"])


def document_counts(docs: DataFrame, number: Vocabulary) -> tuple[int, np.ndarray]:
    """(rows of `docs`, for each term how many of them have it); counted in the tasks, summed by chunks of terms."""
    sent, n = docs.sparkSession.sparkContext.broadcast(number), len(number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, counts, rows = sent.value, np.zeros(n, np.int64), 0
        for batch in pieces(batches):
            rows += batch.num_rows
            for text in batch["text"].to_pylist():
                counts[number.numbers(text)] += 1  # a number that is there several times counts once
        payload = [np.int64(rows).tobytes(), *(zlib.compress(counts[a : a + CHUNK].tobytes(), 1) for a in range(0, n, CHUNK))]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(payload) - 1), pa.int32()), pa.array(payload, pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, payload in zip(batch["chunk"].to_pylist(), batch["counts"].to_pylist()):
                own = np.frombuffer(payload if k < 0 else zlib.decompress(payload), np.int64)
                sums[k] = sums[k] + own if k in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    schema = "chunk int, counts binary"
    summed = docs.select("text").mapInArrow(count, schema).repartition(min(tasks(docs.sparkSession), 2 + n // CHUNK), "chunk").mapInArrow(add, schema)
    rows, out = 0, np.zeros(n, np.int64)
    for row in summed.toLocalIterator():  # one row for each chunk of the vocabulary
        own = np.frombuffer(row.counts, np.int64)
        if row.chunk < 0:
            rows = int(own[0])
        else:
            out[row.chunk * CHUNK : row.chunk * CHUNK + len(own)] = own
    sent.unpersist()
    return rows, out


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Fit on at most about `max_toxic` toxic and `max_clean` other labelled rows outside the held-out fifth.

    The sample is by a hash of doc_id, the same in every run; the curve gives its labels their weights among all
    labelled rows. A document with several labels is toxic if one says so; null labels are none. Texts are taken whole,
    null ones as empty. Examples without a term have no vector and are never neighbours. Without examples, or with labels
    of one kind, the score is the overall rate.
    """
    spark = docs.sparkSession
    examples, sizes = _examples(docs, labels, (max_clean, max_toxic))
    number = Vocabulary()
    entries: dict[tuple[bytes, bytes], list[int]] = {}
    for row in examples.mapInArrow(_counted, "doc_id long, toxic int, terms string, counts binary").toLocalIterator():
        terms = np.array([number.setdefault(t, len(number)) for t in row.terms.split(" ")] if row.terms else [], dtype=np.int32)
        entry = entries.setdefault((terms.tobytes(), bytes(row.counts)), [0, 0, row.doc_id])
        entry[:] = [entry[0] + row.toxic, entry[1] + 1, min(entry[2], row.doc_id)]
    rows, having = document_counts(docs, number)
    idf = np.log((rows + 1) / (having + 1)) + 1
    unpacked = []
    for (terms, counts), own in sorted(entries.items(), key=lambda x: (x[1][2], x[0])):
        terms, counts = np.frombuffer(terms, np.int32).astype(np.int64), np.frombuffer(counts, "<i4").astype(np.float64)
        by = np.argsort(terms)
        unpacked.append((terms[by], counts[by], *own))
    model = Model(number, idf, unpacked, sizes.get(1, 0) / (sum(sizes.values()) or 1))
    model.calibrate(*_votes(spark, model))
    return model


def _votes(spark: SparkSession, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The vote on an example of each entry that has terms, by the other examples, and its label; dealt to the tasks.

    An entry of several examples keeps its vote, as the others of them are left.
    """
    some = [k for k, e in enumerate(model.entries) if len(e[0])]
    if not some:
        return np.zeros(0), np.zeros(0)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in batch["k"].to_pylist():
                terms, counts, n = sent.value.entries[k]
                found.append(sent.value.vote(sent.value.vector(terms, counts), without=k if n == 1 else -1)[0])
            yield pa.RecordBatch.from_arrays([batch["k"], pa.array(found, pa.float64())], names=["k", "vote"])

    rows = spark.createDataFrame([(k,) for k in some], "k int").repartition(min(tasks(spark), 1 + len(some) // 64)).mapInArrow(run, "k int, vote double").collect()
    sent.unpersist()
    rows = sorted(rows, key=lambda row: row.k)
    return np.array([row.vote for row in rows]), model.share[[row.k for row in rows]]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for every row of `docs`.

    The score is of the whole text alone, however long. Null and empty texts, and texts without a term of the examples,
    get the overall rate and no evidence. Rows that repeat are scored each, equal texts alike; neighbours that tie with the last
    vote too. A null doc_id counts as held out. Other columns of `docs` are not looked at; an empty table gives no rows.
    evidence: the EVIDENCE nearest entries, each by its smallest doc_id, and cosines.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))
        for batch in pieces(batches):
            found = sent.value.scores(batch["text"].to_pylist())
            evidence = [[{"doc_id": i, "cosine": c} for i, c in e] for _, e in found]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([s for s, _ in found], pa.float64()), pa.array(evidence, kind)], names=["doc_id", "score", "evidence"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double>>")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """`docs` without the rows that score `threshold` or more; one reading, all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch.filter(pa.array([x < threshold for x, _ in sent.value.scores(batch["text"].to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`score` with a model that is fitted on the table `labels`, over all of the table `documents`."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
