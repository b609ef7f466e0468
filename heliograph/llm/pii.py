"""Personal data by bootstrapped contextual extraction.

Fixed patterns give seed entities. The words around seeds induce lexical patterns; Spark scores the
bipartite graph of patterns and instances for a few rounds (a pattern by the share of its instances
that are entities of a kind, an unseen instance by the patterns around it); and trusted patterns
mark identifiers that no fixed pattern knows. The graph holds only identifier-like tokens and groups of them, is built
from all documents in one reading, and is aggregated with map-side sums, so that a pattern found in
a third of all rows is a few rows by the time it is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import cut, pieces, table

KINDS = ("email", "ip", "card", "phone")
#: A trusted pattern has this many different seeds of its kind around it, and this score.
SUPPORT, TRUST, ROUNDS = 5, 0.9, 3
#: What a pattern's score is smoothed by: SUPPORT seeds and nothing else at a pattern reach TRUST.
PRIOR = 0.5
#: An unseen identifier has at least this many digits.
DIGITS = 5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behinds and possessive repeats only forbid starts and ends that can't be the leftmost, longest match.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARKS = "()+./#_-"
_RUN = re.compile(r"[A-Za-z0-9()+./#_-]+")
_GAP = re.compile(r"\)?\x20\(?|\x20-\x20")
_BANK = re.compile(r"[A-Z]{4}")
_WORD = re.compile(r"\S+")
_DIGIT = re.compile(r"[0-9]")
_EDGE = "\"'`.,;:!?()[]{}<>*#$%&|=-_"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def seeds(text: str) -> list[tuple[int, int, int]]:
    """The entities that fixed patterns find: (start, place of the kind in KINDS, end), in order."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _clean(word: str) -> str:
    return _DIGIT.sub("0", word.lower().strip(_EDGE)) or word


def _patterns(text: str, start: int, end: int, words: list[tuple[int, int]], starts: list[int]) -> list[str]:
    """The lexical patterns around a span: the word before it, the two before, the words on both sides, and the two after.

    `words` are the places of the text's words, `starts` where they begin; what is joined to a span is a word of its own.
    """
    k = bisect_left(starts, start)
    left = [_clean(text[s : min(e, start)]) for s, e in words[max(0, k - 2) : k]]
    k = bisect_left(starts, end)
    right = [(end, words[k - 1][1])] if k and words[k - 1][1] > end else []
    right = [_clean(text[s:e]) for s, e in [*right, *words[k : k + 2]][:2]]
    out = ["before " + left[-1]] if left else []
    out += ["before " + " ".join(left)] if len(left) == 2 else []
    out += [f"around {left[-1]} | {right[0]}"] if left and right else []
    return [*out, "after " + " ".join(right)] if len(right) == 2 else out


def _unseen(text: str, known: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Identifier-like tokens and groups of tokens beside the spans of `known`.

    A group is the longest run of tokens with digits, a bank's four letters between them included, that
    stand one space or bracket apart.
    """
    found, group, digits, bank = [], [], 0, None
    for m in _RUN.finditer(text):
        token = m[0].lstrip(_MARKS)
        start = m.end() - len(token)
        token = token.rstrip(_MARKS)
        end, n = start + len(token), sum(map(token.count, "0123456789"))
        if n >= DIGITS:
            found.append((start, end))
        if n:
            if not (group and _GAP.fullmatch(text, (bank or group[-1])[1], start)):
                if len(group) > 1 and digits >= DIGITS:
                    found.append((group[0][0], group[-1][1]))
                group, digits = [], 0
            group.append((start, end))
            digits, bank = digits + n, None
        elif group and not bank and _BANK.fullmatch(token) and _GAP.fullmatch(text, group[-1][1], start):
            bank = (start, end)
        elif token and group:
            if len(group) > 1 and digits >= DIGITS:
                found.append((group[0][0], group[-1][1]))
            group, digits, bank = [], 0, None
    if len(group) > 1 and digits >= DIGITS:
        found.append((group[0][0], group[-1][1]))
    at, spans = 0, sorted((s, e) for s, _, e in known)
    for start, end in sorted(found):
        if start and text[start - 1] == "(" and ")" in text[start:end]:
            start -= 1
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        if not (at < len(spans) and spans[at][0] < end):
            yield start, end


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_NEAR = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
_MAYBE = re.compile(r"[0-9@]")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        base, near = [], []
        for text in batch["text"].to_pylist():
            if not text or not _MAYBE.search(text):
                base.append([])
                near.append([])
                continue
            found = seeds(text)
            more = [(s, None, e) for s, e in _unseen(text, found)]
            words = [m.span() for m in _WORD.finditer(text)] if found or more else []
            starts = [s for s, _ in words]
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
            near.append([{"start": s, "kind": k, "end": e, "instance": text[s:e].lower(), "patterns": _patterns(text, s, e, words, starts)} for s, k, e in [*found, *more]])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(base, pa.list_(_SPAN)), pa.array(near, pa.list_(_NEAR))], names=["doc_id", "base", "near"])


_SCHEMA = (
    "doc_id long, base array<struct<start: long, kind: int, end: long>>, "
    "near array<struct<start: long, kind: int, end: long, instance: string, patterns: array<string>>>"
)


def trusted_patterns(near: DataFrame, support: int = SUPPORT, trust: float = TRUST, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, score) of the patterns to trust, from rows (instance, kind or null, pattern)."""
    edges = cut(near.groupBy("instance", "pattern").agg(F.max("kind").alias("kind")))
    seeded = edges.where("kind is not null")
    size = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    first = seeded.groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(f"seeds >= {support}")
    unseen = edges.where("kind is null").select("instance", "pattern")
    scores = cut(first.join(size, "pattern").select("pattern", "kind", "seeds", "n", (F.col("seeds") / (F.col("n") + PRIOR)).alias("score")))
    for _ in range(rounds):
        by = unseen.join(scores.where("score > 0"), "pattern").groupBy("instance", "kind")
        mass = by.agg((1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))).alias("mass"))
        more = unseen.join(mass, "instance").groupBy("pattern", "kind").agg(F.sum("mass").alias("more"))
        new = (F.col("seeds") + F.coalesce("more", F.lit(0.0))) / (F.col("n") + PRIOR)
        scores = cut(scores.join(more, ["pattern", "kind"], "left").select("pattern", "kind", "seeds", "n", new.alias("score")))
    best = scores.where(F.col("score") >= trust).groupBy("pattern").agg(F.max(F.struct("score", "kind")).alias("b"))
    return best.select("pattern", "b.kind", "b.score")


def find_pii(docs: DataFrame, support: int = SUPPORT, trust: float = TRUST, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, base and spans (arrays of (start, kind, end) in order) for every row of `docs`.

    base: what the fixed patterns find. spans: base and the identifiers that trusted patterns discover,
    which never overlap base; of those that overlap each other the first and longest stays, and an identifier at patterns of
    several kinds takes the kind of the highest score, of equal ones the later in KINDS. kind is a place in KINDS. Offsets
    are code points, ends exclusive. A null or empty text has no spans; a text of any length is scanned whole; rows
    that repeat are scanned each, but one instance at one pattern counts once in the graph. Texts without words around an
    entity induce no pattern. Other columns are not looked at; an empty table gives no rows.
    """
    scanned = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_extract, _SCHEMA)).withColumn("row_id", F.monotonically_increasing_id())
    near = scanned.select("row_id", F.explode("near").alias("x")).select("row_id", "x.*").withColumn("pattern", F.explode("patterns"))
    good = cut(trusted_patterns(near.select("instance", "kind", "pattern"), support, trust, rounds))
    hits = near.where("kind is null").drop("kind").join(good, "pattern").groupBy("row_id", "start", "end").agg(F.max(F.struct("score", "kind")).alias("b"))
    found = hits.groupBy("row_id").agg(F.collect_list(F.struct("start", F.col("b.kind").alias("kind"), "end")).alias("more"))
    none = F.array().cast("array<struct<start: long, kind: int, end: long>>")
    # A token of a group may be discovered with it: of those that overlap, the first and longest stays.
    order = lambda x, y: F.when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).otherwise(F.when(x["end"] == y["end"], 0).when(x["end"] > y["end"], -1).otherwise(1))
    apart = lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > x["start"]), acc).otherwise(F.concat(acc, F.array(x)))
    more = F.aggregate(F.array_sort("more", order), none, apart)
    spans = F.sort_array(F.concat("base", F.coalesce(more, none)))
    return scanned.select("doc_id", "row_id", "base").join(found, "row_id", "left").select("doc_id", "base", spans.alias("spans"))


def digest(spans: str) -> F.Column:
    """`kind:start:end`, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of `find_pii` over all of the table `documents`."""
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    counts = [count(k) for k in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(digest("base"), 256).alias("base_sha256"), digest("spans").alias("spans"))
