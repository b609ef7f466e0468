"""Secret scans over a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived: which trigrams a text must have for
the regex to match it. Texts are taken in segments of up to 512; one reading of a segment's trigrams, ASCII-folded,
builds the postings of those that some rule asks for, each rule's query intersects and unites them,
and only the candidates are verified with the regex. Rules without a mandatory trigram scan the whole
segment. Nothing is shuffled, and a segment's index is dropped with it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import pieces, table

try:  # the parser of the standard library's regexes
    from re import _constants as _c
    from re import _parser
except ImportError:  # pragma: no cover
    import sre_constants as _c
    import sre_parse as _parser


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `group` must have at least `least` characters, else a match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds of credentials with fixed public prefixes.
MORE = (
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/=-]{20,}"),
    Rule("forge", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"(?:sk|rk)_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("url", r"(?<![a-z0-9+.-])[a-z0-9+.-]++://[^\s:/@\"'<>]++:[^\s:/@\"'<>]{6,}+@"),
)
RULES = BASE + MORE

ALL = None  #: the query that every text satisfies


def trigram_query(pattern: str):
    """The Boolean query of a pattern: ALL, a trigram, or ('and' | 'or', parts).

    Literals are folded to lower case, as the index is. A rule that is ASCII only folds like it.
    """
    parsed = _parser.parse(pattern, re.ASCII)
    return _conj([_text_query(x) for x in _alternatives(parsed)], "or")


#: Strings that a part of a pattern can match are enumerated up to this many, else it breaks the literal.
SPREAD = 24


def _alternatives(parsed) -> list[list]:
    """Ways through a pattern, each a list of literal strings that must occur (None: a break)."""
    ways: list[list] = [[""]]
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            ways = [_glue(w, [chr(arg)]) for w in ways]
        elif kind == "SUBPATTERN":
            ways = _cross(ways, _alternatives(arg[-1]))
        elif kind == "BRANCH":
            ways = _cross(ways, [w for part in arg[1] for w in _alternatives(part)])
        elif kind == "IN" and (chars := _few(arg)):
            ways = _cross(ways, [[c] for c in chars])
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] == 0 and arg[1] == 1:
            ways = _cross(ways, [[""], *_alternatives(arg[2])])
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            inner = _alternatives(arg[2])
            ways = _cross(ways, [[*w, None, *w] if arg[0] > 1 or arg[1] > 1 else w for w in inner])
        elif kind in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        else:
            ways = [[*w, None, ""] for w in ways]
    return ways


def _few(members) -> list[str]:
    out = [chr(arg) for op, arg in members if op is _c.LITERAL]
    return out if len(out) == len(members) and len(out) <= 8 else []


def _glue(left: list, right: list) -> list:
    if left and right and left[-1] is not None and right[0] is not None:
        return [*left[:-1], left[-1] + right[0], *right[1:]]
    return left + right


def _cross(left: list[list], right: list[list]) -> list[list]:
    if len(left) * len(right) > SPREAD:
        return [[*w, None, ""] for w in left]
    return [_glue(a, b) for a in left for b in right]


def _text_query(way: list):
    grams = {s[i : i + 3].lower() for s in way if s for i in range(len(s) - 2)}
    return _conj(sorted(grams), "and") if grams else ALL


def _conj(parts: list, how: str):
    if how == "or" and any(x is ALL for x in parts):
        return ALL
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else (how, tuple(parts))


def _grams(query) -> set[str]:
    if query is ALL:
        return set()
    return {query} if isinstance(query, str) else {g for part in query[1] for g in _grams(part)}


class Index:
    """Postings of a segment of texts in UTF-8: the texts that have a trigram, for each trigram that a rule asks for."""

    #: Bytes whose trigrams are looked up at once.
    STEP = 1 << 20

    def __init__(self, texts: list[bytes], grams: set[str]):
        self.n, self.number = len(texts), {g: k for k, g in enumerate(sorted(grams))}
        joined = np.frombuffer(b"".join([x + b"\0\0" for x in texts]).lower(), np.uint8)  # bytes: A-Z only
        ends = np.cumsum([len(x) + 2 for x in texts])
        wanted = _wanted(frozenset(grams))
        of, gram = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(joined) - 2, self.STEP):
            x = joined[at : at + self.STEP + 2].astype(np.uint32)
            found = wanted[x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]]
            here = np.flatnonzero(found)
            of.append(np.searchsorted(ends, here + at, side="right"))
            gram.append(found[here].astype(np.int64) - 1)
        both = np.unique(np.concatenate(gram) * max(1, self.n) + np.concatenate(of))
        cuts = np.searchsorted(both, np.arange(1, len(self.number)) * max(1, self.n))
        self.postings = np.split(both % max(1, self.n), cuts)

    def candidates(self, query) -> np.ndarray:
        """The texts, in order, that satisfy a query."""
        if query is ALL:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings[self.number[query]]
        parts = [self.candidates(x) for x in query[1]]
        return functools.reduce(np.intersect1d if query[0] == "and" else np.union1d, parts)


@functools.lru_cache(maxsize=4)
def _wanted(grams: frozenset[str]) -> np.ndarray:
    """For each three bytes the number of the trigram that they are, from 1; 0 if no rule asks for it."""
    out = np.zeros(1 << 24, dtype=np.uint8 if len(grams) < 256 else np.uint16)
    out[[int.from_bytes(g.encode(), "big") for g in sorted(grams)]] = np.arange(1, len(grams) + 1)
    return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(k, r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for k, r in enumerate(rules)]
        self.grams = set().union(*(_grams(q) for *_, q in self.rules))

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule, end), in order."""
        index = Index([x.encode("utf-8", "surrogatepass") for x in texts], self.grams)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, rule, regex, query in self.rules:
            for i in index.candidates(query).tolist():
                for m in regex.finditer(texts[i]):
                    if not rule.least or len(m[rule.group]) >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        for spans in out:
            spans.sort()
        return out


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) by start, for every row of `docs`.

    Offsets are code points, ends exclusive. A null or empty text has no spans; a text of any length is
    scanned whole. Rows that repeat are scanned each. Spans of different rules may overlap and all are given; those of equal
    start are in the order of the rules. Other columns of `docs` are not looked at; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in pieces(batches):
            found = scanner.scan([x or "" for x in batch["text"].to_pylist()])
            spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret's characters replaced by `mark`; overlapping spans are one.

    Text and n_chars (where there is one) follow; all other columns, rows and null texts stay.
    """
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in pieces(batches):
            texts = batch["text"].to_pylist()
            found = scanner.scan([x or "" for x in texts])
            new = [_without(t, s, mark) if s else t for t, s in zip(texts, found)]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(new, batch.schema.field(at).type))

    out = docs.mapInArrow(run, fields)
    if "n_chars" in docs.columns:
        size = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
        out = out.withColumn("n_chars", size.cast(fields["n_chars"].dataType))
    return out


def _without(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def span_digest(kinds: tuple[str, ...] | None) -> F.Column:
    """`kind:start:end`, joined by commas, of the spans of the kinds given (None: all)."""
    spans = F.col("spans") if kinds is None else F.filter("spans", lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of `find_secrets` over all of the table `documents`."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(r.kind) for r in BASE]
    base = F.sha2(span_digest(tuple(r.kind for r in BASE)), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, span_digest(None).alias("spans"))
