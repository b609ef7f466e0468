"""Main text of web pages by nearest-URL page differencing.

Pages of a host are sorted by URL path, and each is paired with the neighbour whose path has the longer
common beginning with its own. The lines of both are aligned by their longest common subsequence, and
lines that both have are the site's template, not the page's text. Two things bound what is deleted: lines
inside a page's <article> or <main> are its text although another page has them too, and elements that
say what they are (menus, footers, adverts, forms, comments) go although no other page has them.

Only line hashes are sorted and paired. A host with a third of all pages is spread over ranges like any
other. Of the rows at a range's ends the driver learns the URLs, and their lines meet in a join, so every page sees its
true neighbours.
"""

from __future__ import annotations

import html as entities
import os.path
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import cut, pieces, table, tasks

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|object|select|button)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[a-z/!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that hold no part of a page's text.
DROPPED = frozenset("head nav footer aside form menu dialog fieldset".split())
TEXT = frozenset("article main".split())
#: Words of class, id or role that say the same.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup share sharing social "
    "comment comments disqus respond replies reply related recommended widget toolbar login search pagination pager complementary contentinfo alert".split()
)
#: Those of them that say it of a paragraph, a heading, an item or a cell inside a text too; the others are words that prose
#: is marked up with, as in class="alert". Elements within a line are never dropped inside a text.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promoted cookie cookies consent gdpr notice newsletter subscribe subscription signup disqus".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption".split())
#: A paragraph ends where one of these begins.
_ENDS_P = frozenset("p div ul ol table section article main h1 h2 h3 h4 h5 h6 blockquote pre header footer nav aside form hr dl".split())


def _dropped(tag: str, attrs: str, inside: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if tag in TEXT or tag in ("body", "html") or not attrs:
        return False
    if inside and tag in INLINE:
        return False
    marks = ADVERTS if inside and tag in BLOCKS else MARKS
    for m in _ATTR.finditer(attrs):
        words = re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower())
        if not marks.isdisjoint(words) or (not inside and "header" in words):
            return True
    return False


def lines(html: str) -> list[tuple[str, bool, bool]]:
    """The page's lines in order: (text, whether in an article or main, whether in a dropped element)."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # (tag, is text's container, is dropped)
    held: list[str] = []
    at = 0

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                dropped = any(x[2] for x in stack)
                out.append((text, any(x[1] for x in stack), dropped))
            held.clear()

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        if m["raw"]:
            if m["raw"].lower() in ("title", "textarea", "button", "select"):
                flush()
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if tag not in INLINE or k is not None:
                flush()
            if k is not None:
                del stack[k:]
            continue
        inside = any(x[1] for x in stack)
        dropped = tag not in VOID and _dropped(tag, m["attrs"], inside)
        if tag not in INLINE or dropped:
            flush()
        if tag in VOID:
            continue
        if tag in _ENDS_P and stack and stack[-1][0] == "p":
            stack.pop()
        if tag in TEXT and not inside:  # an open menu or advert ends where the text begins
            while stack and stack[-1][2]:
                stack.pop()
        if dropped or (tag not in INLINE and tag not in ("p", "li", "tr", "td", "th", "dt", "dd", "option")):
            stack.append((tag, tag in TEXT, dropped))
    if at < len(html):
        held.append(html[at:])
    flush()
    return out


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in `a` of a longest common subsequence of a and b (bit-parallel, with rows kept)."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    edge = [*range(start), *range(len(a) - stop, len(a))]
    there, here = set(b[start : len(b) - stop]), set(a[start : len(a) - stop])
    mine = [k for k in range(start, len(a) - stop) if a[k] in there]
    other = [x for x in b[start : len(b) - stop] if x in here]
    masks: dict[int, int] = {}
    for j, x in enumerate(other):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(other)) - 1
    row, rows = full, []
    for k in mine:
        hit = row & masks[a[k]]
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    i, j, found = len(mine), len(other), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                found.append(mine[i])
    return sorted(edge + found)


def _place(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path + ("?" + parts.query if parts.query else "")
    except ValueError:
        return "", url or ""


def _hashes(found: list[tuple[str, bool, bool]]) -> list[int]:
    return [int.from_bytes(xxhash.xxh64_digest(t.encode("utf-8", "surrogatepass")), "big", signed=True) for t, text, _ in found if not text]


_KEYS = "page_id long, content long, host string, path string, hashes array<long>"
_SHARED = "page_id long, content long, pair_id long, shared array<int>"
_FOUND = _SHARED + ", pair_content long, hashes array<long>"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        places = [_place(u) for u in batch["url"].to_pylist()]
        hashes = [_hashes(lines(x or "")) for x in batch["html"].to_pylist()]
        columns = [batch["page_id"], batch["content"], pa.array([h for h, _ in places], pa.string()), pa.array([p for _, p in places], pa.string()), pa.array(hashes, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "content", "host", "path", "hashes"])


def shared_lines(pages: DataFrame) -> DataFrame:
    """(page_id, content, pair_id, shared): for each page its nearest page, and which lines both have.

    Lines inside articles are not counted. Pages without another of their host are not in the result.
    """
    n = tasks(pages.sparkSession)
    order = ("host", "path", "page_id", "content")
    keys = pages.mapInArrow(_keys, _KEYS).dropDuplicates(["page_id", "content"])
    ranged = cut(keys.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = first or batch.slice(0, 1)
                last = batch.slice(batch.num_rows - 1, 1)
        if first is not None:
            yield first
            yield last

    edges = cut(ranged.mapInArrow(ends, ranged.schema).dropDuplicates(["page_id", "content"]))
    places: dict[int, list] = {}
    for row in edges.select("range", "host", "path", "page_id", "content").collect():  # two for each range, without their lines
        places.setdefault(row.range, []).append((row.host, row.path, row.page_id, row.content, None))
    order_of = lambda x: (x[0], x[1], x[2] is not None, x[2] or 0, x[3])
    full = sorted(places)
    before = {r: max(places[full[k - 1]], key=order_of) for k, r in enumerate(full) if k}
    after = {r: min(places[full[k + 1]], key=order_of) for k, r in enumerate(full[:-1])}

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = row = own = None
        for batch in batches:
            out = []
            for *item, place in zip(*(batch[c].to_pylist() for c in ("host", "path", "page_id", "content", "hashes", "range"))):
                if row is None:
                    left, own = before.get(place), place
                else:
                    out += _paired(left, row, item)
                    left = row
                row = item
            yield _pairs(out, _FOUND)
        if row is not None:
            yield _pairs(_paired(left, row, after.get(own)), _FOUND)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("page_id", "content", "pair_id", "hashes", "theirs"))
            yield _pairs([(i, c, p, common_lines(a, b)) for i, c, p, a, b in zip(*columns)], _SHARED)

    found = cut(ranged.mapInArrow(pair, _FOUND))
    theirs = edges.select(F.col("page_id").alias("their_id"), F.col("content").alias("their_content"), F.col("hashes").alias("theirs"))
    same = F.col("pair_id").eqNullSafe(F.col("their_id")) & (F.col("pair_content") == F.col("their_content"))
    apart = found.where("shared IS NULL").join(theirs, same).select("page_id", "content", "pair_id", "hashes", "theirs")
    return found.where("shared IS NOT NULL").select("page_id", "content", "pair_id", "shared").unionByName(apart.mapInArrow(across, _SHARED))


def _paired(left, row, right) -> list[tuple]:
    """The row's nearest page and the lines that both have; or, of a page whose lines are in another range, no lines yet."""
    near = [x for x in (left, right) if x is not None and x[0] == row[0]]
    if not near:
        return []
    other = max(near, key=lambda x: len(os.path.commonprefix([x[1], row[1]])))
    if other[4] is None:
        return [(row[2], row[3], other[2], None, other[3], row[4])]
    return [(row[2], row[3], other[2], common_lines(row[4], other[4]), other[3], None)]


def _pairs(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split(" ") for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


#: The lines to choose from, in page order; place is null inside an article, else the line's number among those outside.
_PARSED = "page_id long, url string, content long, kept array<struct<line: string, place: int>>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("line", pa.string()), ("place", pa.int32())]))
    for batch in pieces(batches):
        kept = []
        for html in batch["html"].to_pylist():
            row, place = [], 0
            for line, text, dropped in lines(html or ""):
                if not dropped:
                    row.append({"line": line, "place": None if text else place})
                place += not text
            kept.append(row)
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], batch["content"], pa.array(kept, kind)], names=["page_id", "url", "content", "kept"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, pair_id and n_shared of every row of `pages`.

    Character references are decoded, white space inside a line becomes one space, and lines are joined by
    a newline in page order. A page has its lines that its nearest page does not have and, shared or not, those
    inside an article or main element, or, where that would leave nothing (the nearest page is a copy),
    all of its lines; elements that hold no text are left out in each case. Null or empty
    html gives an empty text. A page of any length is taken whole. Pages without another one on their host have no template to
    delete. Rows that repeat are kept, and are one page in the pairing; of two equally near pages the one before in the
    order of path and page_id is compared. pair_id and n_shared say which page was compared and how many lines of the
    page outside an article it shares. Other columns are not looked at; an empty table gives no rows.
    """
    pages = pages.select(F.col("page_id").cast("long"), "url", "html").withColumn("content", F.xxhash64("url", "html"))
    pairs = shared_lines(pages).select(F.col("page_id").alias("p"), F.col("content").alias("c"), "pair_id", "shared")
    joined = pages.mapInArrow(_parsed, _PARSED).join(pairs, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("content") == F.col("c")), "left")
    shared = F.coalesce("shared", F.array().cast("array<int>"))
    rest = F.filter("kept", lambda x: x["place"].isNull() | ~F.array_contains(shared, x["place"]))
    text = F.array_join(F.transform(F.when(F.size(rest) > 0, rest).otherwise(F.col("kept")), lambda x: x["line"]), "\n")
    out = joined.select("page_id", "url", text.alias("text"), "pair_id", F.coalesce(F.size("shared"), F.lit(0)).cast("long").alias("n_shared"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "pair_id", "n_shared")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`main_text` of all of the table `pages`."""
    return main_text(table(spark, sf_dir, "pages"))
