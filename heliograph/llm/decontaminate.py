"""Benchmark decontamination by exact best windows over shared shingles, in DataFrame operations only.

A window has as many words as a benchmark item. Its similarity is the share of the item's weighted
five-word shingles that it has; a shingle's weight falls with the number of different items that have it,
so that no document moves it, however many copies it has. A window of at least the asked similarity lacks
less than the rest of the mass, so it has one of the item's leading (heaviest) shingles; every text
with one is a candidate. As a window's start goes up, each shingle of the text counts for a run of
starts; a sweep over the ends of those runs gives the best of all windows, so no window is missed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import cut, table

SHINGLE = 5
SIMILARITY = 0.8
#: Weights are whole numbers, so that sums don't depend on their order.
WHOLE = 1 << 32
#: A multi-index of SimHash fingerprints. It doesn't gate candidates: windows of 0.8 often differ in more bits.
BLOCKS, BLOCK_BITS, CHANGES = 4, 16, 2
RADIUS = BLOCKS * (CHANGES + 1) - 1
#: A table derived from the benchmark is broadcast up to this many rows (some 20 MB), else joined by a shuffle.
BROADCAST_ROWS = 250_000


def _words(text: str) -> Column:
    """Words of letters and digits in lower case; none for a null text."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often and deep the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shingles(words: Column) -> Column:
    """Hashes of all runs of five words; of the whole sequence if it is shorter; none if it is empty."""

    def of(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1)))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))
        return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(hashes)

    return _let(words, of)


def _block(fp: Column, k: Column) -> Column:
    """Block k of a fingerprint with its number, as one long."""
    value = F.call_function("shiftrightunsigned", fp, k * BLOCK_BITS).bitwiseAND((1 << BLOCK_BITS) - 1)
    return k.cast("long") * (1 << BLOCK_BITS) + value


def _changes() -> Column:
    """All masks of up to CHANGES = 2 bits of a block."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    bits = F.sequence(F.lit(0), F.lit(BLOCK_BITS - 1))
    none = F.array(F.lit(0).cast("long"))
    two = F.flatten(F.transform(bits, lambda i: F.transform(F.filter(bits, lambda j: j > i), lambda j: bit(i).bitwiseOR(bit(j)))))
    return F.concat(none, F.transform(bits, bit), two)


def _sized(df: DataFrame) -> DataFrame:
    """A materialized table, marked for broadcast if its rows, counted, are few."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _wanted(items: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(row, h, leading), and (row, h, item_id, n_words, mass, m, c, w, ats): the different shingles of the items.

    c is how often the item has the shingle, ats where, w the weight of one as a whole number, m and mass the
    count and weight of all. The leading shingles are the heaviest, of more than 1 - similarity of the mass.
    """
    distinct = items.select("words", "shingles").distinct()
    total = distinct.count()
    having = distinct.select(F.explode(F.array_distinct("shingles")).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    weight = F.round(F.log1p(F.lit(float(total)) / F.col("n")) * WHOLE).cast("long")
    each = items.select("row", F.posexplode("shingles").alias("at", "h")).groupBy("row", "h").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    each = each.join(having, "h").select("row", "h", F.size("ats").cast("long").alias("c"), weight.alias("w"), "ats")
    of_row = each.groupBy("row").agg(F.sum(F.col("c") * F.col("w")).alias("mass"), F.sort_array(F.collect_list(F.struct("w", "h", "c")), asc=False).alias("all"))
    # What stands before a shingle in the order; the shingle leads while that is not more than what may be missing.
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("hs"))
    missing = (1 - similarity + 1e-9) * F.col("mass")
    take = lambda acc, x: F.struct((acc["sum"] + x["w"] * x["c"]).alias("sum"), F.when(acc["sum"] <= missing, F.concat(acc["hs"], F.array(x["h"]))).otherwise(acc["hs"]).alias("hs"))
    of_row = of_row.select("row", "mass", F.aggregate("all", start, take)["hs"].alias("leads"))
    of_row = of_row.join(items.select("row", "item_id", F.size("words").alias("n_words"), F.size("shingles").alias("m")), "row")
    wanted = cut(each.join(of_row, "row"))
    parts = wanted.select("row", "h", F.array_contains("leads", F.col("h")).alias("leading"))
    return parts, _sized(wanted.select("row", "h", "item_id", "n_words", "mass", "m", "c", "w", "ats"))


def _events() -> Column:
    """What the shingle of a row adds and takes as a window's start goes up, and the starts that its places suggest.

    Of a window only as many places count as the item has; so place p counts for the starts after the c-th place before it and after p - m, up to p.
    """
    event = lambda at, kind, w: F.struct(at.cast("long").alias("at"), F.lit(kind).alias("kind"), w.alias("w"))
    before = lambda i: F.when(i >= F.col("c"), F.element_at("places", (i - F.col("c") + 1).cast("int"))).otherwise(F.lit(-1))
    low = lambda p, i: F.greatest(before(i) + 1, p - F.col("m") + 1, F.lit(0))
    plus = F.transform("places", lambda p, i: event(low(p, i), 1, F.col("w")))
    minus = F.transform("places", lambda p, i: event(p + 1, 0, -F.col("w")))
    starts = F.array_distinct(F.flatten(F.transform("places", lambda p: F.transform("ats", lambda a: F.greatest(p - a, F.lit(0))))))
    return F.concat(plus, minus, F.transform(starts, lambda s: event(s, 2, F.lit(0).cast("long"))))


def _sweep(events: Column) -> Column:
    """(w, start) of the best window: the first of equals at a suggested start, else the first of all."""
    zero = F.lit(0).cast("long")
    none = F.struct(zero.alias("sum"), zero.alias("any"), zero.alias("any_at"), zero.alias("own"), zero.alias("own_at"))

    def step(s: Column, e: Column) -> Column:
        now = s["sum"] + e["w"]
        more, mine = now > s["any"], (e["kind"] == 2) & (now > s["own"])
        pick = lambda test, value, old: F.when(test, value).otherwise(old)
        return F.struct(
            now.alias("sum"), pick(more, now, s["any"]).alias("any"), pick(more, e["at"], s["any_at"]).alias("any_at"),
            pick(mine, now, s["own"]).alias("own"), pick(mine, e["at"], s["own_at"]).alias("own_at"),
        )

    return F.aggregate(events, none, step, lambda s: F.struct(s["any"].alias("w"), F.when(s["own"] == s["any"], s["own_at"]).otherwise(s["any_at"]).alias("start")))


def _leaks(docs: DataFrame, benchmark: DataFrame, similarity: float) -> DataFrame:
    """doc_id, text_key, item_id, n_words, similarity and start of every different text and item row that it holds."""
    items = benchmark.select(F.col("item_id").cast("long"), _words("text").alias("words"))
    items = cut(items.withColumn("shingles", _shingles(F.col("words"))).where(F.size("words") > 0).withColumn("row", F.monotonically_increasing_id()))
    parts, wanted = _wanted(items, similarity)
    grams = _sized(parts.select("h").distinct())
    first = _sized(parts.where("leading").groupBy("h").agg(F.collect_list("row").alias("rows")))

    texts = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null")
    split = texts.select("doc_id", F.xxhash64("text").alias("text_key"), _shingles(_words("text")).alias("shingles"))
    # The outer form, as the inner one adds a filter that would compute the shingles twice; the join drops its nulls.
    hits = cut(split.select("doc_id", "text_key", F.posexplode_outer("shingles").alias("pos", "h")).join(grams, "h", "left_semi"))

    # Rows that repeat a text have each position several times.
    places = hits.groupBy("doc_id", "text_key", "h").agg(F.sort_array(F.collect_set("pos")).alias("places")).join(first, "h", "left")
    rows = F.array_distinct(F.flatten(F.collect_list("rows")))
    by_text = places.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("h", "places")).alias("hits"), rows.alias("rows"))
    pairs = by_text.where(F.size("rows") > 0).select("doc_id", "text_key", "hits", F.explode("rows").alias("row"))
    pairs = pairs.select("doc_id", "text_key", "row", F.explode("hits").alias("x")).select("doc_id", "text_key", "row", "x.*")
    both = pairs.join(wanted, ["row", "h"])
    bound = F.sum(F.col("w") * F.least("c", F.size("places").cast("long")))
    scored = both.groupBy("doc_id", "text_key", "row", "item_id", "n_words", "mass").agg(F.flatten(F.collect_list(_events())).alias("events"), bound.alias("bound"))
    least = (similarity - 1e-9) * F.col("mass")
    scored = scored.where(F.col("bound") >= least).withColumn("best", _sweep(F.sort_array("events"))).where(F.col("best.w") >= least)
    shared = F.round(F.col("best.w") / F.col("mass"), 9).alias("similarity")
    return scored.select("doc_id", "text_key", "item_id", "n_words", shared, F.col("best.start").alias("start"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id, similarity, start_word, n_words.

    One row for each document and item, with the item's best window (the first of equals); words are
    counted from 0. Case and punctuation don't count. Texts are searched whole; null and empty texts, and items without words,
    match nothing. An item of fewer than five words has one shingle, its whole sequence, which only a document
    of the same words has. Rows that repeat a doc_id are one document with several texts; rows that repeat
    an item_id are items of their own under one name. Other columns are not looked at; an empty table on either side
    gives no rows.
    """
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("b")
    best = _leaks(docs, benchmark, similarity).groupBy("doc_id", "item_id").agg(best)
    return best.select("doc_id", "item_id", "b.similarity", (-F.col("b.back")).cast("int").alias("start_word"), "b.n_words")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` without the rows whose text holds a benchmark item; all other rows and all columns stay.

    Rows are judged one by one: a clean text stays though another row has its doc_id, or neither has one.
    """
    leaks = _leaks(docs, benchmark, similarity).select(F.col("doc_id").alias("leaked_id"), F.col("text_key").alias("leaked_key")).distinct()
    names = [f"c{k}" for k in range(len(docs.columns))]  # free of clashes
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    same = doc_id.cast("long").eqNullSafe(F.col("leaked_id")) & (F.xxhash64(text) == F.col("leaked_key"))
    return docs.toDF(*names).join(leaks, same, "left_anti").toDF(*docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`contaminated` of all of the table `documents` by the table `benchmark`."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
