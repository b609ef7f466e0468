"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Of two fingerprints that differ in at
most two bits, one segment differs in at most one; with the wildcard at that bit both share a
signature (segment, wildcard, rest). Every distinct fingerprint is indexed under its 64
signatures, and equal signatures are verified by the Hamming distance.

What is shuffled is not the signatures: those whose wildcards lie in one octet of a segment share its other 24 bits, so a
fingerprint is sent once to each of eight such parts, and its signatures are made there.

A signature with more than `CROWD` fingerprints is never expanded into pairs. It is refined: two
bits of the whole fingerprint become wildcards, all members of one refined signature are within two
bits of each other, and a star around the smallest of them links them. So the work is linear in the
size of a crowd, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.llm.common import components, cut, give_back, pieces, table, tasks

CROWD = 64
SHINGLE = 3
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned integer; 0 for a null or a text without words."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: n - 1] + 1).tolist()]
        hash_of = xxhash.xxh64_intdigest
        hashes = [hash_of(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist())]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: bool = False) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long, one row for each row of `docs`.

    With `key` also text_key, what xxhash64(text) is in SQL.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch["text"].to_pylist()
            columns = {"doc_id": batch["doc_id"], "fp": np.array([fingerprint(x) for x in texts], dtype=np.uint64).view(np.int64)}
            if key:
                columns["text_key"] = np.array([42 if x is None else xxhash.xxh64_intdigest(x.encode("utf-8"), 42) for x in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({name: pa.array(x) if isinstance(x, np.ndarray) else x for name, x in columns.items()})
        give_back()  # in the pipeline this worker held the model of toxicity before

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long" + ", text_key long" * key)


def _bit(k) -> F.Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def _half(k) -> F.Column:
    """The segment of fp that bit k is of."""
    return F.when(k < 32, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))


def _shared(fps: DataFrame) -> DataFrame:
    """(key, fp, n, a, b): the signatures that n > 1 fingerprints have, a row for each of them; a and b are their least and largest.

    key: wildcard's bit and the rest of its segment. Rows lie by part, which is an octet and the other bits of its segment, and
    fingerprints that are alone in their part are not given signatures there.
    """
    octet = F.col("octet")
    rest = _half(octet * 8).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(255).cast("long"), octet % 4 * 8)))
    parts = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("octet"))
    # As many tasks as the session asks for: what is shuffled is narrow, and each row gives eight.
    parts = parts.select("fp", (octet.cast("long") * (1 << 32) + rest).alias("part")).repartition(tasks(fps.sparkSession), "part")
    met = parts.withColumn("n", F.count("*").over(Window.partitionBy("part"))).where("n > 1").drop("n")
    first = F.shiftrightunsigned("part", 32).cast("int") * 8
    k = F.col("k")
    keys = met.select("part", "fp", F.explode(F.sequence(first, first + 7)).alias("k"))
    keys = keys.select("part", "fp", (k.cast("long") * (1 << 32) + _half(k).bitwiseAND(F.bitwise_not(_bit(k % 32)))).alias("key"))
    same = Window.partitionBy("key", "part")  # a key is in one part; with it in the window rows stay where they are
    of = [F.count("*").over(same).alias("n"), F.min("fp").over(same).alias("a"), F.max("fp").over(same).alias("b")]
    return keys.select("key", "fp", *of).where("n > 1")


def _two_wild(crowded: DataFrame) -> DataFrame:
    """(pair, rest, fp): the refined signatures of rows (k, fp), k the wildcard of a crowded one.

    Where bit k of one segment is wild, the other wildcard is a bit of the other segment. Two
    fingerprints equal in the segment can also differ in two bits of the other; those pairs are
    made once, at the segment's first bit.
    """
    other = F.when(F.col("k") < 32, F.lit(32)).otherwise(F.lit(0))
    across = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.struct(F.col("k").alias("i"), (other + j).alias("j")))
    inside = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(30)),
            lambda i: F.transform(F.sequence(i + 1, F.lit(31)), lambda j: F.struct((other + i).alias("i"), (other + j).alias("j"))),
        )
    )
    pairs = crowded.select("fp", F.explode(F.when(F.col("k") % 32 == 0, F.concat(across, inside)).otherwise(across)).alias("p"))
    wild = _bit(F.least("p.i", "p.j")).bitwiseOR(_bit(F.greatest("p.i", "p.j")))
    return pairs.select(
        (F.least("p.i", "p.j") * 64 + F.greatest("p.i", "p.j")).alias("pair"),
        F.col("fp").bitwiseAND(F.bitwise_not(wild)).alias("rest"),
        "fp",
    )


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints of `fps` (column fp, each once).

    Links within a crowd are a spanning star of each refined signature, all others are complete;
    so the links have the connected components of the full relation.
    """
    shared = cut(_shared(fps).where("n > 2 or fp = a"))
    pairs = shared.where("n = 2").select("a", "b")
    some = shared.where(f"n > 2 and n <= {crowd}").select("key", "fp")
    pairs = pairs.union(some.alias("x").join(some.alias("y"), F.expr("x.key = y.key and x.fp < y.fp")).select(F.col("x.fp"), F.col("y.fp")))
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    crowds = shared.where(f"n > {crowd}").select(F.shiftrightunsigned("key", 32).cast("int").alias("k"), "fp")
    fine = _two_wild(crowds)
    stars = fine.groupBy("pair", "rest").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b")
    stars = cut(stars)
    more = fine.join(stars.where("n > 2").select("pair", "rest", "a"), ["pair", "rest"]).where("fp != a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars.where("n = 2").select("a", "b")).union(more).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of documents whose fingerprints are linked at two or fewer differing bits.

    Returns doc_id, fingerprint (16 lower-case hex digits) and component_id, the smallest doc_id
    reachable over links, itself included; one row for each row of `docs`. Null and empty texts have
    fingerprint zero and are linked like any other; a text of any length has one fingerprint. Rows that repeat a doc_id are
    kept as rows. A null doc_id is no candidate for component_id unless all of its group are null. Other columns are not
    looked at; an empty table gives no rows.
    """
    prints = cut(fingerprints(docs))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = cut(components(links(classes.select("fp"))))
    of = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = of.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each group of near-duplicates: the first by doc_id (nulls last), then by the text's hash.

    Rows are judged one by one, so rows that share a doc_id, or have none, but are no near-duplicates all stay;
    of rows equal in doc_id and text the first as JSON stays. Null and empty texts and those without words are
    one group. All columns are kept, of any type and name; an empty table gives no rows.
    """
    prints = cut(fingerprints(docs, key=True))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    classes = prints.groupBy("fp").agg(first.alias("first"))
    classes = cut(classes)
    roots = cut(components(links(classes.select("fp"))))
    of = classes.join(roots, F.col("fp") == F.col("node"), "left").select("first", F.coalesce("root", "fp").alias("root"))
    kept = of.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_key").alias("kept_key"))
    repeated = prints.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    repeated = cut(repeated)
    names = [f"c{k}" for k in range(len(docs.columns))]  # free of clashes
    rows = docs.toDF(*names)
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    same = doc_id.cast("long").eqNullSafe(F.col("kept_id")) & (F.xxhash64(text) == F.col("kept_key"))
    rows = rows.join(kept, same, "left_semi")
    if not repeated.isEmpty():
        again = rows.join(repeated, same, "left_semi").withColumn("row", F.struct(*names)).withColumn("key", F.xxhash64(text))
        again = again.groupBy(doc_id.alias("id"), "key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
        rows = rows.join(repeated, same, "left_anti").unionByName(again)
    return rows.toDF(*docs.columns)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`near_duplicates` of all of the table `documents`."""
    return near_duplicates(table(spark, sf_dir, "documents"))
