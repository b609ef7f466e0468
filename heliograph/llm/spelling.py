"""Spelling variants: words at distance one by trie self-joins over partitions of the vocabulary.

Two words at distance one, the shorter of length L, are equal before the first place where they differ and behind it. So
they share the first half of L or the last one, and with it a partition: each word is in those of its own length and
of one less, by prefix and by suffix. A partition that is crowded is parted again by the halves of what its words don't share, which
ends where one letter is left. A task builds a partition's trie of what is not shared and goes down it with the set of
active nodes, those within one edit of the node it is at; a word's node emits the words that end in its active nodes.
Where the two words first differ says which one of all partitions reports a pair, so nothing is found twice.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import cut, table
from heliograph.llm.merkle import CRC32

#: Words of fewer code points, and of fewer occurrences, are none.
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: One in so many runs of a document loses a code point.
LOSES = 31
#: A form has at least so many times the word's occurrences.
TIMES = 10
#: Words that a partition's trie is built of; larger ones are parted again.
CROWD = 128
#: Partitions with more words than this, and than a thousandth of all, are known to every task: a thousand of them at most.
HOT = 8192

LETTERS = "[A-Za-zÀ-ÿ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(run: Column) -> Column:
    """A-Z in lower case; where all is ASCII the JVM's own way does it."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, _UPPER, _LOWER))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts with their occurrences."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", _lowered(F.col("run")).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    size = F.length("run")
    at = (F.col("h") % size).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    word = F.when(F.col("h") % LOSES == 0, shorter).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LENGTH))


def trie_pairs(words: list[str]) -> list[tuple[int, int]]:
    """(i, j), i < j: places of different words at distance one, by a trie and its active nodes."""
    children: list[dict[str, int]] = [{}]
    ends: list[int] = [-1]
    for k, word in enumerate(words):
        node = 0
        for letter in word:
            if (below := children[node].get(letter)) is None:
                below = children[node][letter] = len(children)
                children.append({})
                ends.append(-1)
            node = below
        ends[node] = k
    out, stack = [], [(0, set(children[0].values()))]
    while stack:
        node, active = stack.pop()  # active: the nodes at distance one of this one
        if (own := ends[node]) >= 0:
            out += [(own, ends[v]) for v in active if ends[v] > own]
        below = children[node]
        for letter, child in below.items():
            near = {w for v in active if (w := children[v].get(letter)) is not None}  # the edit is above
            near.update(below.values())  # the letter replaced
            near.add(node)  # deleted
            near.discard(child)
            near.update(children[child].values())  # another one inserted
            stack.append((child, near))
    return out


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, short, head, tail, until) with key: a hash of the partition's shared letters.

    short: length of the shorter word of a pair; head, tail: code points shared in front and behind; until: pairs
    first differ before this place.
    """
    back = F.substring("word", F.length("word") - F.col("tail") + 1, F.col("tail"))
    return rows.withColumn("key", F.xxhash64("short", "head", "tail", F.substring("word", F.lit(1), F.col("head")), back))


def _parted(rows: DataFrame) -> DataFrame:
    """Each row in the two halves of what its partition doesn't share."""
    at = F.col("head") + F.floor((F.col("short") - F.col("head") - F.col("tail")) / 2).cast("int")
    front = F.struct(at.alias("head"), F.col("tail").alias("tail"), F.col("until").alias("until"))
    behind = F.struct(F.col("head").alias("head"), (F.col("short") - at).alias("tail"), at.alias("until"))
    return rows.select("word", "n", "short", F.explode(F.array(front, behind)).alias("p")).select("word", "n", "short", "p.*")


def _joined(partitions: DataFrame) -> DataFrame:
    """(a, b, na, nb) of rows (short, head, tail, until, words): a task's tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = [], [], [], []
            columns = [batch[c].to_pylist() for c in ("short", "head", "tail", "until")]
            lists, values = batch["words"], batch["words"].values
            words, counts, ends = values.field("word").to_pylist(), values.field("n").to_pylist(), lists.offsets.to_pylist()
            for k, (short, head, tail, until) in enumerate(zip(*columns)):
                apart: dict[tuple[str, str], list[int]] = {}  # by the letters themselves, as keys are hashes
                for i in range(ends[k], ends[k + 1]):
                    w = words[i]
                    apart.setdefault((w[:head], w[len(w) - tail :]), []).append(i)
                for ids in apart.values():
                    if len(ids) < 2:
                        continue
                    for i, j in trie_pairs([words[x][head : len(words[x]) - tail] for x in ids]):
                        x, y = ids[i], ids[j]
                        v, w = words[x], words[y]
                        if min(len(v), len(w)) == short and len(os.path.commonprefix((v, w))) < until:
                            a.append(v), b.append(w), na.append(counts[x]), nb.append(counts[y])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "na": pa.array(na, pa.int64()), "nb": pa.array(nb, pa.int64())})

    return partitions.mapInArrow(run, "a string, b string, na long, nb long")


def near_pairs(words: DataFrame, crowd: int = CROWD, hot: int = HOT) -> DataFrame:
    """(a, b, na, nb): each pair of words (word, n; words distinct) at distance one, once."""
    long = F.length("word")
    lengths = F.explode(F.array(long, long - 1)).alias("short")
    whole = words.select("word", "n", lengths).where("short > 0").select("*", F.lit(0).alias("head"), F.lit(0).alias("tail"), (F.col("short") + 1).alias("until"))
    rows, found = _keyed(_parted(whole)), None
    while True:
        sizes = cut(rows.groupBy("key").agg(F.count("*").alias("size"), F.max(F.col("short") - F.col("head") - F.col("tail")).alias("apart")).where("size > 1"))
        total = sizes.agg(F.sum("size")).first()[0] or 0
        again = f"size > {crowd} and apart > 1"
        known = sizes.where(f"size > {max(hot, crowd, total // 1000)} and apart > 1").select("key")
        cold = rows.join(F.broadcast(known), "key", "left_anti").join(sizes, "key")
        few = cold.where(f"not ({again})").groupBy("key").agg(*[F.first(c).alias(c) for c in ("short", "head", "tail", "until")], F.collect_list(F.struct("word", "n")).alias("words"))
        pairs = _joined(few)
        found = pairs if found is None else found.union(pairs)
        if sizes.where(again).isEmpty():
            return found
        crowded = cold.where(again).select("word", "n", "short", "head", "tail", "until").union(rows.join(F.broadcast(known), "key", "left_semi").select("word", "n", "short", "head", "tail", "until"))
        rows = cut(_keyed(_parted(crowded)))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: forms are followed by doubling. A form has ten times the occurrences, so chains are short."""
    known = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        next_ = known.select(F.col("word").alias("w"), F.col("root").alias("r"))
        after = cut(known.join(next_, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")))
        known = after.select("word", "root")
        if after.where("moved").isEmpty():
            return known


def variants(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The words of all texts, each with the far more frequent word that it is a variant of.

    Words are the runs of letters, A-Z in lower case, one in 31 of a document's without one code point, that have
    seven code points and two occurrences. Two are near if they differ by exactly one code point inserted, deleted or replaced. form: the
    near word of most occurrences (ties: first in code-point order) if it has ten times the word's, else null; root:
    where forms lead; n, n_near, form_n: occurrences, near words, the form's occurrences. A null text has no words, a
    null doc_id counts as an empty one, rows that repeat a doc_id all count. Runs of any length are whole words. Other columns
    are not looked at; an empty table gives no rows.
    """
    words = cut(vocabulary(docs))
    pairs = near_pairs(words, crowd)
    sides = [F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col("n" + y).alias("m"), F.col("n" + x).alias("n")) for x, y in ("ab", "ba")]
    both = pairs.select(F.explode(F.array(*sides)).alias("s")).select("s.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"), F.first("n").alias("n"))
    most = -F.col("best.less")
    best = cut(best.select("word", "n_near", *[F.when(most >= TIMES * F.col("n"), x).alias(y) for x, y in ((F.col("best.near"), "form"), (most, "form_n"))]))
    roots = _roots(best.where("form is not null"))
    out = words.join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`variants` of all of the table `documents`."""
    return variants(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
counted AS (SELECT concat(doc_id, ':', run) AS tagged, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {CRC32.format("encode(tagged)")} AS h FROM counted),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
gaps AS (
  SELECT word, n, i, substr(word, 1, i) AS head, substr(word, i + 2) AS rest FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)),
near AS (
  SELECT x.word, x.n, y.word AS other, y.n AS m FROM gaps x JOIN gaps y ON x.i = y.i AND x.head = y.head AND x.rest = y.rest AND x.word <> y.word
  UNION
  SELECT g.word, g.n, w.word, w.n FROM gaps g JOIN words w ON w.word = g.head || g.rest
  UNION
  SELECT w.word, w.n, g.word, g.n FROM gaps g JOIN words w ON w.word = g.head || g.rest),
ranked AS (
  SELECT word, n, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(other)) AS place FROM near),
best AS (SELECT word, n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM ranked WHERE place = 1),
chain AS (
  SELECT word, word AS seen, 0 AS step FROM words
  UNION ALL
  SELECT c.word, b.form, c.step + 1 FROM chain c JOIN best b ON b.word = c.seen WHERE b.form IS NOT NULL),
roots AS (SELECT word, arg_max(seen, step) AS root FROM chain GROUP BY word)
SELECT w.word, b.form, r.root, w.n, coalesce(b.n_near, 0) AS n_near, b.form_n
FROM words w JOIN roots r USING (word) LEFT JOIN best b USING (word)
"""
