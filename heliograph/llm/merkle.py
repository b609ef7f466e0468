"""Merkle manifest of a table, with a small top tree at the driver.

Leaves are hashed by the JVM and ordered by ranges; what ranges need of each other (how many rows of a source came
before) is one row a range. Every `3 ** LEVELS` consecutive leaves of a source are a block, reduced by one task to the
block's node, so a source with a third of all rows is many blocks. Blocks are reduced again as long as more than `TOP` nodes
are left. Of those the driver builds the top of the tree, up to the subroots and the root, and broadcasts each node's path to the
root (the suffix of the proofs below it). Tasks then finish the proofs of a block's rows and fold every row by its proof.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import cut, table, tasks

#: Fixed value: children of a node.
ARITY = 3
#: Levels of the tree in a block: 729 leaves.
LEVELS = 6
#: Nodes from which the driver builds the top: some 4 MB of paths.
TOP = 4096
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def leaf(values: list[Column]) -> Column:
    """SHA-256 of the values' bytes, each after its count; a null is a dash."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(c.cast("string")) for c in values]), 256)


def grow(nodes: list[str], levels: int | None = None) -> list[list[str]]:
    """The levels of a tree from the nodes up: as many as asked for, else until one node is left."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        out.append([digest("".join(out[-1][k : k + ARITY])) for k in range(0, len(out[-1]), ARITY)])
    return out


def path(levels: list[list[str]], at: int) -> str:
    """A node's way up: for each level what stands left and right of it in its run, as `left|right,`."""
    steps = []
    for level in levels[:-1]:
        first = at - at % ARITY
        steps.append("".join(level[first:at]) + "|" + "".join(level[at + 1 : first + ARITY]) + ",")
        at //= ARITY
    return "".join(steps)


def proof(way: str) -> str:
    """The proof's digest: all siblings in order."""
    return digest(way.replace("|", "").replace(",", ""))


def fold(node: str, way: str) -> str:
    """The root that a node and its way up give."""
    for step in way.split(",")[:-1]:
        left, _, right = step.partition("|")
        node = digest(left + node + right)
    return node


def _levels(block: int, count: int, levels: int) -> int | None:
    """A later block, or a full one, has all levels; a source's only block stops at one node."""
    return levels if block > 0 or count == ARITY**levels else None


def _ordered(leaves: DataFrame) -> DataFrame:
    """`leaves` with grp and pos: the number of the source (null first) and the leaf's place in it (by doc_id, nulls first).

    Rows equal in both go by their leaf. Rows are sorted by ranges; a third of all rows may be equal in everything.
    """
    spark, order = leaves.sparkSession, ["source", "doc_id", "leaf", "spread"]
    spread = leaves.withColumn("spread", F.monotonically_increasing_id())
    ranged = cut(spread.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order).drop("spread").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part", "source").agg(F.count("*").alias("n"))
    edge = lambda f: f(F.struct("source", "n"))
    parts = counts.groupBy("part").agg(edge(F.min).alias("first"), edge(F.max).alias("last"), F.count("*").alias("sources"))
    before, last, groups = {}, None, 0  # of each range: rows of its first source before it, and that source's number
    for p in sorted(parts.collect(), key=lambda r: r["part"]):  # one row a range
        again = last is not None and last[0] == p["first"]["source"]
        carried, number = (last[1], groups - 1) if again else (0, groups)
        before[p["part"]] = (carried, number)
        groups = number + p["sources"]
        last = (p["last"]["source"], p["last"]["n"] + (carried if p["sources"] == 1 else 0))
    known = spark.sparkContext.broadcast(before)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, source, at, group = False, None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch["source"].to_pylist()
            if not seen:
                (at, group), source, seen = known.value[batch["part"][0].as_py()], names[0], True
            grp, pos = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
            for k, name in enumerate(names):
                if name != source:
                    source, at, group = name, 0, group + 1
                grp[k], pos[k] = group, at
                at += 1
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["leaf"], batch["tampered"], pa.array(grp), pa.array(pos)], ["doc_id", "leaf", "tampered", "grp", "pos"])

    return ranged.mapInArrow(place, "doc_id long, leaf string, tampered string, grp long, pos long")


def _block(levels: int) -> Column:
    return F.floor(F.col("pos") / ARITY**levels).cast("long")


def _climb(nodes: DataFrame, levels: int, top: int, within: bool = True):
    """For each node (grp, pos, leaf) its way to the root: path, subroot, root.

    A dict for all executors where the driver builds the tree, else a table. `within`: a source's nodes are under one
    subroot, and these under the root; else all nodes are subroots.
    """
    spark = nodes.sparkSession
    count, last = nodes.agg(F.count("*"), F.max("pos")).first()
    if count <= top:
        return spark.sparkContext.broadcast(_top(nodes, within))
    if within and last == 0:
        across = nodes.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), "leaf")
        known = _climb(across, levels, top, False)  # a table, as there are as many
        return known.select(F.col("pos").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", F.col("leaf").alias("subroot"), "root")
    return _finished(nodes, _climb(_reduced(nodes, levels), levels, top, within), levels)


def _top(nodes: DataFrame, within: bool) -> dict:
    found: dict[int, list[str]] = {}
    for r in nodes.orderBy("grp", "pos").collect():  # at most `top` rows
        found.setdefault(r["grp"], []).append(r["leaf"])
    if not found:
        return {}
    trees = {g: grow(x) for g, x in found.items()}
    heads = grow([trees[g][-1][0] for g in sorted(trees)]) if within else None
    out = {}
    for k, g in enumerate(sorted(trees)):
        tree = trees[g]
        above, root = (path(heads, k), heads[-1][0]) if within else ("", tree[-1][0])
        for at in range(len(tree[0])):
            out[g, at] = (path(tree, at) + above, tree[-1][0], root)
    return out


def _reduced(nodes: DataFrame, levels: int) -> DataFrame:
    """The node of each block, as a node of the next stage."""

    def one(key: tuple, block: pa.Table) -> pa.Table:
        leaves = block.sort_by("pos")["leaf"].to_pylist()
        tree = grow(leaves, _levels(key[1].as_py(), len(leaves), levels))
        return pa.table({"grp": [key[0].as_py()], "pos": [key[1].as_py()], "leaf": tree[-1]})

    return cut(nodes.select("grp", "pos", "leaf").groupBy("grp", _block(levels).alias("block")).applyInArrow(one, "grp long, pos long, leaf string"))


def _finished(nodes: DataFrame, upper, levels: int) -> DataFrame:
    """Nodes with path, subroot, root, proof_sha256 and, where they have `tampered`, folded_root."""
    extra = [c for c in ("doc_id", "tampered") if c in nodes.columns]
    kind = {"doc_id": "long", "tampered": "string", "grp": "long", "pos": "long"}
    columns = [*extra, "grp", "pos", "leaf", "path", "subroot", "root"] if not extra else ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = ", ".join(f"{c} {kind.get(c, 'string')}" for c in columns)

    def finish(key: tuple, block: pa.Table, above: tuple[str, str, str]) -> pa.Table:
        block, (suffix, subroot, root) = block.sort_by("pos"), above
        leaves = block["leaf"].to_pylist()
        tree = grow(leaves, _levels(key[1].as_py(), len(leaves), levels))
        ways = [path(tree, k) + suffix for k in range(len(leaves))]
        out = {c: block[c] for c in ("doc_id", "grp", "pos", "leaf") if c in columns} | {"path": ways, "subroot": [subroot] * len(ways), "root": [root] * len(ways)}
        if extra:
            out |= {"proof_sha256": [proof(w) for w in ways], "folded_root": [fold(x, w) for x, w in zip(block["tampered"].to_pylist(), ways)]}
        return pa.table({c: out[c] for c in columns})

    grouped = nodes.select(*extra, "grp", "pos", "leaf").groupBy("grp", _block(levels).alias("block"))
    if isinstance(upper, DataFrame):
        of_block = lambda key, block, above: finish(key, block, tuple(above[c][0].as_py() for c in ("path", "subroot", "root")))
        return grouped.cogroup(upper.groupBy("grp", F.col("pos").alias("block"))).applyInArrow(of_block, schema)
    return grouped.applyInArrow(lambda key, block: finish(key, block, upper.value[key[0].as_py(), key[1].as_py()]), schema)


def manifest(docs: DataFrame, levels: int = LEVELS, top: int = TOP) -> DataFrame:
    """Leaf, subroot, root and proof of each row of `docs`, and the root that it gives after tampering.

    A leaf is the hash of doc_id, source, lang, n_chars and text, each a dash where null. Leaves ascend by doc_id within a
    source (null ids first; rows equal in it by their leaf); a null source is one of its own, the first. Returns doc_id, leaf,
    subroot, root, proof_sha256, folded_root and verified; one row for each row, repeated ones too. Rows whose decimal
    doc_id has an even CRC-32 are tampered with (line feeds go); null ids are not. Other columns are not looked at, texts of any
    length are hashed whole, and an empty table gives no rows.
    """
    rows = docs.select(*[F.col(c) for c in FIELDS])
    values = [F.col(c) for c in FIELDS]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    leaves = cut(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf(values).alias("leaf"), leaf([*values[:-1], text]).alias("tampered")))
    nodes = cut(_ordered(leaves))
    done = _finished(nodes, _climb(_reduced(nodes, levels), levels, top), levels)
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`manifest` of all of the table `documents`."""
    return manifest(table(spark, sf_dir, "documents"))


#: CRC-32 of the bytes of `{0}` in SQL: the polynomial's eight steps for each byte.
CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, length(hex({0})) // 2), lambda i: ('0x' || substr(hex({0}), (2 * i + 1)::INT, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, list_reduce(list_prepend(xor(c, b) & 255, range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))))"""

ORACLE_SQL = f"""
WITH RECURSIVE part AS (
  SELECT doc_id, source, lang, n_chars, text,
         CASE WHEN {CRC32.format("doc_id::VARCHAR")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut_text
  FROM documents),
coded AS (
  SELECT doc_id, source,
         concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
         coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(cut_text) || ':' || cut_text, '-') AS cut_body
  FROM part),
leaves AS (
  SELECT doc_id, sha256(head || body) AS leaf, sha256(head || cut_body) AS tampered, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM coded),
low AS (
  SELECT grp, 0 AS level, pos, leaf AS h, n FROM leaves
  UNION ALL
  SELECT grp, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM low WHERE n > 1 GROUP BY grp, level, pos // 3),
sub AS (SELECT grp, h AS subroot, max(level) OVER () AS deepest, level AS depth, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, grp AS pos, subroot AS h, n FROM sub
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM high WHERE n > 1 GROUP BY level, pos // 3),
steps AS (
  SELECT l.doc_id, l.grp, l.pos AS leaf_pos, s.level AS step,
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < l.pos // (3 ** s.level)::BIGINT), '') AS lhs,
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > l.pos // (3 ** s.level)::BIGINT), '') AS rhs
  FROM leaves l JOIN low s ON s.grp = l.grp AND s.n > 1 AND s.pos // 3 = l.pos // (3 ** (s.level + 1))::BIGINT
  GROUP BY ALL
  UNION ALL
  SELECT l.doc_id, l.grp, l.pos, b.depth + s.level,
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < l.grp // (3 ** s.level)::BIGINT), ''),
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > l.grp // (3 ** s.level)::BIGINT), '')
  FROM leaves l JOIN sub b ON b.grp = l.grp JOIN high s ON s.n > 1 AND s.pos // 3 = l.grp // (3 ** (s.level + 1))::BIGINT
  GROUP BY l.doc_id, l.grp, l.pos, b.depth, s.level),
folded AS (
  SELECT grp, pos, 0 AS step, tampered AS h FROM leaves
  UNION ALL
  SELECT f.grp, f.pos, f.step + 1, sha256(s.lhs || f.h || s.rhs) FROM folded f JOIN steps s ON s.grp = f.grp AND s.leaf_pos = f.pos AND s.step = f.step),
last AS (SELECT grp, pos, arg_max(h, step) AS folded_root FROM folded GROUP BY grp, pos),
proofs AS (SELECT grp, leaf_pos AS pos, sha256(string_agg(lhs || rhs, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY grp, leaf_pos)
SELECT l.doc_id, l.leaf, b.subroot, r.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = r.h AS verified
FROM leaves l JOIN sub b ON b.grp = l.grp JOIN high r ON r.n = 1 JOIN last f ON f.grp = l.grp AND f.pos = l.pos LEFT JOIN proofs p ON p.grp = l.grp AND p.pos = l.pos
"""
