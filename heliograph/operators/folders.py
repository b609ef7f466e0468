"""The folder tree: counts of every folder with all below it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions.paths import ancestors, common_prefix
from heliograph.functions.scores import covers

#: Steps that a folder has done for some of its rows.
STEPS = ("analyzed", "blur", "dated", "nsfw", "deduped")


def rollup(rows: DataFrame, enabled: int = 1, root: str | None = None) -> DataFrame:
    """path, direct_count, total_count, done counts of the steps, in_dupe_group for each folder.

    Rows (of the view) are counted by folder first, so what is exploded to the folders above is a row for
    each folder. The top is the common beginning of all folders.
    """
    done = {
        "analyzed": F.col("analyzed_at").isNotNull(), "blur": F.col("blur_score").isNotNull(), "dated": F.col("exif_taken").isNotNull(), "nsfw": F.col("nsfw_score").isNotNull(),
        "deduped": F.coalesce(F.col("dupe_checked_at").isNotNull() & covers(F.col("dupe_checked_kinds"), enabled), F.lit(False)),
    }
    direct = rows.groupBy("folder").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in done.items()], F.count_if(F.col("dupe_group").isNotNull()).alias("in_dupe_group"))
    root = common_prefix(direct) if root is None else root
    up = direct.withColumn("path", F.explode(ancestors(F.col("folder"), root)))
    here = F.sum(F.when(F.col("path") == F.col("folder"), F.col("n")).otherwise(0)).alias("direct_count")
    return up.groupBy("path").agg(here, F.sum("n").alias("total_count"), *[F.sum(c).alias(c) for c in (*STEPS, "in_dupe_group")])


@dataclass
class Node:
    path: str
    name: str
    depth: int
    facts: dict = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)

    def pending(self) -> list[str]:
        words = {"analyzed": "not analysed", "deduped": "not checked for duplicates", "nsfw": "not scored", "blur": "without a sharpness score", "dated": "without a date"}
        total = self.facts.get("total_count", 0)
        return [f"{total - self.facts[k]} {words[k]}" for k in words if self.facts.get(k, 0) < total]


def tree(rolled: DataFrame) -> Node | None:
    """The tree of a roll-up, with chains of folders that only hold one folder shown as one.

    A row for each folder reaches the driver, as a tree is for looking at.
    """
    rows = {r["path"]: r.asDict() for r in rolled.collect()}
    if not rows:
        return None
    root = min(rows, key=lambda p: (len(p), p))
    nodes = {p: Node(p, p.rsplit("/", 1)[-1] or p or "/", 0, f) for p, f in rows.items()}
    for p in sorted(rows, key=len):
        if p == root:
            continue
        up = p.rsplit("/", 1)[0] if "/" in p else root
        while up not in nodes:
            up = up.rsplit("/", 1)[0] if "/" in up else root
        nodes[p].depth = nodes[up].depth + 1
        if root == "" and up == root:
            nodes[p].name = p
        nodes[up].children.append(nodes[p])
    _fold(nodes[root])
    return nodes[root]


def _fold(node: Node) -> None:
    for child in node.children:
        _fold(child)
    for k, child in enumerate(node.children):
        while not child.facts["direct_count"] and len(child.children) == 1:
            only = child.children[0]
            child = Node(only.path, f"{child.name}/{only.name}", child.depth, only.facts, only.children)
            node.children[k] = child
    node.children.sort(key=lambda x: x.name.upper())


def matching(rolled: DataFrame, query: str) -> DataFrame:
    """Folders whose name, or that of a folder below, has the query, case ignored."""
    name = F.element_at(F.split("path", "/"), -1)
    hits = rolled.where(F.upper(name).contains(query.strip().upper())).select("path")
    above = hits.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return rolled.join(above, "path", "left_semi")
