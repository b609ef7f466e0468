"""Duplicate groups: exact, variant and burst; keepers; reconciliation; the whole detection.

Tables: groups (id, kind, similarity), members (group_id, image_id, is_keeper). Group ids follow the
order kind, then first member, so they don't depend on how a job was run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph import schema
from heliograph.functions.paths import in_scope
from heliograph.graph import components, cut
from heliograph.operators import linkage
from heliograph.operators.similarity import burst_pairs, class_links, class_links_brute, signature_classes, uses_bands, variant_pairs
from heliograph.sources.catalog import Settings, detector_rows

#: Fixed value: pairs that clustering takes.
PAIR_CAP = 2_000_000


def keeper_rank(rule: str = "resolution") -> Column:
    """The keeper has the least of these. resolution: pixels, bytes, then path; sharpest: blur (none last) before them."""
    size = [-F.col("pixels"), -F.col("bytes"), F.col("path"), F.col("image_id")]
    return F.struct(F.col("blur").isNull(), -F.col("blur"), *size) if rule == "sharpest" else F.struct(*size)


def with_keeper(members: DataFrame, rows: DataFrame, rule: str = "resolution") -> DataFrame:
    """Members (key, image_id) with is_keeper: one of each group.

    The keeper is found by an aggregation with map-side minima, so a group with a third of all rows is no
    task's burden; the join back is one that adaptive execution can split.
    """
    facts = rows.select(F.col("id").alias("image_id"), "path", "pixels", "bytes", *(["blur"] if rule == "sharpest" else []))
    best = members.join(facts, "image_id").groupBy("key").agg(F.min_by("image_id", keeper_rank(rule)).alias("keeper"))
    return members.join(best, "key").withColumn("is_keeper", F.col("image_id") == F.col("keeper")).select(*members.columns, "is_keeper")


def exact_members(images: DataFrame, root: str | None = None) -> DataFrame:
    """(key, image_id) of content found more than once; counted under the root, so copies outside don't count."""
    scoped = images.where(in_scope(F.col("path"), root) & F.col("content_hash").isNotNull()).select("id", "content_hash")
    many = scoped.groupBy("content_hash").agg(F.count("*").alias("n")).where("n > 1").select("content_hash")
    return scoped.join(many, "content_hash").select(F.col("content_hash").alias("key"), F.col("id").alias("image_id"))


#: Pairs that are sorted to find where a cap falls.
SORTED = 100_000
#: Ranges that are counted at once to find it.
RANGES = 256


def capped(pairs: DataFrame, cap: int | None = PAIR_CAP) -> tuple[DataFrame, bool]:
    """The nearest `cap` pairs by (distance, a, b), and whether there were more; None takes all.

    Pairs are counted by distance, and all of a distance are taken as long as they are within the cap. Of the distance at
    which it falls, counts of ranges of ids narrow down where; only the last range is sorted.
    """
    if cap is None:
        return pairs, False
    some, taken = cut(pairs), []
    counts = sorted(some.groupBy("distance").agg(F.count("*").alias("n")).collect())  # one row for each distance
    if sum(r["n"] for r in counts) <= cap:
        return some, False
    for r in counts:
        if r["n"] > cap:
            break
        taken.append(r["distance"])
        cap -= r["n"]
    last = _first(some.where(F.col("distance") == r["distance"]), ["a", "b"], cap)
    return some.where(F.col("distance").isin(taken)).union(last), True


def _first(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n of rows, whose `order` is unique, without sorting all of them."""
    low, high, size = rows.agg(F.min(order[0]), F.max(order[0]), F.count("*")).first()
    out = rows.limit(0)
    while n > 0 and size > SORTED:
        if low == high:
            return out.union(_first(rows, order[1:], n))
        step = -(-(high - low + 1) // RANGES)
        place = F.floor((F.col(order[0]) - low) / step) if high - low < 1 << 52 else F.shiftright(F.col(order[0]), (step - 1).bit_length())
        found = sorted(rows.groupBy(place.cast("long").alias("p")).agg(F.count("*").alias("n"), F.min(order[0]).alias("low"), F.max(order[0]).alias("high")).collect(), key=lambda r: r["low"])
        before = 0
        for r in found:  # at most some 512 rows
            if before + r["n"] > n:
                break
            before += r["n"]
        else:
            return out.union(rows)
        n -= before
        out = out.union(rows.where(F.col(order[0]) < r["low"]))
        low, high, size = r["low"], r["high"], r["n"]
        rows = rows.where(F.col(order[0]).between(low, high))
    return out.union(rows.orderBy(*order).limit(n)) if n > 0 else out


def greedy_cliques(pairs: list[tuple[int, int, int]], within) -> list[list[int]]:
    """Complete-linkage groups of pairs (a, b, distance), closest pair first; within(member, candidate) is directed.

    Two free ends make a group; one free end joins if it is within every member; two groups merge if all
    members of the left are within all of the right. Groups come in order of creation, members by id.
    """
    return linkage.greedy([(a, b, (d, a, b)) for a, b, d in pairs], within)


def cliques(pairs: DataFrame, rows: DataFrame, threshold: int, words: int, rotations: bool, small: int = linkage.SMALL, leaves: int = linkage.LEAVES) -> DataFrame:
    """(key, image_id): greedy cliques of the pair graph; key is the smallest member.

    Rows are atoms, and signatures are compared where a pair asks for it, as admission tests pairs that are not edges.
    """
    pairs = cut(pairs)  # read for edges and for nodes
    edges = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("distance").alias("d"), "a", "b")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("atom")).distinct()
    atoms = nodes.join(rows.select(F.col("id").alias("atom"), F.col("phash").alias("sign")), "atom").select("atom", F.lit(True).alias("lone"), "sign")
    found = cut(linkage.linked(edges, atoms, linkage.Within(threshold, words, rotations), not rotations, small, leaves))
    keys = found.groupBy("cluster").agg(F.min("atom").alias("key"), F.count("*").alias("n")).where("n > 1")
    return found.join(keys, "cluster").select("key", F.col("atom").alias("image_id"))


def _atoms(members: DataFrame, classes: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is together before any pair of a distance above 0: units (c, atom, first, last, n), near with the pairs inside
    classes that are not, and members (id, c, atom). An atom is named by its least id.

    Rows of a class are. Where turns make different classes equal, those of a component are too as far as pairs at 0
    link them, provided that all its classes are within the threshold of each other both ways; else each row is an atom.
    """
    zero = cut(near.where("distance = 0").select("ca", "cb"))
    if zero.isEmpty():
        units = classes.select("c", F.col("first").alias("atom"), "first", "last", "n")
        return units, near, members.join(units.select("c", "atom"), "c")
    roots = cut(components(zero, "ca", "cb"))
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias("r" + c))
    inside = near.join(side("ca"), "ca").join(side("cb"), "cb").where("rca = rcb").groupBy(F.col("rca").alias("root")).agg(F.count("*").alias("n"))
    full = roots.groupBy("root").agg(F.count("*").alias("k")).join(inside, "root").where("n = k * (k - 1)").select("root")
    loose = cut(roots.join(full, "root", "left_anti").select(F.col("node").alias("c")))
    ends = lambda c: classes.select(F.col("c").alias(c), F.col("first").alias("f" + c), F.col("last").alias("l" + c))
    links = zero.join(loose.withColumnRenamed("c", "ca"), "ca", "left_anti").join(ends("ca"), "ca").join(ends("cb"), "cb").where("fca < lcb").select("ca", "cb")
    of = cut(components(links, "ca", "cb"))
    whole = classes.join(loose, "c", "left_anti").join(of, F.col("c") == F.col("node"), "left").select("c", F.coalesce("root", "c").alias("root"), "first", "last", "n")
    named = whole.groupBy("root").agg(F.min("first").alias("atom"))
    apart = members.join(loose, "c")
    units = whole.join(named, "root").select("c", "atom", "first", "last", "n").union(apart.select("c", "id", "id", "id", F.lit(1).cast("long")))
    ids = members.join(whole.join(named, "root").select("c", "atom"), "c").union(apart.select("c", "id", "id")).select("id", "c", "atom")
    return cut(units), near.unionByName(loose.select(F.col("c").alias("ca"), F.col("c").alias("cb"), F.lit(0).alias("distance"))), ids


def variant_groups(rows: DataFrame, threshold: int, words: int = schema.WORDS, bits: int = schema.BITS, rotations: bool = True, small: int = linkage.SMALL, leaves: int = linkage.LEAVES) -> DataFrame:
    """(key, image_id): greedy cliques of all rows with signatures, over classes of equal ones; key is the smallest member.

    The same as `cliques` of all pairs, without the pairs of copies: a class of n rows is one atom, and of the pairs of two
    atoms only the first counts. Where being within the threshold has no direction, that is all. Turns can give it one:
    in components with two classes of which only one is within the threshold of the other, rows without copies keep their pairs
    with every copy.
    """
    members, classes = signature_classes(rows, words, rotations)
    members = cut(members)
    links = class_links(classes, threshold, words, bits, rotations) if uses_bands(threshold, bits) else class_links_brute(classes, threshold, words, rotations)
    units, near, ids = _atoms(members, classes, cut(links))
    units, ids = cut(units), cut(ids)
    back = near.select(F.col("ca").alias("cb"), F.col("cb").alias("ca"), F.col("distance").alias("back"))
    near = cut(near.join(back, ["ca", "cb"], "left"))
    side = lambda c, a: units.select(F.col("c").alias(c), *[F.col(x).alias(a + x) for x in ("atom", "first", "last")])
    pairs = near.join(side("ca", "x_"), "ca").join(side("cb", "y_"), "cb").where("x_atom != y_atom")
    pairs = cut(pairs.select("ca", "cb", F.col("x_atom").alias("x"), F.col("y_atom").alias("y"), F.col("distance").alias("d"), "back", F.col("x_first").alias("a"), F.col("y_first").alias("b"), F.col("y_last").alias("last")))
    atoms = cut(units.groupBy("atom").agg(F.count("*").alias("k"), (F.sum("n") == 1).alias("lone")))
    sized = lambda c: atoms.select(F.col("atom").alias(c), F.col("k").alias("k" + c))
    full = pairs.groupBy("x", "y").agg(F.count("*").alias("n")).join(sized("x"), "x").join(sized("y"), "y").where("n = kx * ky").select("x", "y")
    odd = pairs.where("back is null").select(F.col("x").alias("node"))
    parts = [(pairs, full, atoms, True)]
    if not odd.isEmpty():
        roots = cut(components(pairs.select("x", "y"), "x", "y"))
        bad = cut(roots.join(roots.join(odd, "node", "left_semi").select("root").distinct(), "root").select(F.col("node").alias("atom")))
        split = lambda df, c, how: df.join(bad.withColumnRenamed("atom", c), c, how)
        parts = [tuple(split(df, c, how) for df, c in ((pairs, "x"), (full, "x"), (atoms, "atom"))) + (how == "left_anti",) for how in ("left_anti", "left_semi")]
    found = None
    for some, near_atoms, own, same in parts:
        edges = _first_pairs(some, own, ids, same)
        here = linkage.linked(edges, own.select("atom", "lone"), near_atoms, same, small, leaves)
        found = here if found is None else found.union(here)
    found = cut(found)
    keys = units.join(found, "atom").groupBy("cluster").agg(F.min("first").alias("key"), F.sum("n").alias("n")).where("n > 1").select("cluster", "key")
    return ids.join(found.join(keys, "cluster").select("atom", "key"), "atom").select("key", F.col("id").alias("image_id"))


def _first_pairs(pairs: DataFrame, atoms: DataFrame, ids: DataFrame, same: bool) -> DataFrame:
    """Edges (x, y, d, a, b) between atoms of pairs of their units: the first of two atoms, or what can matter beside it.

    The first pair of two units is that of the least row a that has a later row b in the other one, with the least such b.
    """
    later = "a > b and a < last" + (" and (back is null or d < back)" if same else "")  # else the pair the other way is before it
    plain = pairs.where("a < b").select("x", "y", "d", "a", "b")
    after = ids.select(F.col("c").alias("cb"), F.col("atom").alias("y"), "id")
    next_ = pairs.where(later).drop("b").join(after, ["cb", "y"]).where("id > a").groupBy("ca", "cb", "x", "y", "d", "a").agg(F.min("id").alias("b"))
    every = plain.union(next_.select("x", "y", "d", "a", "b"))
    least = F.min(F.struct("d", "a", "b", "x", "y")).alias("k")
    if same:
        return every.groupBy(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q")).agg(least).select("k.x", "k.y", "k.d", "k.a", "k.b")
    lone = atoms.where("lone").select(F.col("atom").alias("x"))
    mixed = pairs.join(lone, "x", "left_semi").unionByName(pairs.join(lone, "x", "left_anti").join(lone.withColumnRenamed("x", "y"), "y", "left_semi")).select("ca", "cb", "x", "y", "d")
    rows = lambda c, a, i: ids.select(F.col("c").alias(c), F.col("atom").alias(a), F.col("id").alias(i))
    mixed = mixed.join(rows("ca", "x", "a"), ["ca", "x"]).join(rows("cb", "y", "b"), ["cb", "y"]).where("a < b").select("x", "y", "d", "a", "b")
    both = every.join(lone, "x", "left_anti").join(lone.withColumnRenamed("x", "y"), "y", "left_anti").groupBy("x", "y").agg(least)
    return mixed.union(both.select("k.x", "k.y", "k.d", "k.a", "k.b"))


def stored(kind_members: list[tuple[str, str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """groups and members of (kind, similarity, members with keeper), ids given in order."""
    every = None
    for kind, similarity, members in kind_members:
        rows = members.select(F.lit(kind).alias("kind"), F.lit(similarity).alias("similarity"), F.col("key").cast("string").alias("key"), "image_id", "is_keeper")
        every = rows if every is None else every.unionByName(rows)
    every = cut(every)  # read for the heads and for the members
    heads = every.groupBy("kind", "similarity", "key").agg(F.min("image_id").alias("first"), F.xxhash64("kind", "key").alias("spread"))
    rank = F.create_map(*[F.lit(x) for k, r in schema.KIND_RANK.items() for x in (k, r)])
    heads = numbered(heads, [F.element_at(rank, F.col("kind")), F.col("first"), F.col("key")])
    members = every.join(heads, ["kind", "similarity", "key"]).select(F.col("id").alias("group_id"), "image_id", "is_keeper")
    return heads.select("id", "kind", "similarity"), members


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with id 1, 2, ... in the order, without one task for all: ranges are counted, then numbered."""
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_n")))
    part, place = F.shiftrightunsigned("_n", 33), F.col("_n").bitwiseAND((1 << 33) - 1)
    sizes = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row a range
    base, at = {}, 0
    for p in sorted(sizes):
        base[p], at = at, at + sizes[p]
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for p, b in base.items() for x in (p, b)]), part) if base else F.lit(0)
    return ranged.select(*rows.columns, (offset + place + 1).cast("long").alias("id"))


def reconcile(groups: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups without those that lie wholly within a stronger one (exact, burst, variant; then lower id).

    What could hold a group holds its rarest member, so only the groups of that one are looked at, and those only that
    are as large and reach as far. Groups of the same members are told by a sum first, so that many of them meet one.
    """
    rank = F.create_map(*[F.lit(x) for k, r in schema.KIND_RANK.items() for x in (k, r)])
    known = cut(members.join(groups.select(F.col("id").alias("group_id"), "kind"), "group_id").select("group_id", "image_id", F.element_at(rank, F.col("kind")).alias("rank")).distinct())
    often = known.groupBy("image_id").agg(F.count("*").alias("groups"))
    sums = [F.count("*").alias("n"), F.min("image_id").alias("low"), F.max("image_id").alias("high"), F.bit_xor(F.xxhash64("image_id")).alias("mix"), F.sum(F.xxhash64("image_id") % 1_000_003).alias("sum")]
    facts = cut(known.join(often, "image_id").groupBy("group_id", "rank").agg(*sums, F.min_by("image_id", F.struct("groups", "image_id")).alias("rarest")))
    alike = ["n", "low", "high", "mix", "sum"]
    strongest = F.struct("rank", "group_id")
    heads = facts.groupBy(*alike).agg(F.min(strongest).alias("head"))
    same = facts.join(heads, alike).where(strongest != F.col("head")).select(F.col("group_id").alias("w"), F.col("head.group_id").alias("s"), "n")
    covered = cut(_held(same, known))
    left = facts.join(covered.withColumnRenamed("w", "group_id"), "group_id", "left_anti")
    weak = left.select(*[F.col(c).alias("w_" + c) for c in ("group_id", "rank", "n", "low", "high")], F.col("rarest").alias("image_id"))
    strong = left.join(known.select("group_id", "image_id"), "group_id").select("image_id", *[F.col(c).alias("s_" + c) for c in ("group_id", "rank", "n", "low", "high")])
    could = "s_n >= w_n and s_low <= w_low and s_high >= w_high and (s_rank < w_rank or (s_rank = w_rank and s_group_id < w_group_id))"
    met = weak.join(strong, "image_id").where(could).select(F.col("w_group_id").alias("w"), F.col("s_group_id").alias("s"), F.col("w_n").alias("n"))
    covered = cut(covered.union(_held(met, known)).distinct().withColumnRenamed("w", "id"))
    kept = groups.join(covered, "id", "left_anti")
    return kept, members.join(covered.withColumnRenamed("id", "group_id"), "group_id", "left_anti")


def _held(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The w of pairs (w, s, n) of groups of which all n members of w are in s."""
    own = known.select(F.col("group_id").alias("w"), "image_id")
    there = known.select(F.col("group_id").alias("s"), "image_id")
    return pairs.join(own, "w").join(there, ["s", "image_id"]).groupBy("w", "s", "n").agg(F.count("*").alias("common")).where("common = n").select("w").distinct()


@dataclass
class Detection:
    groups: DataFrame
    members: DataFrame
    images: DataFrame
    truncated: bool
    unhashed: int

    def counts(self) -> DataFrame:
        """Groups by kind."""
        return self.groups.groupBy("kind").agg(F.count("*").alias("groups"))

    def note(self) -> str:
        parts = []
        if self.unhashed:
            parts.append(f"{self.unhashed} without a signature were compared by content only")
        if self.truncated:
            parts.append("more pairs than could be grouped; the nearest were")
        return "; ".join(parts)


def detect(images: DataFrame, settings: Settings = Settings(), root: str | None = None, rule: str = "resolution", now: int = 0, cap: int | None = None, words: int = schema.WORDS, bits: int = schema.BITS) -> Detection:
    """Exact, variant and burst groups of the rows under a root, reconciled; rows are stamped as checked.

    All pairs count. With a cap (`PAIR_CAP`, say) the nearest ones of either kind do, and the result says whether there were more.
    """
    rows = cut(detector_rows(images, root))
    kept = lambda members: with_keeper(cut(members), rows, rule)  # noqa: E731 - which reads them twice
    found = [(schema.EXACT, "identical", kept(exact_members(images, root)))]
    truncated = False
    if settings.variant_enabled:
        limit, turned = settings.variant_maxbits, settings.variant_rotations
        if cap is None:
            members = variant_groups(rows, limit, words, bits, turned)
        else:
            pairs, truncated = capped(variant_pairs(rows, limit, words, bits, turned), cap)
            members = cliques(pairs, rows, limit, words, turned)
        found.append((schema.VARIANT, f"<={limit} of {bits} bits", kept(members)))
    pairs, more = capped(burst_pairs(rows, settings.burst_windowsec, settings.burst_maxbits, words), cap)
    members = cliques(pairs, rows, settings.burst_maxbits, words, False)
    found.append((schema.BURST, f"within {settings.burst_windowsec}s", kept(members)))
    groups, members = reconcile(*(cut(x) for x in stored(found)))
    return Detection(cut(groups), cut(members), mark_checked(images, settings.covered, now, root), truncated | more, rows.where("phash is null").count())


def mark_checked(images: DataFrame, kinds: int, now: int, root: str | None = None) -> DataFrame:
    """`images` with the stamp and mask of what was checked, on rows under the root."""
    here = in_scope(F.col("path"), root)
    stamp = lambda name, value: F.when(here, F.lit(value)).otherwise(F.col(name)).cast(images.schema[name].dataType)
    return images.withColumns({"dupe_checked_at": stamp("dupe_checked_at", now), "dupe_checked_kinds": stamp("dupe_checked_kinds", kinds)})
