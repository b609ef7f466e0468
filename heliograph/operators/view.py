"""The browsing view: rows with their group, filters, sorts, search, counts and selection."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph import schema
from heliograph.functions.labels import year
from heliograph.functions.paths import file_name, folder_of
from heliograph.functions.scores import PRESETS, Rule, is_soft

BALANCED = PRESETS["balanced"]
SEARCH_ROWS = 8


def live_members(images: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Members that are present, of groups with two or more of them: group_id, kind, image_id, is_keeper.

    Where no present member is a keeper, the one with the lowest id is.
    """
    present = members.join(images.select(F.col("id").alias("image_id")), "image_id", "left_semi").select("group_id", "image_id", "is_keeper")
    facts = present.groupBy("group_id").agg(F.count("*").alias("n"), F.max("is_keeper").alias("any"), F.min("image_id").alias("first")).where("n >= 2")
    kinds = groups.where(F.col("kind").isin(*schema.KIND_BITS)).select(F.col("id").alias("group_id"), "kind")
    keeper = F.when(F.col("any"), F.col("is_keeper")).otherwise(F.col("image_id") == F.col("first"))
    return present.join(facts.join(kinds, "group_id"), "group_id").select("group_id", "image_id", keeper.alias("is_keeper"), "kind")


def view(images: DataFrame, groups: DataFrame, members: DataFrame, rule: Rule = BALANCED) -> DataFrame:
    """`images` with folder, file_name, year, band, display_score and the group: dupe_group, dupe_kind, is_keeper
    (null where there is none). Of a row in several groups the one with the highest id counts."""
    of = live_members(images, groups, members).groupBy(F.col("image_id").alias("id")).agg(F.max(F.struct("group_id", "kind", "is_keeper")).alias("g"))
    whole, tile = F.col("nsfw_score"), F.col("nsfw_tile_mean")
    return images.join(of, "id", "left").select(
        *images.columns, folder_of(F.col("path")).alias("folder"), file_name(F.col("path")).alias("file_name"), year(F.col("exif_taken")).alias("year"),
        rule.band(whole, tile).alias("band"), rule.display_score(whole, tile).alias("display_score"),
        F.col("g.group_id").alias("dupe_group"), F.col("g.kind").alias("dupe_kind"), F.col("g.is_keeper").alias("is_keeper"),
    )


def is_extra() -> Column:
    """A copy that a bulk action takes: no keeper, and not of a burst."""
    return F.coalesce(~F.col("is_keeper") & F.col("dupe_kind").isin(*schema.BULK_KINDS), F.lit(False))


def is_kept() -> Column:
    return F.coalesce(F.col("is_keeper"), F.lit(False))


_BAND_SETS = {"likely": ("likely",), "unsure": ("unsure",), "review": ("likely", "unsure"), "clean": ("clean",), "unchecked": ("unchecked",)}


@dataclass(frozen=True)
class Filters:
    """Facets, all of which a row must meet. nsfw: any, likely, unsure, review, clean, unchecked; dupes: any,
    extras, keepers, bursts; blur_max counts above 0."""

    nsfw: str = "any"
    blur_max: float = 0.0
    dupes: str = "any"
    folder: str = ""
    subfolders: bool = True
    year: str = ""

    def matches(self) -> Column:
        ok = F.lit(True)
        if self.nsfw != "any":
            ok &= F.col("band").isin(*_BAND_SETS[self.nsfw])
        if self.blur_max > 0:
            ok &= F.coalesce(F.col("blur_score") <= self.blur_max, F.lit(False))
        if self.dupes == "extras":
            ok &= is_extra()
        elif self.dupes == "keepers":
            ok &= is_kept()
        elif self.dupes == "bursts":
            ok &= F.coalesce(F.col("dupe_kind") == schema.BURST, F.lit(False))
        if self.folder:
            own = F.col("folder") == self.folder
            ok &= own | F.startswith(F.col("folder"), F.lit(self.folder + "/")) if self.subfolders else own
        if self.year:
            ok &= F.coalesce(F.col("year").cast("string") == self.year, F.lit(False))
        return ok


def reset_vanished(filters: Filters, rows: DataFrame) -> Filters:
    """Filters without a folder or year that no row has any more."""
    gone = {}
    if filters.folder and rows.where(Filters(folder=filters.folder).matches()).isEmpty():
        gone["folder"] = ""
    if filters.year and rows.where(Filters(year=filters.year).matches()).isEmpty():
        gone["year"] = ""
    return replace(filters, **gone)


#: The keys of sorts; names sort in upper case.
SORTS = {
    "scanned": "id", "name": "file_name", "size": "file_size", "captured": "exif_taken", "blur": "blur_score", "nsfw": "display_score",
}


def ordered(rows: DataFrame, key: str = "scanned", descending: bool = False) -> list[Column]:
    """Sort columns of a key: nulls last either way, ties by ascending id."""
    c = F.upper("file_name") if key == "name" else F.col(SORTS[key])
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col("id").asc()]


def ranked(rows: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """(image_id, place): each row's place in a sort, from 1, numbered by ranges."""
    from heliograph.operators.groups import numbered

    rows = rows.withColumn("image_id", F.col("id")).drop("id")
    c = F.upper("file_name") if key == "name" else F.col("image_id" if key == "scanned" else SORTS[key])
    order = [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col("image_id").asc()]
    return numbered(rows, order).select("image_id", F.col("id").alias("place"))


def page(rows: DataFrame, key: str, descending: bool, first: int, count: int) -> DataFrame:
    """The rows of a window of a sort."""
    return rows.orderBy(*ordered(rows, key, descending)).offset(first).limit(count)


def search(rows: DataFrame, query: str) -> DataFrame:
    """The first 8 rows by name whose name or folder has the query, case ignored; none for an empty one."""
    query = query.strip().upper()
    if not query:
        return rows.limit(0)
    hit = F.upper("file_name").contains(query) | F.upper("folder").contains(query)
    return rows.where(hit).orderBy(F.upper("file_name"), "id").limit(SEARCH_ROWS)


def scopes() -> dict[str, Column]:
    return {
        "all_shown": F.lit(True),
        "likely_explicit": F.col("band") == "likely",
        "not_sure": F.col("band") == "unsure",
        "duplicate_extras": is_extra(),
        "duplicate_keepers": is_kept(),
    }


def tally(rows: DataFrame) -> DataFrame:
    """scope, n and bytes for the five scopes, which overlap, in one pass."""
    aggs = []
    for name, c in scopes().items():
        aggs += [F.count_if(c).alias(f"n_{name}"), F.coalesce(F.sum(F.when(c, F.col("file_size"))), F.lit(0)).cast("long").alias(f"b_{name}")]
    one = rows.agg(*aggs)
    each = F.array(*[F.struct(F.lit(s).alias("scope"), F.col(f"n_{s}").alias("n"), F.col(f"b_{s}").alias("bytes")) for s in scopes()])
    return one.select(F.inline(each))


def band_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("band").agg(F.count("*").alias("n"))


def summary(rows: DataFrame, slider: float = 0.0) -> DataFrame:
    """One row: photos, extras, reclaimable bytes, keepers, burst frames, unchecked, soft, and whether there are
    extras only bursts have."""
    return rows.agg(
        F.count("*").alias("photos"), F.count_if(is_extra()).alias("extras"), F.coalesce(F.sum(F.when(is_extra(), F.col("file_size"))), F.lit(0)).cast("long").alias("reclaimable"),
        F.count_if(is_kept()).alias("keepers"), F.count_if(F.coalesce(F.col("dupe_kind") == schema.BURST, F.lit(False))).alias("bursts"),
        F.count_if(F.col("band") == "unchecked").alias("unchecked"), F.count_if(is_soft(F.col("blur_score"), slider)).alias("soft"),
        F.coalesce(F.bool_or(F.coalesce(~F.col("is_keeper") & ~F.col("dupe_kind").isin(*schema.BULK_KINDS), F.lit(False))), F.lit(False)).alias("burst_only_extras"),
    )


def plan_steps(rows: DataFrame, groups: int, exported: bool = False) -> list[tuple[str, str]]:
    """(step, state) of the five steps of a session, from one row of counts."""
    s = summary(rows).first()
    if not s.photos:
        return [(x, "waiting") for x in ("scan", "duplicates", "content", "sharpness", "export")]
    return [("scan", "done"), ("duplicates", f"done: {groups} groups, {s.extras} extras"), ("content", "available" if s.unchecked else "done"), ("sharpness", f"done: {s.soft} soft"), ("export", "done" if exported else "available")]


def folders(rows: DataFrame) -> DataFrame:
    return rows.select("folder").distinct().orderBy("folder")


def years(rows: DataFrame) -> DataFrame:
    return rows.where("year is not null").select("year").distinct().orderBy(F.desc("year"))


def differences(rows: DataFrame, columns: tuple[str, ...] = ("width", "height", "file_size", "blur_score")) -> DataFrame:
    """For each group and column whether its members differ; for each member whether it is strictly best.

    Aggregated by group and joined back, so a group of any size is summed before it is shuffled.
    """
    out = rows.where("dupe_group is not null")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    of = []
    for c in columns:  # the top is one member's alone if the lowest and the highest id at the top are the same
        of += [(F.min(text(c)) != F.max(text(c))).alias(f"{c}_differs"), F.max(F.struct(c, "id")).alias(f"{c}_last"), F.max(F.struct(F.col(c), (-F.col("id")).alias("back"))).alias(f"{c}_first")]
    facts = out.groupBy("dupe_group").agg(*of)
    best = lambda c: F.coalesce((F.col("id") == F.col(f"{c}_last.id")) & (F.col("id") == -F.col(f"{c}_first.back")) & F.col(c).isNotNull() & (F.col(c) != 0), F.lit(False))
    marks = [x for c in columns for x in (F.col(f"{c}_differs"), best(c).alias(f"{c}_best"))]
    return out.join(facts, "dupe_group").select("dupe_group", F.col("id").alias("image_id"), *marks)


def group_members(rows: DataFrame, group_id: int) -> DataFrame:
    """The members of one group in the order of their paths, byte by byte."""
    return rows.where(F.col("dupe_group") == group_id).select("id", "path", "is_keeper").orderBy("path")


def members_by_path(rows: DataFrame) -> DataFrame:
    """dupe_group and the ids of its members in the order of their paths, for all groups."""
    of = rows.where("dupe_group is not null").groupBy("dupe_group").agg(F.sort_array(F.collect_list(F.struct("path", "id"))).alias("m"))
    return of.select("dupe_group", F.col("m.id").alias("ids"))


def select_by(rows: DataFrame, scope: str) -> DataFrame:
    """The selection that a bulk command makes: the scope's rows among those shown, nothing else."""
    return rows.where(scopes()[scope]).select("id")


def invert(selected: DataFrame, shown: DataFrame) -> DataFrame:
    """The symmetric difference of the selection and what is shown."""
    a, b = selected.select("id").distinct(), shown.select("id").distinct()
    return a.join(b, "id", "left_anti").unionByName(b.join(a, "id", "left_anti"))


def select_range(selected: DataFrame, shown: DataFrame, key: str, descending: bool, first: int, last: int) -> DataFrame:
    """The selection with all rows shown between two ids, ends included, in the order of a sort."""
    places = ranked(shown, key, descending)
    ends = places.where(F.col("image_id").isin(first, last)).agg(F.min("place"), F.max("place")).first()
    between = places.where(F.col("place").between(ends[0] or 0, ends[1] or -1)).select(F.col("image_id").alias("id"))
    return selected.select("id").unionByName(between).distinct()


def toggle(selected: DataFrame, ids: DataFrame) -> DataFrame:
    return invert(selected, ids)


def still_there(selected: DataFrame, images: DataFrame) -> DataFrame:
    return selected.join(images.select("id"), "id", "left_semi")


def rejects(images: DataFrame, selected: DataFrame) -> DataFrame:
    return images.join(selected.select("id"), "id", "left_anti")


def score_targets(images: DataFrame, selected: DataFrame | None, folder: str, root: str | None) -> DataFrame:
    """What to classify: the selection, else the folder in focus, else everything under the scanned root."""
    from heliograph.functions.paths import in_scope

    if selected is not None:
        return images.join(selected.select("id"), "id", "left_semi")
    return images.where(in_scope(F.col("path"), folder or root))
