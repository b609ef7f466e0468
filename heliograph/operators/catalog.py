"""Changes of a catalogue. Tables are immutable: each operator gives the table as it is afterwards."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph import schema
from heliograph.functions.paths import in_scope
from heliograph.graph import children, remove

#: Columns that a new analysis replaces, and those it resets.
ANALYSED = ("content_hash", "file_size", "mtime", "width", "height", "format", "nsfw_score", "blur_score", "exif_taken", "exif_camera", "thumb_path", "analyzed_at", "phash")
RESET = ("dupe_checked_at", "nsfw_tile_mean")


def upsert(catalogue: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of `new` (by path) replace or join the catalogue's; ids of known paths stay.

    New ids follow the highest one in order of path. A path that is twice in `new` counts once, by its latest
    mtime. Checked stamps are reset.
    """
    from heliograph.operators.groups import numbered

    own = [c for c in ANALYSED if c in new.columns]
    new = new.groupBy("path").agg(F.max_by(F.struct(*own), F.struct(F.col("mtime"), F.xxhash64(*own))).alias("n")).select("path", "n.*")
    ids = catalogue.select("path", "id")
    top = catalogue.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    changed = new.join(ids, "path")
    added = numbered(new.join(ids, "path", "left_anti"), [F.col("path")]).withColumn("id", F.col("id") + top)
    fresh = changed.unionByName(added)
    filled = fresh.select(*[F.lit(0).cast("int").alias(f.name) if f.name == "dupe_checked_kinds" else F.lit(None).cast(f.dataType).alias(f.name) if f.name in RESET or f.name not in fresh.columns else F.col(f.name).cast(f.dataType) for f in catalogue.schema])
    return catalogue.join(new.select("path"), "path", "left_anti").select(catalogue.columns).unionByName(filled)


def prune(catalogue: DataFrame, live: DataFrame, root: str | None = None, outside: DataFrame | None = None) -> DataFrame:
    """Without rows under the root whose path is not live, and without rows beyond it that `outside` (paths found
    missing) names."""
    here = in_scope(F.col("path"), root)
    kept = catalogue.where(here).join(live.select("path").distinct(), "path", "left_semi")
    rest = catalogue.where(~here)
    if outside is not None:
        rest = rest.join(outside.select("path").distinct(), "path", "left_anti")
    return kept.select(catalogue.columns).unionByName(rest.select(catalogue.columns))


def updated(catalogue: DataFrame, changes: DataFrame) -> DataFrame:
    """Single columns of rows by id: what `changes` (id and columns) has and is not null replaces."""
    names = [c for c in changes.columns if c != "id"]
    joined = catalogue.join(changes.select("id", *[F.col(c).alias("new_" + c) for c in names]), "id", "left")
    return joined.select(*[F.coalesce("new_" + c, c).cast(catalogue.schema[c].dataType).alias(c) if c in names else F.col(c) for c in catalogue.columns])


def deleted(catalogue: DataFrame, ids: DataFrame) -> DataFrame:
    return catalogue.join(ids.select("id"), "id", "left_anti")


def forget(catalogue: DataFrame) -> DataFrame:
    """An empty catalogue; the undo log is another table and stays."""
    return catalogue.limit(0)


def clear_kind(groups: DataFrame, members: DataFrame, images: DataFrame, kind: str, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Without the kind's groups that lie wholly under the root; groups that straddle it stay."""
    own = groups.where(F.col("kind") == kind).select("id")
    if root is not None:
        paths = images.select(F.col("id").alias("image_id"), in_scope(F.col("path"), root).alias("here"))
        inside = members.join(paths, "image_id").groupBy(F.col("group_id").alias("id")).agg(F.bool_and("here").alias("all")).where("all").select("id")
        own = own.join(inside, "id", "left_semi")
    return groups.join(own, "id", "left_anti"), members.join(own.withColumnRenamed("id", "group_id"), "group_id", "left_anti")


def add_groups(groups: DataFrame, members: DataFrame, new_groups: DataFrame, new_members: DataFrame) -> tuple[DataFrame, DataFrame]:
    return groups.unionByName(new_groups), members.unionByName(new_members)


def delete_group(groups: DataFrame, members: DataFrame, group: int) -> tuple[DataFrame, DataFrame]:
    return groups.where(F.col("id") != group), members.where(F.col("group_id") != group)


def known_groups(groups: DataFrame, kind: str | None = None) -> DataFrame:
    """Groups of a kind, or of all kinds; those of unknown kinds are left out."""
    return groups.where(F.col("kind").isin(*([kind] if kind else schema.KIND_BITS)))


def toggle_keepers(members: DataFrame, toggles: DataFrame) -> DataFrame:
    """Flip is_keeper of the members in `toggles` (group_id, image_id), one for a group.

    A group's last keeper is not cleared, and what is no member changes nothing.
    """
    keepers = members.groupBy("group_id").agg(F.count_if("is_keeper").alias("keepers"))
    flip = toggles.select("group_id", "image_id").distinct().withColumn("flip", F.lit(True))
    joined = members.join(flip, ["group_id", "image_id"], "left").join(keepers, "group_id")
    last = F.col("is_keeper") & (F.col("keepers") <= 1)
    new = F.when(F.coalesce("flip", F.lit(False)) & ~last, ~F.col("is_keeper")).otherwise(F.col("is_keeper"))
    return joined.select("group_id", "image_id", new.alias("is_keeper"))


def set_meta(meta: DataFrame, changes: dict[str, str | None]) -> DataFrame:
    """Settings with the changes; None takes a key out."""
    rest = meta.where(~F.col("key").isin(*changes)) if changes else meta
    new = [(k, v) for k, v in changes.items() if v is not None]
    return rest.unionByName(meta.sparkSession.createDataFrame(new, schema.META)) if new else rest


def invalidate(catalogue: DataFrame, stored: str | None, recipe: str) -> tuple[DataFrame, bool]:
    """If signatures were made by another recipe, drop them and what was checked by them, once."""
    if stored == recipe:
        return catalogue, False
    owed = catalogue.where("phash is not null").limit(1).count() > 0
    gone = {"phash": F.lit(None).cast(catalogue.schema["phash"].dataType), "dupe_checked_at": F.lit(None).cast("long"), "dupe_checked_kinds": F.lit(0).cast("int")}
    return catalogue.withColumns(gone), owed


@dataclass(frozen=True)
class Migration:
    """What a change of recipe did: rows it touched, and where the catalogue from before it is."""

    rows: int
    backup: str | None

    def take_notice(self, taken: set[Migration]) -> str | None:
        """The notice of a change that touched rows; once only for one set of those taken."""
        if not self.rows or self in taken:
            return None
        taken.add(self)
        where = f"; the catalogue from before is in {self.backup}" if self.backup else ""
        return f"Signatures of {self.rows:,} rows are made again by a new recipe{where}"


def migrate_recipe(catalogue: DataFrame, stored: str | None, recipe: str, folder: str) -> tuple[DataFrame, Migration | None]:
    """`invalidate` with a backup: the catalogue as it is is written under `folder` before signatures are dropped, and only then
    older backups go, so there is one at any time. None where the recipe is the same."""
    if stored == recipe:
        return catalogue, None
    spark, rows = catalogue.sparkSession, catalogue.count()
    backup = publish(catalogue, f"{folder}/backup") if rows else None
    if backup:
        for old in children(spark, f"{folder}/backup"):
            if not old.endswith(backup.rsplit("/", 1)[-1]):
                remove(spark, old)
        catalogue = spark.read.schema(catalogue.schema).parquet(backup)
    return invalidate(catalogue, stored, recipe)[0], Migration(rows, backup)


def migrate_kinds(groups: DataFrame) -> DataFrame:
    """Kinds by their present names."""
    return groups.withColumn("kind", F.when(F.col("kind") == "similar", F.lit(schema.VARIANT)).otherwise(F.col("kind")))


def publish(table: DataFrame, folder: str) -> str:
    """Write a new version of a table beside its old ones and give its path; what is read is never overwritten."""
    path = f"{folder}/v-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return path
