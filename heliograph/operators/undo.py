"""The undo log: what was recycled or moved, by batch, and how it is put back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.operators.groups import numbered

ITEMS = 8


def recycle(log: DataFrame, images: DataFrame, ids: DataFrame, batch: str, now: int) -> tuple[DataFrame, DataFrame]:
    """The log with a row for each image that goes, and the catalogue without them."""
    gone = images.join(ids.select("id"), "id", "left_semi")
    rows = logged(gone.select(F.col("path").alias("original_path"), F.lit(None).cast("string").alias("new_location"), "content_hash"), log, batch, "recycle", now)
    return log.unionByName(rows), images.join(ids.select("id"), "id", "left_anti")


def move(log: DataFrame, images: DataFrame, moves: DataFrame, batch: str, now: int) -> tuple[DataFrame, DataFrame]:
    """The log with a row for each move (id, new_path), and the catalogue with the new paths."""
    moved = images.join(moves, "id")
    rows = logged(moved.select(F.col("path").alias("original_path"), F.col("new_path").alias("new_location"), "content_hash"), log, batch, "move", now)
    changed = images.join(moves, "id", "left").select(*[F.coalesce("new_path", "path").alias("path") if c == "path" else F.col(c) for c in images.columns])
    return log.unionByName(rows), changed


def logged(rows: DataFrame, log: DataFrame, batch: str, op: str, now: int) -> DataFrame:
    top = log.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = numbered(rows, [F.col("original_path")]).withColumn("id", F.col("id") + top)
    return new.select("id", F.lit(batch).alias("batch_id"), F.lit(op).alias("op"), "original_path", "new_location", F.lit(now).cast("long").alias("ts_utc"), F.lit(0).alias("restored"), "content_hash")


def batches(log: DataFrame) -> DataFrame:
    """batch_id, ts_utc, total, restored; newest first."""
    counts = [F.min("ts_utc").alias("ts_utc"), F.count("*").alias("total"), F.sum("restored").alias("restored")]
    return log.groupBy("batch_id").agg(*counts).orderBy(F.desc("ts_utc"), "batch_id")


def items(log: DataFrame, batch: str, limit: int = ITEMS) -> DataFrame:
    return log.where(F.col("batch_id") == batch).orderBy("id").limit(limit).select("id", "original_path", "content_hash", (F.col("restored") != 0).alias("restored"))


def first_items(log: DataFrame, limit: int = ITEMS) -> DataFrame:
    """The first rows of every batch."""
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("id"))
    return log.withColumn("place", place).where(F.col("place") <= limit)


def restore(log: DataFrame, images: DataFrame, batch: str | None = None, item: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The log with a batch or an item marked as restored, and the catalogue with moved rows at their old paths."""
    chosen = (F.col("batch_id") == batch) if item is None else (F.col("id") == item)
    todo = log.where(chosen & (F.col("restored") == 0))
    back = todo.where(F.col("op") == "move").select(F.col("new_location").alias("path"), F.col("original_path").alias("old"))
    moved = images.join(back, "path", "left").select(*[F.coalesce("old", "path").alias("path") if c == "path" else F.col(c) for c in images.columns])
    marked = log.withColumn("restored", F.when(chosen, F.lit(1)).otherwise(F.col("restored")).cast("int"))
    return marked, moved
