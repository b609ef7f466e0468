"""Carrying out an export: files are copied, moved or linked by the tasks, and checked by their content.

The files must lie on a file system that all executors mount. Every step can be run again: a task that is lost and
repeated finds the file that it has written, checks it, and goes on. A move is made in this order: copied and
checked, written to the undo log, released at its source, and only then the catalogue has the new path.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph import schema
from heliograph.graph import cut
from heliograph.operators import undo
from heliograph.operators.catalog import publish

_ITEMS = "image_id long, dest_path string, status string, skip_reason string, error string"


def content_hash(path: str) -> str:
    """SHA-256 of a file, read in pieces."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _put(source: str, target: str, mode: str) -> None:
    """The target as a whole or not at all; never over another file."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    if mode == "hardlink":
        os.link(source, target)
        return
    part = f"{target}.{uuid.uuid4().hex}.part"
    try:
        shutil.copy2(source, part)
        os.link(part, target)  # fails where there is a file, unlike a rename
    finally:
        if os.path.exists(part):
            os.remove(part)


def _settle(source: str, target: str, known: str | None, size: int, mode: str) -> str | None:
    """None if the target now holds what it should, else what went wrong."""
    try:
        if not os.path.exists(target):
            if not os.path.exists(source):
                return "source missing"
            _put(source, target, mode)
        if mode == "hardlink":
            return None if os.path.getsize(target) == size else "size differs"
        return None if content_hash(target) == (known or content_hash(source)) else "content differs"
    except OSError as e:
        return f"{type(e).__name__}: {e.strerror}"


def transfer(planned: DataFrame, images: DataFrame, run: int, mode: str = "copy") -> DataFrame:
    """Journal rows of a run: what is planned (image_id, dest_path, status) is put in place and checked.

    An item that fails says why and stops no other. Items that the plan skips or fails are journalled as such.
    """
    rows = planned.join(images.select(F.col("id").alias("image_id"), "path", "content_hash", "file_size"), "image_id")

    def run_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["status"] == "copy":
                    error = _settle(r["path"], r["dest_path"], r["content_hash"], r["file_size"], mode)
                    out.append((r["image_id"], r["dest_path"] if error is None else None, "failed" if error else "verified", None, error))
                else:
                    skipped = r["status"] == "skipped"
                    out.append((r["image_id"], r["dest_path"], r["status"], "identical file exists" if skipped else None, None if skipped else "no free name"))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=[x.split(" ")[0] for x in _ITEMS.split(", ")])

    return rows.mapInArrow(run_items, _ITEMS).select(F.lit(run).cast("long").alias("run_id"), *[x.split(" ")[0] for x in _ITEMS.split(", ")])


def release(moved: DataFrame) -> DataFrame:
    """(image_id, released): sources (path) are deleted whose target (dest_path) is there with the known content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                try:
                    safe = content_hash(r["dest_path"]) == r["content_hash"] and not (os.path.exists(r["path"]) and os.path.samefile(r["path"], r["dest_path"]))
                    if safe and os.path.exists(r["path"]):
                        os.remove(r["path"])
                except OSError:
                    safe = False
                done.append(safe)
            yield pa.RecordBatch.from_arrays([batch["image_id"], pa.array(done, pa.bool_())], names=["image_id", "released"])

    return moved.mapInArrow(run, "image_id long, released boolean")


def export_run(planned: DataFrame, images: DataFrame, log: DataFrame, run: int, folder: str, mode: str = "copy", now: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(journal, undo log, catalogue) after a run. The journal and, for a move, the log are written under `folder`
    before any source is released, and the catalogue has the new paths of what was released."""
    spark = images.sparkSession
    journal = spark.read.parquet(publish(transfer(planned, images, run, mode), f"{folder}/journal"))
    if mode != "move":
        return journal, log, images
    moved = journal.where("status = 'verified'").select("image_id", "dest_path").join(images.select(F.col("id").alias("image_id"), "path", F.coalesce("content_hash", F.lit("")).alias("content_hash")), "image_id")
    moves = moved.select(F.col("image_id").alias("id"), F.col("dest_path").alias("new_path"))
    log, _ = undo.move(log, images, moves, f"move-{run}", now)
    log = spark.read.schema(schema.UNDO_LOG).parquet(publish(log, f"{folder}/undo"))
    released = cut(release(moved)).where("released")
    _, repathed = undo.move(log, images, moves.join(released.select(F.col("image_id").alias("id")), "id", "left_semi"), f"move-{run}", now)
    return journal, log, repathed
