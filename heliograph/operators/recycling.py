"""Files that are recycled go into a quarantine folder, and what was recycled or moved is put back from the undo log.

The files must lie on a file system that all executors mount. Every step can be run again, as a whole or in one task: where
a copy goes follows from the batch, the id and the path alone, a file that is there already is checked and not written, no
other file is ever overwritten, and nothing is deleted before its copy is checked and the log that says where it is has
been written.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph import schema
from heliograph.graph import cut, tasks
from heliograph.operators import undo
from heliograph.operators.catalog import publish
from heliograph.operators.transfer import _put, content_hash

RECYCLED, MISSING, FAILED, RESTORED = "recycled", "missing", "failed", "restored"


def place(quarantine: str, batch: str, image_id: int, path: str) -> str:
    """Where a recycled file lies: by batch and a hash of the path, so that no folder holds them all."""
    shard = hashlib.sha256(path.encode("utf-8", "surrogatepass")).hexdigest()[:2]
    return f"{quarantine}/{batch}/{shard}/{image_id}-{os.path.basename(path)}"


def _each(rows: DataFrame, step: Callable[[dict], tuple], fields: dict[str, pa.DataType]) -> DataFrame:
    """`fields` of every row by `step`, and its key; a file system's refusal is a row of its own.

    Rows are narrow and each is work on a file, so they are dealt to as many tasks as the session asks for, not by their bytes.
    """
    ddl = {pa.string(): "string", pa.bool_(): "boolean"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [step(r) for r in batch.to_pylist()]
            columns = [pa.array([d[k] for d in done], kind) for k, kind in enumerate(fields.values())]
            yield pa.RecordBatch.from_arrays([batch["key"], *columns], names=["key", *fields])

    return rows.repartition(tasks(rows.sparkSession), "key").mapInArrow(run, "key long, " + ", ".join(f"{name} {ddl[kind]}" for name, kind in fields.items()))


def _content(r: dict) -> tuple:
    try:
        return (content_hash(r["path"]),)
    except FileNotFoundError:
        return (None,)


def contents(rows: DataFrame) -> DataFrame:
    """(key, content_hash) of the files of rows (key, path), null where there is none. Each is opened by its path in a task: a
    listing of their folders would be held by the driver."""
    return _each(rows, _content, {"content_hash": pa.string()})


def _discard(r: dict) -> tuple:
    try:
        os.remove(r["path"])
    except FileNotFoundError:
        pass
    return (True,)


def discard(rows: DataFrame) -> None:
    """Delete the files of rows (key, path) for good, by tasks. One that is gone is no error."""
    cut(_each(rows, _discard, {"gone": pa.bool_()}))


def _same(a: str, known: str) -> bool:
    return content_hash(a) == known


def _bring(source: str, target: str) -> None:
    """A copy at the target; what another run of the same task has put there is left for the check that follows."""
    try:
        _put(source, target, "copy")
    except FileExistsError:
        pass


def _store(quarantine: str, batch: str) -> Callable[[dict], tuple]:
    def step(r: dict) -> tuple:
        target = place(quarantine, batch, r["key"], r["path"])
        try:
            if os.path.exists(r["path"]):
                known = content_hash(r["path"])
                if not os.path.exists(target):
                    _bring(r["path"], target)
                if not _same(target, known):
                    return None, None, FAILED, "content differs"
                return target, known, RECYCLED, None
            # The file is gone: by an earlier run of this batch, or it was gone before.
            return (target, content_hash(target), RECYCLED, None) if os.path.exists(target) else (None, None, MISSING, None)
        except OSError as e:
            return None, None, FAILED, f"{type(e).__name__}: {e.strerror}"

    return step


def _release(r: dict) -> tuple:
    """Whether the file `path` is gone, its copy `kept` being what it should be."""
    try:
        if os.path.exists(r["path"]):
            if not os.path.exists(r["kept"]) or os.path.samefile(r["path"], r["kept"]) or not (_same(r["kept"], r["content_hash"]) and _same(r["path"], r["content_hash"])):
                return (False,)
            os.remove(r["path"])
        return (True,)
    except OSError:
        return (False,)


def recycle_run(images: DataFrame, ids: DataFrame, log: DataFrame, batch: str, quarantine: str, folder: str, now: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(journal, undo log, catalogue) after the images with these ids are recycled as one batch.

    The journal has image_id, new_location, content_hash, status and error: recycled; missing, whose file was gone (its
    row goes, and there is nothing to log); failed, whose file and row stay. The log is written under `folder` before a
    file goes. ids that repeat or are unknown count for nothing. Run again with the log and catalogue from before, a run that
    was killed goes on and gives the same result.
    """
    spark = images.sparkSession
    wanted = images.join(ids.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("key"), "path")
    text = pa.string()
    stored = _each(wanted, _store(quarantine, batch), {"new_location": text, "content_hash": text, "status": text, "error": text})
    journal = spark.read.parquet(publish(stored.withColumnRenamed("key", "image_id"), f"{folder}/journal"))
    gone = images.select("id", "path").join(journal.where(F.col("status") == RECYCLED).withColumnRenamed("image_id", "id"), "id")
    rows = undo.logged(gone.select(F.col("path").alias("original_path"), "new_location", "content_hash"), log, batch, "recycle", now)
    log = spark.read.schema(schema.UNDO_LOG).parquet(publish(log.unionByName(rows), f"{folder}/undo"))
    out = cut(_each(gone.select(F.col("id").alias("key"), "path", F.col("new_location").alias("kept"), "content_hash"), _release, {"released": pa.bool_()}))
    leaving = out.where("released").select(F.col("key").alias("id")).union(journal.where(F.col("status") == MISSING).select("image_id"))
    return journal, log, images.join(leaving, "id", "left_anti")


def _put_back(r: dict) -> tuple:
    original, kept = r["original_path"], r["new_location"]
    try:
        if r["op"] == "move":  # what is at the old path counts as back; the exported copy stays where it is
            if not kept or not os.path.exists(kept):
                return MISSING, None
            if not os.path.exists(original):
                _bring(kept, original)
                if not _same(original, content_hash(kept)):
                    return FAILED, "content differs"
            return RESTORED, None
        if os.path.exists(original):
            back = r["content_hash"] is not None and _same(original, r["content_hash"])
            return (RESTORED, None) if back else (FAILED, "another file is there")
        if not kept or not os.path.exists(kept):
            return MISSING, None
        if r["content_hash"] is not None and not _same(kept, r["content_hash"]):
            return FAILED, "content differs"
        _bring(kept, original)
        return (RESTORED, None) if _same(original, content_hash(kept)) else (FAILED, "content differs")
    except OSError as e:
        return FAILED, f"{type(e).__name__}: {e.strerror}"


def restore_run(log: DataFrame, images: DataFrame, folder: str, batch: str | None = None, item: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(journal, undo log, catalogue) after a batch, or one item of the log, is put back.

    The journal has id (of the log), status (restored, missing, failed) and error, of rows not restored before; rows that
    are not put back stay open in the log. A moved file is copied back and its row repathed, unless the catalogue has a row
    at the old path by now; a recycled file comes back without a row, which the next scan gives it, and leaves the
    quarantine once the log says that it is restored. A batch or item that isn't there gives an empty journal.
    """
    spark = log.sparkSession
    chosen = (F.col("batch_id") == batch) if item is None else (F.col("id") == item)
    todo = log.where(chosen & (F.col("restored") == 0)).select(F.col("id").alias("key"), "op", "original_path", "new_location", "content_hash")
    done = _each(todo, _put_back, {"status": pa.string(), "error": pa.string()}).withColumnRenamed("key", "id")
    journal = spark.read.parquet(publish(done, f"{folder}/journal"))
    back = journal.where(F.col("status") == RESTORED).select("id", F.lit(1).alias("back"))
    marked = log.join(back, "id", "left").select(*[F.greatest("restored", F.coalesce("back", F.lit(0))).cast("int").alias(c) if c == "restored" else F.col(c) for c in log.columns])
    marked = spark.read.schema(schema.UNDO_LOG).parquet(publish(marked.select(*schema.UNDO_LOG.names), f"{folder}/undo"))
    # Also of rows restored by an earlier run of this that was killed before it came here.
    kept = marked.where(chosen & (F.col("restored") == 1) & (F.col("op") == "recycle") & F.col("new_location").isNotNull() & F.col("content_hash").isNotNull())
    cut(_each(kept.select(F.col("id").alias("key"), F.col("new_location").alias("path"), F.col("original_path").alias("kept"), "content_hash"), _release, {"released": pa.bool_()}))
    moves = marked.where(chosen & (F.col("restored") == 1) & (F.col("op") == "move")).join(back, "id", "left_semi")
    moves = moves.groupBy(F.col("new_location").alias("path")).agg(F.min("original_path").alias("old"))
    moves = moves.join(images.select(F.col("path").alias("old")), "old", "left_anti")
    return journal, marked, images.join(moves, "path", "left").select(*[F.coalesce("old", "path").alias("path") if c == "path" else F.col(c) for c in images.columns])
