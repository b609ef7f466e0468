"""Files that go into quarantine and come back; runs that were killed at any step."""

import hashlib
import os
import shutil

import pytest
from pyspark.sql import functions as F

from heliograph import schema
from heliograph.operators import recycling, transfer, undo

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture
def shop(spark, tmp_path):
    """Eight files and their catalogue; file 5 is gone."""
    source = tmp_path / "in"
    source.mkdir()
    for k in range(8):
        (source / f"f{k}.txt").write_text(f"content {k}")
    (source / "f5.txt").unlink()
    rows = [tuple({"id": k, "path": str(source / f"f{k}.txt"), "content_hash": sha(f"content {k}")}.get(c) for c in schema.IMAGES.names) for k in range(8)]
    return tmp_path, source, spark.createDataFrame(rows, schema.IMAGES), spark.createDataFrame([], schema.UNDO_LOG)


def ids(spark, *which):
    return spark.createDataFrame([(k,) for k in which], "id long")


def recycle(spark, shop, *which):
    root, _, rows, log = shop
    return recycling.recycle_run(rows, ids(spark, *which), log, "b1", str(root / "bin"), str(root / "store"), 9)


def test_files_go_and_come_back(spark, shop):
    root, source, _, _ = shop
    journal, log, after = recycle(spark, shop, 1, 2, 2, 5, 99)
    assert {r.image_id: r.status for r in journal.collect()} == {1: "recycled", 2: "recycled", 5: "missing"}
    assert sorted(r.id for r in after.collect()) == [0, 3, 4, 6, 7]
    assert not (source / "f1.txt").exists() and (source / "f3.txt").exists()
    kept = {r.original_path: r for r in log.collect()}
    assert set(kept) == {str(source / "f1.txt"), str(source / "f2.txt")}
    assert all(r.content_hash == transfer.content_hash(r.new_location) and r.restored == 0 for r in kept.values())
    one = kept[str(source / "f2.txt")]
    back, log, after = recycling.restore_run(log, after, str(root / "store"), item=one.id)
    assert [(r.id, r.status) for r in back.collect()] == [(one.id, "restored")] and (source / "f2.txt").read_text() == "content 2"
    assert not os.path.exists(one.new_location) and not (source / "f1.txt").exists()
    back, log, after = recycling.restore_run(log, after, str(root / "store"), batch="b1")
    assert back.count() == 1 and (source / "f1.txt").read_text() == "content 1" and sorted(r.id for r in after.collect()) == [0, 3, 4, 6, 7]
    assert [(r.total, r.restored) for r in undo.batches(log).collect()] == [(2, 2)]
    back, log, _ = recycling.restore_run(log, after, str(root / "store"), batch="b1")
    assert back.count() == 0 and recycling.restore_run(log, after, str(root / "store"), item=77)[0].count() == 0


@pytest.mark.parametrize("copied, released", [((1,), ()), ((1, 2), ()), ((1, 2), (1,)), ((1, 2), (1, 2))])
def test_a_killed_recycling_goes_on(spark, shop, copied, released):
    root, source, _, _ = shop
    for k in copied:
        transfer._put(str(source / f"f{k}.txt"), recycling.place(str(root / "bin"), "b1", k, str(source / f"f{k}.txt")), "copy")
    for k in released:
        (source / f"f{k}.txt").unlink()
    journal, log, after = recycle(spark, shop, 1, 2, 5)
    assert {r.image_id: (r.status, r.content_hash) for r in journal.collect()} == {1: ("recycled", sha("content 1")), 2: ("recycled", sha("content 2")), 5: ("missing", None)}
    assert log.count() == 2 and after.count() == 5 and not (source / "f1.txt").exists() and not (source / "f2.txt").exists()


def test_nothing_is_lost_where_the_quarantine_holds_something_else(spark, shop):
    root, source, _, _ = shop
    target = recycling.place(str(root / "bin"), "b1", 1, str(source / "f1.txt"))
    os.makedirs(os.path.dirname(target))
    with open(target, "w") as f:
        f.write("other")
    journal, log, after = recycle(spark, shop, 1, 2)
    assert {r.image_id: (r.status, r.error) for r in journal.collect()} == {1: ("failed", "content differs"), 2: ("recycled", None)}
    assert (source / "f1.txt").read_text() == "content 1" and log.count() == 1 and sorted(r.id for r in after.collect()) == [0, 1, 3, 4, 5, 6, 7] and open(target).read() == "other"


@pytest.mark.parametrize("stage", ["before", "copied", "other", "lost", "damaged"])
def test_restoring_is_whole_or_open(spark, shop, stage):
    """What was put back before counts; another file is never overwritten; what is lost or damaged stays open."""
    root, source, _, _ = shop
    _, log, after = recycle(spark, shop, 1, 2)
    row = log.where(F.col("original_path") == str(source / "f1.txt")).first()
    if stage == "copied":
        shutil.copy(row.new_location, row.original_path)
    elif stage == "other":
        (source / "f1.txt").write_text("new")
    elif stage == "lost":
        os.remove(row.new_location)
    elif stage == "damaged":
        with open(row.new_location, "a") as f:
            f.write("x")
    want = {"before": "restored", "copied": "restored", "other": "failed", "lost": "missing", "damaged": "failed"}[stage]
    journal, log, _ = recycling.restore_run(log, after, str(root / "store"), batch="b1")
    assert {r.id: r.status for r in journal.collect()}[row.id] == want
    assert log.where(F.col("restored") == 1).count() == (2 if want == "restored" else 1)
    assert os.path.exists(row.new_location) == (stage in ("other", "damaged"))
    if stage == "other":
        assert (source / "f1.txt").read_text() == "new"
        (source / "f1.txt").unlink()
        journal, log, _ = recycling.restore_run(log, after, str(root / "store"), batch="b1")
        assert [r.status for r in journal.collect()] == ["restored"] and (source / "f1.txt").read_text() == "content 1"


def test_quarantine_left_by_a_killed_restore_is_emptied(spark, shop):
    root, source, _, _ = shop
    _, log, after = recycle(spark, shop, 1)
    row = log.first()
    shutil.copy(row.new_location, row.original_path)
    marked = log.withColumn("restored", F.lit(1))  # the log was written, then the run was killed
    journal, _, _ = recycling.restore_run(marked, after, str(root / "store"), batch="b1")
    assert journal.count() == 0 and not os.path.exists(row.new_location) and (source / "f1.txt").read_text() == "content 1"


def test_moves_come_back_by_copies(spark, shop):
    """The exported copy stays; a row goes back to its old path unless another row has it."""
    root, source, rows, log = shop
    out = root / "out"
    out.mkdir()
    moves = [(k, str(out / f"g{k}.txt")) for k in (0, 3, 4, 6)]
    for k, target in moves:
        shutil.move(source / f"f{k}.txt", target)
    log, rows = undo.move(log, rows, spark.createDataFrame(moves, "id long, new_path string"), "m", 1)
    os.remove(out / "g3.txt")
    (source / "f4.txt").write_text("there already")
    new = [tuple({"id": 60, "path": str(source / "f6.txt")}.get(c) for c in schema.IMAGES.names)]
    rows = rows.unionByName(spark.createDataFrame(new, schema.IMAGES))
    journal, log, after = recycling.restore_run(log, rows, str(root / "store"), batch="m")
    status = {r.original_path[-5]: r.status for r in log.join(journal, "id").collect()}
    assert status == {"0": "restored", "3": "missing", "4": "restored", "6": "restored"}
    paths = {r.id: r.path for r in after.collect()}
    assert [paths[k] for k in (0, 3, 4, 6, 60)] == [str(source / "f0.txt"), str(out / "g3.txt"), str(source / "f4.txt"), str(out / "g6.txt"), str(source / "f6.txt")]
    assert (out / "g0.txt").exists() and (source / "f0.txt").read_text() == "content 0" and (source / "f4.txt").read_text() == "there already"
    assert {r.original_path[-5]: r.restored for r in log.collect()} == {"0": 1, "3": 0, "4": 1, "6": 1}


def test_empty_tables(spark, shop):
    root, _, rows, log = shop
    journal, log, after = recycling.recycle_run(rows.where("false"), ids(spark, 1), log, "b", str(root / "bin"), str(root / "store"))
    assert journal.count() == log.count() == after.count() == 0
    assert recycling.restore_run(log, after, str(root / "store"), batch="b")[1].count() == 0


def test_work_on_files_is_dealt_to_all_tasks(spark, tmp_path):
    """Rows of one partition, which a narrow table of any length can be, are no one task's burden."""
    for k in range(40):
        (tmp_path / f"f{k}").write_text(str(k))
    rows = spark.range(60).coalesce(1).select(F.col("id").alias("key"), F.concat(F.lit(f"{tmp_path}/f"), F.col("id").cast("string")).alias("path"))
    found = recycling.contents(rows)
    assert found.rdd.getNumPartitions() == 4
    assert {r.key: r.content_hash for r in found.collect()} == {k: sha(str(k)) if k < 40 else None for k in range(60)}
    recycling.discard(rows)
    assert not list(tmp_path.iterdir())


def test_no_folder_of_all_files_is_listed_or_removed_by_the_driver(spark, sf, monkeypatch):
    from heliograph.plans import queries
    from heliograph.sources import files

    left, removed = [], queries.remove

    def remove(spark, folder):
        left.extend(x for part in ("in", "bin") for _, _, names in os.walk(f"{folder.removeprefix('file:')}/{part}") for x in names)
        removed(spark, folder)

    def listing(*_):
        raise AssertionError("listed")

    monkeypatch.setattr(queries, "remove", remove)
    monkeypatch.setattr(files, "listing", listing)
    rows = queries.recycle_and_restore(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and not left
    assert {r.status for r in rows} == {None, "recycled", "restored"} and all((r.sha256 is None) == (r.status == "recycled") for r in rows)
