import os
import random

import pytest

from heliograph import schema
from heliograph.functions import labels, paths, scores
from heliograph.functions.signals import decode_pgm, pixel_signals
from heliograph.operators import catalog, codec, export, folders, groups, inference, transfer, undo, view
from heliograph.sources import catalog as reading
from heliograph.sources import files
from heliograph.streaming import scan
from pyspark.sql import functions as F


def images(spark, rows):
    full = [{f.name: r.get(f.name) for f in schema.IMAGES} | {"dupe_checked_kinds": r.get("dupe_checked_kinds", 0)} for r in rows]
    return spark.createDataFrame([tuple(r.values()) for r in full], schema.IMAGES)


def test_scope():
    assert paths.scope_bounds("/a/b/") == paths.scope_bounds("/a/b") == ("/a/b/", "/a/b0")
    assert paths.scope_bounds(None) is None and paths.scope_bounds(" ") is None
    assert paths.expand_home("~/x", "/h") == "/h/x" and paths.expand_home(" ~ ", "/h") == "/h"


def test_scope_is_pushed_down(spark, tmp_path):
    images(spark, [{"id": 1, "path": "/a/b/x"}, {"id": 2, "path": "/a/bc/x"}]).write.parquet(str(tmp_path / "t"))
    df = reading.scan(reading.read(spark, str(tmp_path / "t")), "/a/b")
    assert [r.id for r in df.collect()] == [1]
    assert "GreaterThanOrEqual(path" in df._jdf.queryExecution().toString()


def test_bands(spark):
    """Scores on either side of each threshold of each preset, for the frame, the tiles, both and neither."""

    def plain(rule, whole, tile):
        if whole is None:
            return "unchecked"
        if whole >= rule.whole_flag or (tile is not None and tile >= rule.tile_mean_flag):
            return "likely"
        return "unsure" if whole >= rule.unsure else "clean"

    for rule in scores.PRESETS.values():
        near = lambda *limits: [x + e for x in limits for e in (-1e-9, 0.0, 1e-9)]
        cases = [(w, t) for w in (None, 0.0, 1.0, *near(rule.whole_flag, rule.unsure)) for t in (None, 0.0, 1.0, *near(rule.tile_mean_flag))]
        df = spark.createDataFrame(cases, "w double, t double")
        got = df.select("w", "t", rule.band(F.col("w"), F.col("t")).alias("band")).collect()
        assert len(got) == len(cases) and all(r.band == plain(rule, r.w, r.t) for r in got)


def test_rule():
    assert scores.Rule(2, -1, 3).sanitised() == scores.Rule(1.0, 0.05, 1.0)
    assert scores.PRESETS["eager"].sensitivity == "eager" and scores.Rule(0.5).sensitivity == "custom"


def test_settings_fall_back():
    kept = reading.Settings(variant_maxbits=4, burst_windowsec=0, variant_rotations=False)
    assert reading.load_settings(reading.save_settings(kept)) == kept
    assert reading.load_settings({"dedup.variant.maxbits": "999", "dedup.burst.windowsec": "x", "dedup.variant.enabled": "maybe"}) == reading.Settings()
    assert reading.Settings(variant_enabled=False).covered == 5
    assert reading.Preprocess.load('{"size": {"shortest_edge": 384}, "image_mean": [0, 0, 0]}').size == 384


def group_tables(spark, spec):
    g = spark.createDataFrame([(i, k, "") for i, k, _ in spec], schema.DUPE_GROUPS)
    m = spark.createDataFrame([(i, x, x == min(ms)) for i, _, ms in spec for x in ms], schema.DUPE_MEMBERS)
    return g, m


def test_toggle_keeper(spark):
    """Random groups, one toggle each, also of rows that are no members."""
    rng = random.Random(830)
    flags = {g: [rng.random() < 0.4 for _ in range(rng.randint(2, 5))] for g in range(60)}
    hits = {g: rng.randint(0, 6) for g in flags}
    m = spark.createDataFrame([(g, k, f) for g, own in flags.items() for k, f in enumerate(own)], schema.DUPE_MEMBERS)
    got = {(r.group_id, r.image_id): r.is_keeper for r in catalog.toggle_keepers(m, spark.createDataFrame(list(hits.items()), "group_id long, image_id long")).collect()}
    for g, own in flags.items():
        want = list(own)
        if hits[g] < len(own) and not (own[hits[g]] and sum(own) == 1):
            want[hits[g]] = not want[hits[g]]
        assert [got[g, k] for k in range(len(own))] == want
    assert len(got) == sum(map(len, flags.values()))


def test_detection(spark):
    z, far = [0] * 20, [-1] * 20
    rows = [
        {"id": 1, "path": "/l/a", "content_hash": "x", "file_size": 9, "width": 4, "height": 4, "phash": z, "exif_taken": 100},
        {"id": 2, "path": "/l/b", "content_hash": "x", "file_size": 9, "width": 4, "height": 4, "phash": z, "exif_taken": 900},
        {"id": 3, "path": "/l/c", "content_hash": "y", "file_size": 9, "width": 8, "height": 8, "phash": z},
        {"id": 4, "path": "/l/d", "content_hash": "z", "file_size": 9, "phash": far, "exif_taken": 500},
        {"id": 5, "path": "/l/e", "content_hash": "q", "file_size": 9, "phash": [-1] + [-1] * 19, "exif_taken": 501},
        {"id": 6, "path": "/m/e", "content_hash": "y", "file_size": 9},
    ]
    found = groups.detect(images(spark, rows), root="/l", now=7)
    kinds = {r.id: r.kind for r in found.groups.collect()}
    got = sorted((kinds[g], sorted(ms)) for g, ms in found.members.groupBy("group_id").agg(F.collect_list("image_id")).collect())
    assert got == [("burst", [4, 5]), ("exact", [1, 2]), ("variant", [1, 2, 3])]
    keepers = {(kinds[r.group_id], r.image_id) for r in found.members.where("is_keeper").collect()}
    assert keepers == {("exact", 1), ("variant", 3), ("burst", 4)}
    assert {r.id: r.dupe_checked_kinds for r in found.images.collect()} == {1: 7, 2: 7, 3: 7, 4: 7, 5: 7, 6: 0}
    assert found.unhashed == 0 and not found.truncated and found.note() == ""


def test_view_resolves_lost_keepers_and_last_group(spark):
    rows = images(spark, [{"id": k, "path": f"/p/{k}", "file_size": 10} for k in (1, 2, 3, 4)])
    g, _ = group_tables(spark, [(1, "exact", [1]), (2, "burst", [1]), (3, "exact", [1])])
    m = spark.createDataFrame([(1, 2, False), (1, 3, False), (1, 9, True), (2, 3, True), (2, 4, False), (3, 1, True), (3, 8, False)], schema.DUPE_MEMBERS)
    out = {r.id: (r.dupe_kind, r.is_keeper) for r in view.view(rows, g, m).collect()}
    assert out == {1: (None, None), 2: ("exact", True), 3: ("burst", True), 4: ("burst", False)}


def test_selection(spark):
    rows = view.view(images(spark, [{"id": k, "path": f"/p/{c}", "file_size": 1} for k, c in enumerate("dbca")]), *group_tables(spark, [(1, "exact", [0, 1])]))
    ids = lambda df: sorted(r.id for r in df.collect())
    some = spark.createDataFrame([(0,), (7,)], "id long")
    assert ids(view.invert(some, rows)) == [1, 2, 3, 7]
    assert ids(view.select_range(some, rows, "name", False, 1, 0)) == [0, 1, 2, 7]
    assert ids(view.still_there(some, rows)) == [0] and ids(view.rejects(rows, some)) == [1, 2, 3]
    assert view.search(rows, " ").count() == 0 and dict(view.plan_steps(rows, 1))["content"] == "available"


def test_tree(spark):
    rows = images(spark, [{"id": 1, "path": "/lib/a.jpg", "analyzed_at": 1}, {"id": 2, "path": "/lib/holiday/day1/b.jpg", "dupe_checked_at": 1, "dupe_checked_kinds": 1}])
    v = view.view(rows, *group_tables(spark, [(1, "exact", [5, 6])]))
    rolled = folders.rollup(v, enabled=3)
    root = folders.tree(rolled)
    assert root.path == "/lib" and root.facts["total_count"] == 2 and root.facts["deduped"] == 0
    assert [(c.name, c.path, c.facts["total_count"]) for c in root.children] == [("holiday/day1", "/lib/holiday/day1", 1)]
    assert "1 not analysed" in root.pending()
    assert {r.path for r in folders.matching(rolled, "DAY").collect()} == {"/lib", "/lib/holiday", "/lib/holiday/day1"}


def test_tree_of_mixed_roots(spark):
    rows = images(spark, [{"id": 1, "path": "/Users/me/pics/a"}, {"id": 2, "path": "/Volumes/backup/b"}, {"id": 3, "path": "/Volumes/backup/c"}])
    rolled = folders.rollup(view.view(rows, *group_tables(spark, [(1, "exact", [5, 6])])))
    assert {r.path: r.total_count for r in rolled.collect()}["/Volumes/backup"] == 2


def test_common_prefix(spark):
    df = lambda *x: spark.createDataFrame([(p,) for p in x], "folder string")
    assert paths.common_prefix(df("/a/b", "/a/bc", "/a/b/c")) == "/a"
    assert paths.common_prefix(df("/a/b")) == "/a/b" and paths.common_prefix(df()) == ""


def test_scan_steps(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.bmp").write_bytes(b"P5 40 30 255\n" + bytes((k * x) % 251 for x in range(1200)))
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "raw.heic").write_bytes(b"x")
    listed = files.listing(spark, str(tmp_path))
    assert [(r.extension, r.n) for r in files.unsupported_counts(listed).collect()] == [("HEIC", 1)]
    old = images(spark, [])
    new = files.probe(files.supported(listed), old)
    assert {r.status for r in new.select("status").collect()} == {"new"}
    done = pixel_signals(files.supported(listed), decode_pgm).join(listed.select("path", "file_size", "mtime"), "path").drop("error").withColumn("analyzed_at", F.lit(1).cast("long"))
    merged = catalog.upsert(old, done)
    assert merged.count() == 3 and sorted(r.id for r in merged.collect()) == [1, 2, 3]
    assert {r.status for r in files.probe(files.supported(listed).select("path", "file_size", "mtime"), merged).collect()} == {"cached"}
    live = listed.where(~F.col("path").endswith("0.bmp"))
    assert catalog.prune(merged, live, str(tmp_path)).count() == 2


def test_stream_merges_new_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bmp").write_bytes(b"P5 4 4 255\n" + bytes(16))
    current = {"path": None}

    def catalogue():
        return reading.read(spark, current["path"]) if current["path"] else images(spark, [])

    def analyse(batch):
        return pixel_signals(batch, decode_pgm).join(batch.select("path", "file_size", "mtime"), "path").drop("error")

    def go():
        q = scan.merge_stream(scan.listing_stream(spark, str(tmp_path / "in")), analyse, catalogue, str(tmp_path / "cat"), lambda p: current.update(path=p), str(tmp_path / "ck"))
        q.awaitTermination(120)

    go()
    assert catalogue().count() == 1
    (tmp_path / "in/b.bmp").write_bytes(b"P5 4 4 255\n" + bytes(range(16)))
    go()
    assert sorted(r.id for r in catalogue().collect()) == [1, 2]


def test_catalogue_changes(spark):
    rows = images(spark, [{"id": 1, "path": "/a/1"}, {"id": 2, "path": "/b/2", "phash": [0] * 20}])
    assert catalog.deleted(rows, spark.createDataFrame([(1,)], "id long")).count() == 1 and catalog.forget(rows).count() == 0
    dropped, owed = catalog.invalidate(rows, "1", "2")
    assert owed and dropped.where("phash is not null").count() == 0 and not catalog.invalidate(rows, "2", "2")[1]
    meta = spark.createDataFrame([("a", "1"), ("b", "2")], schema.META)
    assert reading.meta(catalog.set_meta(meta, {"a": None, "c": "3"})) == {"b": "2", "c": "3"}
    g, m = group_tables(spark, [(1, "exact", [1, 3]), (2, "similar", [2, 4])])
    assert {r.kind for r in catalog.migrate_kinds(g).collect()} == {"exact", "variant"}
    assert [r.id for r in catalog.known_groups(g).collect()] == [1]
    assert catalog.delete_group(g, m, 1)[1].count() == 2
    assert reading.footprint(rows, spark.createDataFrame([(5,), (6,)], "file_size long")).first() == (2, 11)


def plan_rows(spark, rows):
    return spark.createDataFrame([(i, p, h, t) for i, p, h, t in rows], "id long, path string, content_hash string, exif_taken long")


def test_export_collisions(spark):
    rows = plan_rows(spark, [(1, "/x/IMG.png", "a", None), (2, "/y/IMG.png", "b", None), (3, "/z/IMG.png", "a", None), (4, "/x/d.png", "c", 1551657600)])
    got = {r.image_id: (r.dest_path, r.status) for r in export.plan(rows, "flat", "/o").collect()}
    assert got == {1: ("/o/IMG.png", "copy"), 2: ("/o/IMG (2).png", "copy"), 3: ("/o/IMG.png", "skipped"), 4: ("/o/d.png", "copy")}
    dates = {r.image_id: r.dest_path for r in export.plan(rows, "date", "/o").collect()}
    assert dates[4] == "/o/2019/2019-03/d.png" and dates[1] == "/o/undated/IMG.png"


def test_export_names_that_look_numbered_and_existing_files(spark):
    rows = plan_rows(spark, [(1, "/x/I (2).png", "q", None), (2, "/x/I.png", "a", None), (3, "/y/I.png", "b", None)])
    got = {r.image_id: r.dest_path for r in export.plan(rows, "flat", "/o").collect()}
    assert got == {1: "/o/I (2).png", 2: "/o/I.png", 3: "/o/I (3).png"}
    existing = spark.createDataFrame([("/o/I.png", "a")], "path string, content_hash string")
    got = {r.image_id: (r.dest_path, r.status) for r in export.plan(plan_rows(spark, [(2, "/x/I.png", "a", None), (3, "/y/I.png", "b", None)]), "flat", "/o", existing=existing).collect()}
    assert got == {2: ("/o/I.png", "skipped"), 3: ("/o/I (2).png", "copy")}
    assert export.resolve(["a"], ["h"], {"a": "z", **{f"a ({n})": "z" for n in range(2, 10000)}}) == [(None, False)]


def test_rejects_go_after_the_run_whether_or_not_a_keeper_failed(spark):
    journal = spark.createDataFrame([(1, 1, "/o/a", "failed", None, "differs"), (2, 2, "/o/a", "verified", None, None)], schema.EXPORT_ITEMS)
    rejected = spark.createDataFrame([(5,)], "id long")
    assert [export.to_recycle(rejected, journal, run).count() for run in (1, 2, 3)] == [1, 1, 0]
    assert export.effective_mode("hardlink", False) == "copy"


def test_manifest_files(spark, tmp_path):
    journal = spark.createDataFrame([(1, 1, "/o/a", "verified", None, None)], schema.EXPORT_ITEMS)
    export.write_manifest(export.manifest(journal, images(spark, [{"id": 1, "path": '/x/"a",b'}])), str(tmp_path / "m"))
    text = "".join(p.read_text() for p in (tmp_path / "m/csv").glob("*.csv"))
    assert text.splitlines() == ["image_id,status,source,destination,detail", '1,verified,"/x/""a"",b",/o/a,']


def test_undo(spark):
    log = spark.createDataFrame([], schema.UNDO_LOG)
    rows = images(spark, [{"id": 1, "path": "/a/1", "content_hash": "x"}, {"id": 2, "path": "/a/2"}])
    log, rows = undo.move(log, rows, spark.createDataFrame([(1, "/b/1")], "id long, new_path string"), "m", 5)
    log, rows = undo.recycle(log, rows, spark.createDataFrame([(2,)], "id long"), "r", 6)
    assert [r.path for r in rows.collect()] == ["/b/1"]
    assert [(r.batch_id, r.total, r.restored) for r in undo.batches(log).collect()] == [("r", 1, 0), ("m", 1, 0)]
    log, rows = undo.restore(log, rows, batch="m")
    assert [r.path for r in rows.collect()] == ["/a/1"] and undo.items(log, "m").first().restored


def test_codec_round_trip(spark):
    payload = codec.make_zip([("/x/a.txt", b"one"), ("/y/A.txt", b"two")])
    assert codec.open_zip(payload) == [("a.txt", b"one"), ("A (2).txt", b"two")]
    rows = spark.createDataFrame([("b", bytearray(b"carrier"), bytearray(payload))], "batch string, carrier binary, payload binary")
    sealed = codec.encrypt(rows, "pass", 1000)
    hidden = sealed.select("batch", codec.embed(F.col("carrier"), F.col("payload"), F.lit(True)).alias("content"))
    hidden = spark.createDataFrame(hidden.collect(), hidden.schema)
    assert bytes(hidden.first().content).startswith(b"carrier")
    found = hidden.select("batch", codec.extract(F.col("content")).alias("x")).select("batch", "x.*")
    assert found.first().error is None and found.first().encrypted
    opened = codec.decrypt(found.drop("error"), "pass")
    assert bytes(opened.first().payload) == payload and opened.first().error is None
    assert codec.decrypt(found.drop("error"), "other").first().error == "wrong passphrase or corrupted"
    assert [(r.name, bytes(r.content)) for r in codec.unzipped(opened).collect()] == codec.open_zip(payload)
    plain = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"y" * 40),), (bytearray(b"SNZC" + bytes([0]) + (99).to_bytes(8, "big")),)], "content binary")
    assert [r.e for r in plain.select(codec.extract(F.col("content")).error.alias("e")).collect()] == ["no hidden data", "no hidden data", "hidden data corrupted"]
    zipped = codec.zipped(spark.createDataFrame([("b", "/x/a", bytearray(b"1"))], "batch string, path string, content binary"))
    assert codec.open_zip(bytes(zipped.first().payload)) == [("a", b"1")]
    assert "implausible" in codec.unzipped(rows, entry_bytes=2).first().error


def test_inference(spark):
    import numpy as np

    files_ = spark.createDataFrame([(1, bytearray(b"P6 100 100 255\n" + bytes(30000))), (2, bytearray(b"no"))], "id long, content binary")
    out = inference.scored(files_, lambda: lambda p: float(np.mean(p)) / 255 + 0.25, lambda c: np.zeros((100, 100, 3)) if c[:2] == b"P6" else None)
    rows = {r.id: (r.nsfw_score, r.nsfw_tile_mean, r.error) for r in out.collect()}
    assert rows[1] == (0.25, 0.25, None) and rows[2][2] == "not a picture that can be decoded"
    assert {r.error for r in inference.scored(files_, lambda: None, lambda c: None).collect()} == {"no model"}
    assert len(inference.tile_rects(100, 100)) == 9 and inference.tile_rects(60, 60) == []
    assert inference.tile_rows(spark.createDataFrame([(1, 100, 100), (2, 10, 10)], "id long, width int, height int")).count() == 9
    assert inference.tensor(np.full((8, 9, 3), 255.0), reading.Preprocess(4)).shape == (1, 3, 4, 4)
    assert round(float(inference.softmax(np.array([2.0, 0.0]))[0]), 4) == 0.8808
    assert round(spark.sql("SELECT array(2D, 0D) AS l").select(scores.softmax(F.col("l"))).first()[0][0], 4) == 0.8808


def test_eta():
    eta = scan.Eta()
    assert eta.add(0, 0, 100) is None and eta.add(1000, 10, 100) == 9
    assert [labels.format_eta(x) for x in (9, 45, 90, 3600, 4000)] == ["a few seconds", "45s", "2m", "1h 0m", "1h 6m"]


def test_exif(spark):
    row = spark.createDataFrame([(None, "2019:07:15 13:45:30", "x", " TestMake ", "CoolCam 9000")], "a string, b string, c string, make string, model string")
    got = row.select(labels.taken(F.col("a"), F.col("b"), F.col("c")), labels.camera(F.col("make"), F.col("model")), labels.camera(F.lit("Canon"), F.lit("canon X")), labels.camera(F.lit(" "), F.lit(None))).first()
    assert tuple(got) == (1563198330, "TestMake CoolCam 9000", "canon X", None)


def test_sizes(spark):
    df = spark.createDataFrame([(999,), (1500,), (2_600_000,), (3_450_000_000,)], "n long")
    assert [r[0] for r in df.select(labels.format_bytes(F.col("n"))).collect()] == ["999 bytes", "2 KB", "3 MB", "3.5 GB"]


def test_thumbnails(spark):
    import numpy as np

    from heliograph.operators.thumbs import fitted, thumbnails

    content = b"P5 800 400 255\n" + bytes(320_000)
    rows = spark.createDataFrame([("/a", bytearray(content)), ("/b", bytearray(b"x"))], "path string, content binary")
    out = {r.path: r for r in thumbnails(rows, decode_pgm).collect()}
    assert decode_pgm(bytes(out["/a"].thumb)).shape == (160, 320) and out["/a"].thumb_path[:3] == out["/a"].thumb_path[3:5] + "/"
    assert out["/b"].thumb is None and fitted(np.ones((3, 9)), 320).shape == (3, 9)
    assert np.allclose(fitted(np.arange(16.0).reshape(4, 4), 2), [[2.5, 4.5], [10.5, 12.5]])


def test_selection_store(tmp_path):
    from heliograph.sources.session_store import SelectionStore

    path = str(tmp_path / "s.json")
    store = SelectionStore(path, pause=1000)
    store.mutate(lambda s: s.update({3, 1}))
    store.mutate(lambda s: s.discard(3))
    store.flush()
    assert SelectionStore(path).selected == {1}
    (tmp_path / "s.json").write_text("{broken")
    assert SelectionStore(path).selected == set()


def test_vanished_facets(spark):
    rows = view.view(images(spark, [{"id": 1, "path": "/p/x", "exif_taken": 0}]), *group_tables(spark, [(1, "exact", [5, 6])]))
    kept = view.Filters(folder="/p", year="1970")
    assert view.reset_vanished(kept, rows) == kept
    assert view.reset_vanished(view.Filters(folder="/q", year="1999"), rows) == view.Filters()


def test_seconds_left(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 1000, 10), ("a", 9000, 20), ("b", 5, 100)], "job string, ms long, done long")
    assert [r.eta for r in scan.seconds_left(df, 100).orderBy("job", "ms").collect()] == [None, 9.0, None, None]


def test_slots_are_settled_as_one_by_one():
    rng = random.Random(6)

    def plain(names, hashes, taken):
        there, out = dict(taken), []
        for name, content in zip(names, hashes):
            stem, ext = os.path.splitext(name)
            for slot in [name, *(f"{stem} ({n}){ext}" for n in range(2, 60))]:
                if there.get(slot, content) == content:
                    out.append((slot, slot in there))
                    there[slot] = content
                    break
        return out

    for _ in range(300):
        names = rng.choices(["a.x", "a (2).x", "b", "a (3).x"], k=12)
        hashes = rng.choices("hijk", k=12)
        taken = {n: rng.choice("hijk") for n in rng.sample(["a.x", "a (2).x", "a (5).x", "b (2)"], 2)}
        assert export.resolve(names, hashes, taken) == plain(names, hashes, taken)


def test_many_files_of_one_name():
    names = export.resolve(["n.txt"] * 12_000, [f"h{k}" for k in range(12_000)])
    assert names[0] == ("n.txt", False) and names[9998] == ("n (9999).txt", False) and set(names[9999:]) == {(None, False)}


def test_differences_of_groups(spark):
    rows = spark.createDataFrame([(1, 7, 10, "a"), (2, 7, 20, "a"), (3, 7, None, "a"), (4, 8, 5, None), (5, 8, 5, ""), (6, None, 1, "z"), (7, 9, 0, "x"), (8, 9, None, "y")], "id long, dupe_group long, size long, name string")
    out = view.differences(rows, ("size",)).collect()
    got = {r.image_id: (r.size_differs, r.size_best) for r in out}
    assert got == {1: (True, False), 2: (True, True), 3: (True, False), 4: (False, False), 5: (False, False), 7: (True, False), 8: (True, False)}


def test_members_in_order_of_path(spark):
    rows = spark.createDataFrame([(1, "/b", 7, True), (2, "/a", 7, False), (3, "/B", 7, False), (4, "/c", None, None)], "id long, path string, dupe_group long, is_keeper boolean")
    assert [r.id for r in view.group_members(rows, 7).collect()] == [3, 2, 1]
    assert [(r.dupe_group, r.ids) for r in view.members_by_path(rows).collect()] == [(7, [3, 2, 1])]


@pytest.mark.parametrize("mode", ["copy", "move", "hardlink"])
def test_an_export_is_carried_out(spark, tmp_path, mode):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for k in range(6):
        (source / f"f{k}.txt").write_text("same" if k in (1, 2) else f"content {k}")
    facts = [{"id": k, "path": str(source / f"f{k}.txt"), "content_hash": transfer.content_hash(str(source / f"f{k}.txt")), "file_size": (source / f"f{k}.txt").stat().st_size} for k in range(6)]
    facts[3]["content_hash"], facts[3]["file_size"] = "wrong", 1
    (source / "f4.txt").unlink()
    rows = images(spark, facts)
    flat = rows.withColumn("path", F.regexp_replace("path", "f[12].txt", "g.txt"))
    planned = export.plan(flat, "flat", str(target))
    log = spark.createDataFrame([], schema.UNDO_LOG)
    journal, log, after = transfer.export_run(planned, rows, log, 1, str(tmp_path / "store"), mode, 5)
    status = {r.image_id: (r.status, r.error) for r in journal.collect()}
    assert [status[k][0] for k in range(6)] == ["verified", "verified", "skipped", "failed", "failed", "verified"] and status[4][1] == "source missing"
    assert (target / "f0.txt").read_text() == "content 0" and not list(target.glob("*.part"))
    paths = {r.id: r.path for r in after.collect()}
    if mode == "move":
        assert sorted(r.original_path for r in log.collect()) == sorted(str(source / f"f{k}.txt") for k in (0, 1, 5))
        assert paths[0] == str(target / "f0.txt") and paths[2] == str(source / "f2.txt") and not (source / "f0.txt").exists() and (source / "f3.txt").exists()
    else:
        assert log.count() == 0 and paths[0] == str(source / "f0.txt") and (source / "f0.txt").exists()
    again = transfer.transfer(planned.where("image_id in (0, 1)"), rows, 2, mode)  # a task that is repeated
    assert {r.status for r in again.collect()} == {"verified"}


def test_a_folder_is_scanned_anew(spark):
    rows = images(spark, [{"id": 1, "path": "/l/a/1", "file_size": 1, "mtime": 1, "analyzed_at": 1}, {"id": 2, "path": "/l/a/2"}, {"id": 3, "path": "/l/b/3"}])
    found = spark.createDataFrame([("/l/a/1", 1, 1), ("/l/a/9", 1, 1), ("/l/b/8", 1, 1)], "path string, file_size long, mtime long")
    status, left = files.rescan(found, rows, "/l/a")
    assert {r.path: r.status for r in status.collect()} == {"/l/a/1": "cached", "/l/a/9": "new"}
    assert sorted(r.id for r in left.collect()) == [1, 3]


def test_recipe_changes_leave_one_backup_and_one_notice(spark, tmp_path):
    rows = images(spark, [{"id": 1, "path": "/a", "phash": [1] * 20, "dupe_checked_kinds": 7}])
    taken = set()
    for k in range(2):
        after, change = catalog.migrate_recipe(rows, str(k), str(k + 1), str(tmp_path))
        assert after.first().phash is None and change.rows == 1 and len(list((tmp_path / "backup").glob("v-*"))) == 1
        assert spark.read.parquet(change.backup).first().phash == [1] * 20
        assert change.backup in change.take_notice(taken) and change.take_notice(taken) is None
    assert catalog.migrate_recipe(rows, "2", "2", str(tmp_path))[1] is None
    empty, change = catalog.migrate_recipe(rows.where("false"), None, "1", str(tmp_path))
    assert change.take_notice(taken) is None and change.backup is None and empty.count() == 0


def test_score_settings_are_stored():
    rule = scores.Rule(0.7, 0.4, 0.2)
    assert reading.load_rule(reading.save_rule(rule, False)) == (rule, False)
    assert reading.load_rule({"score.whole.flag": "1.5", "score.unsure": "nan", "score.tile.mean.flag": "x"}) == (scores.Rule(1.0).sanitised(), True)


def test_sizes_round_halves_to_even(spark, duck):
    from heliograph.functions.labels import format_bytes

    sizes = [999, 1000, 1499, 1500, 1501, 2500, 2501, 3500, 999_500, 1_500_000, 2_500_000, 2_500_001, 7_500_000]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", format_bytes(F.col("n")).alias("s"))
    asked = "SELECT CASE WHEN n >= 1000000 THEN printf('%.0f MB', n / 1e6) WHEN n >= 1000 THEN printf('%.0f KB', n / 1e3) ELSE printf('%d bytes', n) END"
    assert {r.n: r.s for r in rows.collect()} == {n: duck.sql(asked.replace("n ", f"{n} ").replace(", n)", f", {n})")).fetchall()[0][0] for n in sizes}


def test_opened_archives_are_passed_on_before_the_next(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(codec, "HELD", 10)
    frame = pd.DataFrame({"batch": ["a", "b", "c"], "payload": [codec.make_zip([("/x.txt", b"0123456789")]), b"none", codec.make_zip([("/y.txt", b"abc")])]})
    parts = list(codec.opened(iter([frame])))
    assert [len(x) for x in parts] == [1, 2] and pd.concat(parts)["name"].tolist() == ["x.txt", None, "y.txt"]
