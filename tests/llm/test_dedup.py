import re

import numpy as np
import pytest
import xxhash
from comparing import same_rows

from heliograph.graph import components
from heliograph.llm import simhash, substrings


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable, for a dict of id to fingerprint."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(docs, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(prints)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in texts}
    assert any(want[i] != i for i in want)


@pytest.mark.parametrize("crowd", [1, 2, 5, 1000])
def test_links_keep_components_whatever_a_crowd_is(spark, crowd):
    rng = np.random.default_rng(3)
    fps = {0, (1 << 64) - 1}
    for center in rng.integers(0, 1 << 63, 6).tolist():
        fps.add(center)
        for _ in range(25):
            x = center
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << b
            fps.add(x)
    want = plain_components({x: x for x in fps})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    links = simhash.links(df, crowd)
    edges = [(r.a, r.b) for r in links.collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 and a != b for a, b in edges)
    roots = {r.node: r.root for r in components(links).collect()}
    group = lambda f: {frozenset(y for y in fps if f(y) == f(x)) for x in fps}
    assert group(lambda x: want[x]) == group(lambda x: roots.get(signed(x), signed(x)))


def test_signatures_are_not_shuffled(spark):
    """A fingerprint is sent to eight parts, not under each of its 64 signatures."""
    rng = np.random.default_rng(5)
    n = 20_000
    df = spark.createDataFrame([(x,) for x in rng.integers(-(1 << 63), 1 << 63, n).tolist()], "fp long")

    def written():
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    before = written()
    simhash.links(df).count()
    assert written() - before < 16 * n * 20


def test_components_of_a_star_and_a_chain(spark):
    edges = [(0, k) for k in range(1, 200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(200)} | {k: 1000 for k in range(1000, 1061)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_hostile_rows(hostile, none):
    rows = simhash.near_duplicates(hostile).collect()
    assert len(rows) == hostile.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    zero = ("0" * 16, 1)
    assert by[1] == by[2] == by[5] == by[10] == {zero}
    assert by[3] == by[7] and next(iter(by[3]))[1] == 3
    assert simhash.near_duplicates(none).count() == 0


def test_keep_one(hostile, none, docs, texts):
    kept = simhash.keep_one(hostile)
    assert kept.columns == hostile.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {1, 3, 4, 6, 9, -4, None} <= set(ids) and not {2, 5, 7, 10} & set(ids)
    assert simhash.keep_one(none).count() == 0
    want = plain_components({i: plain_fingerprint(t) for i, t in texts.items()})
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {i for i in want if want[i] == i}


def test_keep_one_judges_rows_not_ids(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(None, text(1)), (None, text(2)), (None, text(3)), (5, text(4)), (5, text(5)), (5, text(5)), (6, text(4)), (7, text(1)), (8, None), (9, ""), (None, text(2))]
    df = spark.createDataFrame([(i, t, {"k": n}) for n, (i, t) in enumerate(rows)], "doc_id long, text string, fp map<string,int>").repartition(3)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.schema["fp"].dataType == df.schema["fp"].dataType
    got = sorted((str(r.doc_id), r.text, r.fp["k"]) for r in kept.collect())  # of equal rows the first as JSON: {"k":10}, not {"k":1}
    assert got == sorted([("None", text(2), 10), ("None", text(3), 2), ("5", text(4), 3), ("5", text(5), 4), ("7", text(1), 7), ("8", None, 8)])


def test_substrings_equal_sql(spark, duck, sf):
    assert same_rows(substrings.op9_substring_dedup(spark, sf).toPandas(), duck.sql(substrings.ORACLE_SQL).df())


def plain_removal(rows, window):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    seen = {}
    for k, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((k, i))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k].update(range(i, i + window))
    return sorted((str(i), len(w), len(g), " ".join(x for j, x in enumerate(w) if j not in g)) for (i, _), w, g in zip(rows, words, gone))


@pytest.mark.parametrize("window, chunk", [(3, 2_000_000), (35, 2_000_000), (20, 40)])
def test_removal_equals_brute_force(spark, monkeypatch, window, chunk):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    rng = np.random.default_rng(window)
    line = " ".join(f"l{k}" for k in range(40))
    rows = [(k, " ".join(rng.choice(["a", "b", "c", "d"], rng.integers(0, 50)).tolist() + ([line] if k % 3 == 0 else []))) for k in range(40)]
    rows += [(100, "same " * 60), (101, line), (102, line), (None, line + " end"), (103, None), (104, "x y"), (105, "e " * 80)]
    rows += [(101, line)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got.collect()) == plain_removal(rows, window)


def test_removal_of_hostile_rows(hostile, none):
    rows = substrings.remove_repeats(hostile).collect()
    assert len(rows) == hostile.count()
    assert {(r.n_words, r.n_removed) for r in rows if r.doc_id in (3, 7)} == {(60, 60)}
    assert {(r.n_words, r.n_removed, r.kept) for r in rows if r.doc_id in (1, 2, 5, 10)} == {(0, 0, "")}
    assert [(r.n_words, r.n_removed) for r in rows if r.doc_id == 4] == [(90_000, 90_000)]
    assert substrings.remove_repeats(none).count() == 0


def test_sketch_only_overestimates():
    reader = substrings._Reader(20)
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 3, 400).astype(np.uint64)
    runs, anchors = reader.anchors(codes)
    windows = {}
    for i in range(len(codes) - 19):
        windows.setdefault(tuple(codes[i : i + 20].tolist()), []).append(i)
    places = reader.places(codes).tolist()
    for at in windows.values():
        assert places.count(int(anchors[at[0]])) >= len(at)


def test_digest_column(spark, sf):
    row = substrings.op9_substring_dedup(spark, sf).first()
    assert len(row.kept_sha256) == 64 and row.n_removed <= row.n_words
