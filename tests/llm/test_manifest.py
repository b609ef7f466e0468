"""Exact deduplication by a stream, spelling variants, and the Merkle manifest."""

import hashlib
import random
import re
import zlib

import pytest

from heliograph.llm import exact, merkle, spelling


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_groups(rows):
    """(doc_id, keep_id, group_size, text_sha256) of rows (doc_id, text), sorted; null ids as -1."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((-1 if i is None else i), keep[t or ""], len(groups[t or ""]), sha(t or "")) for i, t in rows)


def found_groups(df):
    return sorted(((-1 if r.doc_id is None else r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in df.collect())


def test_exact_on_hostile_rows(spark, hostile, tmp_path):
    hostile.write.parquet(f"{tmp_path}/d")
    df = exact.exact_duplicates(spark, f"{tmp_path}/d").cache()
    assert found_groups(df) == plain_groups([(r.doc_id, r.text) for r in hostile.collect()])
    kept = [r.text_sha256 for r in df.where("kept").collect()]
    assert len(kept) == len(set(kept)) == df.select("text_sha256").distinct().count()
    assert df.where("kept and not (doc_id <=> keep_id)").isEmpty()


def test_exact_of_nothing(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/d")
    assert exact.exact_duplicates(spark, f"{tmp_path}/d").isEmpty()


@pytest.mark.parametrize("share", [1, 1024])
def test_texts_are_compared_where_digests_collide(spark, sf, docs, monkeypatch, share):
    monkeypatch.setattr(exact, "SHARE", share)
    got = exact.exact_duplicates(spark, f"{sf}/documents.parquet", digest=1)
    assert found_groups(got) == plain_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert got.where("kept").count() == got.select("text_sha256").distinct().count()


def test_many_hits_are_shuffled(spark, sf, docs, monkeypatch):
    monkeypatch.setattr(exact, "SENT", 0)
    assert found_groups(exact.exact_duplicates(spark, f"{sf}/documents.parquet")) == plain_groups([(r.doc_id, r.text) for r in docs.collect()])


def test_stream_goes_on_and_revises(spark, tmp_path):
    rows = [[(1, "a"), (2, "b")], [(3, "a"), (4, "c"), (0, "b")], [(9, "c")]]
    said, every = [], []
    for k, part in enumerate(rows):
        every += part
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/d")
        exact.ingest(spark, f"{tmp_path}/d", f"{tmp_path}/state", files_at_once=1)
        known = exact.decisions(spark, f"{tmp_path}/state")
        said.append(sorted((r.n, r.keep.doc_id) for r in known.collect()))
        assert found_groups(exact.decide(spark.read.parquet(f"{tmp_path}/d"), known)) == plain_groups(every)
    assert said == [[(1, 1), (1, 2)], [(1, 4), (2, 2), (2, 3)], [(2, 2), (2, 3), (2, 9)]]
    exact.ingest(spark, f"{tmp_path}/d", f"{tmp_path}/state")  # nothing new
    assert sorted((r.n, r.keep.doc_id) for r in exact.decisions(spark, f"{tmp_path}/state").collect()) == said[-1]


def one_edit(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_words(rows):
    counts = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[word] = counts.get(word, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_variants(words):
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def found_variants(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def test_trie_emits_the_pairs_at_distance_one():
    rng = random.Random(71)
    for _ in range(60):
        words = list({"".join(rng.choice("xyé") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 60))})
        want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])}
        got = spelling.trie_pairs(words)
        assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("crowd, hot", [(2, 10**9), (8, 4), (10**6, 10**9)])
def test_partitions_report_each_pair_once(spark, crowd, hot):
    rng = random.Random(72)
    words = {"".join(rng.choice("mnü") for _ in range(rng.randint(1, 9))) for _ in range(400)} | {"q" * k for k in (1, 2, 3, 500, 501)} | {"m" * 6 + x for x in "abcdefgh"}
    df = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    got = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(df, crowd, hot).collect()]
    want = {tuple(sorted((a, b))) for a in words for b in words if one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_variants_of_documents(docs, texts):
    rows = list(texts.items())
    assert found_variants(spelling.variants(docs)) == plain_variants(plain_words(rows))


def test_variants_of_planted_words(spark):
    rows = [(k, "harmonica " * 120 + "harmonyca harmonyca Harmonica") for k in range(3)] + [(7, "harmonyc harmonyc xharmonica xharmonica ×÷×÷×÷× ×÷×÷×÷×")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_variants(plain_words(rows))
    assert found_variants(spelling.variants(df)) == want
    assert ("xharmonica", "harmonica") in {(w, f) for w, f, *_ in want}


def test_variants_follow_forms_to_the_root(spark):
    chain = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(9)] + [("v", "w3")], "word string, form string")
    assert {(r.word, r.root) for r in spelling._roots(chain).collect()} == {(w, "w9") for w in [*[f"w{k}" for k in range(9)], "v"]}


def test_variants_on_hostile_rows(hostile, none):
    want = plain_variants(plain_words([(r.doc_id, r.text) for r in hostile.collect()]))
    assert found_variants(spelling.variants(hostile)) == want
    assert spelling.variants(none).isEmpty()


def plain_manifest(rows):
    """Of rows (doc_id, source, lang, n_chars, text): sorted (doc_id, leaf, subroot, root, proof, folded)."""

    def leaf(values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
        return out

    sources = {}
    for row in rows:
        cut = row[4].replace("\n", "") if row[4] is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 else row[4]
        sources.setdefault(row[1], []).append((row[0], leaf(row), leaf((*row[:4], cut))))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels([x[1] for x in sources[s]])
    heads = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (doc_id, own, tampered) in enumerate(sources[s]):
            siblings, node = "", tampered
            for tree, place in ((trees[s], at), (heads, k)):
                for level in tree[:-1]:
                    run = level[place - place % 3 : place - place % 3 + 3]
                    siblings += "".join(run[: place % 3] + run[place % 3 + 1 :])
                    node = sha("".join(run[: place % 3]) + node + "".join(run[place % 3 + 1 :]))
                    place //= 3
            out.append((doc_id, own, trees[s][-1][0], heads[-1][0], sha(siblings), node))
    return sorted(out, key=str)


def found_manifest(df):
    rows = df.collect()
    assert all(r.verified == (r.folded_root == r.root) for r in rows)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in rows), key=str)


def rows_of(df):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("levels, top", [(6, 4096), (1, 4), (2, 1), (1, 1)])
def test_manifest_whatever_blocks_are(docs, levels, top):
    df = merkle.manifest(docs, levels, top).cache()
    assert found_manifest(df) == plain_manifest(rows_of(docs))
    assert 0 < df.where("verified").count() < df.count()


@pytest.mark.parametrize("counts", [[1], [2], [3], [4, 1, 9], [27, 1, 1, 1], [28, 10], [1] * 11])
def test_manifest_of_full_and_lone_runs(spark, counts):
    rows = [(k, None if g == 0 else f"s{g}", "en", 3, f"a\n{k}") for g, n in enumerate(counts) for k in range(g, g + 7 * n, 7)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert found_manifest(merkle.manifest(df, 1, 2)) == plain_manifest(rows)


def test_manifest_on_hostile_rows(spark, hostile, none):
    assert found_manifest(merkle.manifest(hostile)) == plain_manifest(rows_of(hostile))
    assert merkle.manifest(none).isEmpty()
    same = spark.createDataFrame([(None, None, None, None, None)] * 40, none.schema)  # equal in everything
    assert found_manifest(merkle.manifest(same, 1, 4)) == plain_manifest(rows_of(same))
