import random
import zlib

import numpy as np
import pytest

from heliograph.llm import ans, packing, tokens
from heliograph.llm.tokens import default_path, encoder


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoder_gives_the_library_s_ids(library, texts):
    e = encoder(default_path())
    hard = ["a b x\x1c y²³ 12½ _a_ __", "'s it's  \n\n x\t\ty   ", "日本 語 <|endoftext|> é<|endoftext|>", " ", "\n \n", "a​b ÿŸ ª º × ÷", "é́ \x85 z", "'", "''s 'll'LL", "  x", "\r\n\r\n", "\xa0\xa0a", "x" * 3000, "ǅ ɏ ɐ"]
    for text in [*hard, *list(texts.values())]:
        assert np.frombuffer(e(text), e.dtype).tolist() == library(text), text[:50]
    assert e.cut and e(None) == e("") == b"" and e.batch([]) == []
    assert e.batch(["a b", None, "", " c", "a b"]) == [e("a b"), b"", b"", e(" c"), e("a b")]


def test_cutting_at_spaces_never_changes_ids(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    monkeypatch.setattr(tokens, "LONGEST", 3)
    e, rng = tokens.Encoder(default_path()), random.Random(3)
    letters = "ab'sTt \n\t\r  12.,é日\u0085\x1c\x1f<|>endoftext😀\u200b\u3000\u00a0\u2028\ufeff   "
    several = ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(5000)]
    for k in range(0, 5000, 100):
        for text, ids in zip(several[k : k + 100], e.batch(several[k : k + 100])):
            assert np.frombuffer(ids, e.dtype).tolist() == library(text), repr(text)
    e.cut = False
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.batch([None, "", *several[:50]])] == [[], [], *map(library, several[:50])]


def test_a_repeated_id_is_spread(spark, tmp_path, library):
    rows = [(7, f"text {k}") for k in range(300)] + [(k, "x") for k in range(-20, 30) if k != 7]
    ans.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "f"))
    got = sorted(ans.read_tokens(spark, str(tmp_path / "f")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    assert sorted(r.ids for r in got if r.doc_id == 7) == sorted([*library(f"text {k}"), 0] for k in range(300))
    assert [r.start for r in got] == (np.cumsum([r.n_tokens for r in got]) - [r.n_tokens for r in got]).tolist()
    assert spark.read.parquet(str(tmp_path / "f")).select("part").distinct().count() > 2


@pytest.mark.parametrize("n, symbols", [(0, 1), (1, 1), (63, 2), (64, 1), (1000, 50_000), (262_144, 300), (300_001, 40_000), (600_000, 3)])
def test_segment_round_trip(n, symbols):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.4, n).astype(np.int64) % symbols
    cuts = np.sort(rng.integers(0, n + 1, 5))
    docs = [(None if k == 2 else -k * 10**12, x.astype(np.uint16)) for k, x in enumerate(np.split(ids, cuts))]
    names, lengths, got = ans.read_segment(ans.write_segment(docs))
    assert names == [i for i, _ in docs] and lengths.tolist() == [len(x) for _, x in docs] and (got == ids).all()


def test_damage_is_found():
    data = ans.write_segment([(1, np.arange(5000, dtype=np.uint16) % 77)])
    for at in (0, 60, len(data) // 2, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 64
        with pytest.raises((ValueError, zlib.error, KeyError, UnicodeDecodeError)):
            ans.read_segment(bytes(bad))


def test_frequencies():
    for counts in ([1], [1, 10**9], [5] * 50_000, [10**12] + [1] * 40_000):
        f = ans.frequencies(np.array(counts))
        assert f.sum() == 1 << ans.SCALE and f.min() >= 1


def test_op6_equals_the_library(spark, sf, texts, library):
    rows = sorted(ans.op6_token_files(spark, sf).collect())
    at = 0
    for r, i in zip(rows, sorted(texts), strict=True):
        ids = [*library(texts[i]), 0]
        assert tuple(r) == (i, at, len(ids), crc(ids))
        at += len(ids)


@pytest.mark.parametrize("segment", [50, 1 << 21])
def test_files_of_hostile_rows(spark, hostile, none, library, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(ans, "SEGMENT", segment)
    ans.write_tokens(hostile, str(tmp_path / "a"))
    rows = sorted(ans.read_tokens(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, -4, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 10]
    want = {r.doc_id: [*library(r.text), 0] for r in hostile.collect()}
    assert all(r.ids == want[r.doc_id] and r.n_tokens == len(r.ids) for r in rows)
    assert [r.start for r in rows] == (np.cumsum([r.n_tokens for r in rows]) - [r.n_tokens for r in rows]).tolist()
    ans.write_tokens(none, str(tmp_path / "b"))
    assert ans.token_digests(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("first", [0, 2**53 - 300, 2**62, -(2**63), 2**63 - 600])
def test_files_are_in_order_of_any_ids(spark, library, tmp_path, monkeypatch, first):
    """Ids that are one number as doubles keep their order, whatever rows come first."""
    monkeypatch.setattr(ans, "SAMPLED", 5)
    ids = list(range(first, first + 600))
    random.Random(4).shuffle(ids)
    rows = [(i, f"text {i % 7}" * (i % 5)) for i in ids]
    ans.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path / "f"))
    got = sorted(ans.token_digests(spark, str(tmp_path / "f")).collect(), key=lambda r: r.start)
    want = {i: [*library(t), 0] for i, t in rows}
    assert [r.doc_id for r in got] == sorted(want)
    assert [r.start for r in got] == (np.cumsum([r.n_tokens for r in got]) - [r.n_tokens for r in got]).tolist()
    assert all((r.n_tokens, r.ids_crc32) == (len(want[r.doc_id]), crc(want[r.doc_id])) for r in got)
    parts = spark.read.parquet(str(tmp_path / "f")).groupBy("part").count().count()
    assert parts > 1


@pytest.mark.parametrize("hot, text", [(None, "a hot text {}"), (None, "one text"), (500, "one text"), (2**62, "a hot text {}")])
def test_hot_ids_are_spread_in_order(spark, library, tmp_path, hot, text):
    """A third of the rows have no id or one: no range holds them all, and all ids stay in order."""
    rows = [(i, f"own {i}") for i in range(800)] + [(hot, text.format(k)) for k in range(400)]
    random.Random(5).shuffle(rows)
    ans.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path / "f"))
    got = sorted(ans.read_tokens(spark, str(tmp_path / "f")).collect(), key=lambda r: r.start)
    names = [r.doc_id for r in got]
    assert names == sorted((i for i, _ in rows), key=lambda i: ans.BEFORE_ALL if i is None else i)
    assert sorted(map(tuple, (r.ids for r in got if r.doc_id == hot))) == sorted((*library(t), 0) for i, t in rows if i == hot)
    sizes = [r.n for r in spark.read.parquet(str(tmp_path / "f")).groupBy("part").agg({"n_tokens": "sum"}).toDF("part", "n").collect()]
    assert len(sizes) >= 3 and max(sizes) < 0.5 * sum(sizes)


def check_pack(rows, want, length=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == want.keys()
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[i]) and r.ids_crc32 == crc(want[i][at : at + r.length])
            at += r.length
        assert at == len(want[i])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding == 0


def test_packing_of_documents(docs, texts, library):
    check_pack(packing.pack(docs).collect(), {i: [*library(t), 1] for i, t in texts.items()})


def test_packing_of_hostile_rows(hostile, none, library):
    rows = packing.pack(hostile)
    assert sum(r.length for r in rows.collect()) == sum(len(library(r.text)) + 1 for r in hostile.collect())
    once = hostile.dropDuplicates(["doc_id"])
    check_pack(packing.pack(once).collect(), {r.doc_id: [*library(r.text), 1] for r in once.collect()})
    assert packing.pack(none).count() == 0


def test_hilbert_is_a_curve():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    order = packing.hilbert(cells, 3)
    assert sorted(order.tolist()) == list(range(512))
    walk = cells[np.argsort(order)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_neighbours_are_alike(docs):
    rows = packing.pack(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r.lang)
    mixed = [len(set(x)) for x in sequences.values() if len(x) > 2]
    assert np.mean(mixed) < 2


def test_words_are_remembered_apart_from_marks_and_digits():
    """'stop' is encoded once, whatever follows it, and stays known from task to task."""
    e = tokens.Encoder(default_path())
    e.batch(["stop, stop. stop; stop\nstop1 stop", "a stop"])
    assert {b"stop", b" stop", b",", b".", b";", b"\nstop", b"1"} <= set(e.known) and not any(x.startswith(b" stop") and len(x) > 5 for x in e.known)
