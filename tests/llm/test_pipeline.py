import pytest

import corpus_pipeline
from heliograph.llm import secrets, toxicity
from test_dedup import plain_components, plain_fingerprint
from test_spans import plain_secrets
from test_texts import plain_leaks
from test_tokens import check_pack, library  # noqa: F401


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "secrets", "packing"]


def test_run_against_a_plain_version(spark, library):  # noqa: F811
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    left = {i: t for i, t in texts.items() if model.score(t)[0] < 0.5}
    group = plain_components({i: plain_fingerprint(t) for i, t in left.items()})
    left = {i: t for i, t in left.items() if group[i] == i}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    leaks = {d for (d, _), v in plain_leaks(left, items).items() if v >= 0.8}
    left = {i: t for i, t in left.items() if i not in leaks}
    scanner = secrets.Scanner()
    clean = {i: secrets._without(t, scanner.scan([t])[0], "[SECRET]") for i, t in left.items()}
    assert all(not plain_secrets(t) for t in clean.values()) and clean != left
    rows = corpus_pipeline.run(spark, sf).collect()
    check_pack(rows, {i: [*library(t), 1] for i, t in clean.items()})


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_the_columns(spark, sf, hostile, none, k):
    stage = corpus_pipeline.STAGES[k][1]
    assert stage(spark, hostile, sf).columns == hostile.columns
    assert stage(spark, none, sf).columns == none.columns and stage(spark, none, sf).count() == 0


def folder_with(spark, sf, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_run_on_hostile_rows(spark, sf, hostile, tmp_path, library):  # noqa: F811
    """Only copies go: rows without an id, or of one id, are judged by their own texts."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    more = [(None, f"another text {k} without an id " * 4, "x", "y", 1) for k in range(3)] + [(20, "one of two texts", "x", "y", 1), (20, "the other of both", "x", "y", 1), (20, item, "x", "y", 1), (None, item + " .", "x", "y", 1)]
    docs = hostile.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    rows = corpus_pipeline.run(spark, folder_with(spark, sf, docs, tmp_path)).collect()
    texts = [r.text or "" for r in docs.collect()]
    clean = {t.replace("0123456789abcdef0123456789abcdef", "[SECRET]") for t in texts if item not in t}
    distinct = {plain_fingerprint(t): t for t in sorted(clean)}  # none of them are near
    got = sorted((r.doc_tokens, r.length) for r in rows if r.start == 0)
    assert len(got) == len(distinct)
    assert sum(r.doc_id is None for r in rows if r.start == 0) == 4 and sum(r.doc_id == 20 for r in rows if r.start == 0) == 2


def test_run_on_an_empty_table(spark, sf, none, tmp_path):
    assert corpus_pipeline.run(spark, folder_with(spark, sf, none, tmp_path)).count() == 0
