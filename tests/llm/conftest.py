import pytest

#: Names that the operators use themselves, as columns of the input.
CLASHES = "key fp part kept_id h start k d p c root node score ids curve bucket kind cover windows text_key leaked_id n guest rows_of_id base spans patterns component_id item_id words".split()


@pytest.fixture(scope="session")
def hostile(spark):
    """Documents with nulls, empty and very long texts, repeated rows, ties, and clashing columns."""
    passage = " ".join(f"word{k}" for k in range(60))
    texts = [
        (1, ""), (2, None), (3, passage), (3, passage), (4, "lorem ipsum dolor " * 30_000), (None, "a text without an id, with token = \"0123456789abcdef0123456789abcdef\""),
        (5, " \n\t "), (6, "日本語 テキスト 😀 emoji ünï " * 20), (7, passage), (8, passage.replace("word30", "other")), (9, "x" * 300_000), (-4, "a@b.co 1.2.3.4 +1 (555) 555-0100"), (10, None),
    ]
    rows = [(i, t, None if k % 2 else "en", None, None if k % 3 else 5, *[k] * len(CLASHES)) for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHES)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}
