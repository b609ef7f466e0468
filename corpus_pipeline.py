"""The corpus pipeline: five operators in a row over the documents table.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame,
which is written as Parquet and read again as the next one's docs. All but the last return the columns of
documents. Rows are judged one by one by their own text: a null or repeated doc_id never makes a row go or stay, other
columns than doc_id and text are only carried, of any type or name, texts are taken whole whatever their length, and an
empty table gives an empty result of the same columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from heliograph.graph import cut, remove, shared_folder
from heliograph.llm import decontaminate, packing, secrets, simhash, toxicity
from heliograph.llm.common import table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.5 or more are rejected and go. Null and empty texts have the overall rate; equal texts share their fate."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id stays, of equal ones the first by the text's hash.

    Null and empty texts are one group; null doc_ids come last.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go. Null and empty texts hold none."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; the characters of secrets are replaced by a mark, overlapping secrets by one, and n_chars follows.

    Null texts stay null.
    """
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the rows that are left, in sequences of at most 2048 ids; a null or empty text is one piece of the end id."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("simhash", near_dedup), ("decontamination", decontamination), ("secrets", secret_scan), ("packing", pack)]

#: Tokenization and SimHash have no SQL; run() is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what each returns is written to the shared folder, read again, and removed once used."""
    parent, before = shared_folder(spark), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = f"{parent}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove(spark, before)
        before = folder
    out = cut(STAGES[-1][1](spark, docs, sf_dir))
    remove(spark, before)
    return out
