"""Exact deduplication by a stream with keyed state.

`ingest` runs what is new in a folder of documents through a streaming aggregation whose state lies on disk
(RocksDB, logged to the stream's folder in the shared store) and never expires: for each digest the number
of texts, the stable identifier of the text that stays (the largest doc_id) and the locator of its content
(file and row). Each task combines its rows before the shuffle, so a digest that a third of all rows share
reaches the state as one row a task. A stream goes on from its folder: later files revise earlier decisions.

`decide` checks whole texts on hits: where a digest was seen more than once, the text at the kept locator is
fetched and every other text of the digest is compared with it. Texts that differ (a collision of the digest)
are grouped anew by the text itself, so the result is exact whatever the digest is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.graph import remove, shared_folder
from heliograph.llm.common import cut

#: Bytes of a SHA-256 that are the state's key.
DIGEST = 32
#: Settings of a stream's state: on disk, changes logged, memory bounded for all stores of an executor; a store is closed when its
#: task has committed, as an open one takes 4 MB of local disk, whatever it holds.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}
#: Digests seen more than once that are sent to all executors (some 40 bytes each), as counted; beyond it rows are shuffled.
SENT = 500_000
#: Rows of one digest that are compared with one copy of the kept text; more rows get more copies.
SHARE = 1024


def _located(docs: DataFrame, digest: int) -> DataFrame:
    """(doc_id, text, digest, at): null texts as empty ones; at the locator, and `at` has no order of meaning but is total."""
    meta, text = docs.metadataColumn("_metadata"), F.coalesce(docs["text"], F.lit(""))
    at = F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row")).alias("at")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.substring(F.unhex(F.sha2(text, 256)), 1, digest).alias("digest"), at)


def _exactly(spark: SparkSession, path: str) -> str:
    """A pattern that only the path matches: a streaming source takes a single file by a pattern only."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return f"{path[:-1]}[{path[-1]}]" if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile() else path


def ingest(spark: SparkSession, path: str, folder: str, digest: int = DIGEST, files_at_once: int | None = None) -> None:
    """Run the Parquet files at `path` that the stream at `folder` has not seen through its state.

    `folder` is one of the shared store: it holds the stream's log and state and, as a table, what each batch changed.
    A batch that is run again replaces its own changes.
    """
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema(spark.read.parquet(path).schema)
        if files_at_once:
            source = source.option("maxFilesPerTrigger", files_at_once)
        rows = _located(source.parquet(_exactly(spark, path)), digest)
        state = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "at")).alias("keep"))
        write = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True)
        write.foreachBatch(lambda changed, batch: changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, n, keep): what the state at `folder` says now. Counts and kept rows only ever grow, so the last change has the largest."""
    changes = spark.read.schema("digest binary, n long, keep struct<doc_id: long, at: struct<file: string, row: long>>").parquet(f"{folder}/changes")
    return changes.groupBy("digest").agg(F.max("n").alias("n"), F.max("keep").alias("keep"))


def decide(docs: DataFrame, known: DataFrame, digest: int = DIGEST) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row for each row of `docs`, a table read from the files of `known`."""
    rows = _located(docs, digest)
    hits = cut(known.where("n > 1"))
    if hits.count() <= SENT:
        hits = F.broadcast(hits)
    rows = rows.join(hits, "digest", "left").withColumns({"n": F.coalesce("n", F.lit(1)), "keep": F.coalesce("keep", F.struct("doc_id", "at"))})
    out = ["doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").cast("long").alias("group_size"), (F.col("at") == F.col("keep.at")).alias("kept"), F.sha2("text", 256).alias("text_sha256")]
    single, repeated = rows.where("n = 1").select(*out), rows.where("n > 1")
    # Rows of a digest are dealt to as many copies of the kept text as its count asks for.
    shares = F.ceil(F.col("n") / SHARE).cast("int")
    kept = repeated.where("at = keep.at").select(F.col("digest").alias("d"), F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("s"))
    dealt = repeated.withColumn("share", F.pmod(F.xxhash64("at"), shares).cast("int"))
    checked = dealt.join(kept, (F.col("digest") == F.col("d")) & (F.col("share") == F.col("s")), "left").withColumn("same", F.col("text").eqNullSafe(F.col("kept_text")))
    checked = cut(checked.select("digest", "same", *out))
    odd = checked.where("not same").select("digest").distinct()
    if odd.isEmpty():
        return single.union(checked.drop("digest", "same"))
    # A collision: all rows of its digest are grouped by the whole text.
    odd = cut(odd)
    again = repeated.join(odd, "digest", "left_semi").select("doc_id", "at", "text")
    groups = again.groupBy("text").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "at")).alias("keep"))
    apart = again.join(groups, "text").select(*out)
    return single.union(checked.join(odd, "digest", "left_anti").drop("digest", "same")).union(apart)


def exact_duplicates(spark: SparkSession, path: str, digest: int = DIGEST) -> DataFrame:
    """Groups of equal texts among the documents in the Parquet file or folder `path`, by a stream from its beginning.

    Returns doc_id, keep_id (doc_id of the row that stays), group_size, kept and text_sha256; one row for each row. Texts
    are equal where all their bytes are; nothing is normalised. Null and empty texts are equal. Of equal texts the row with the
    largest doc_id stays, null ids being smallest; of rows equal in both the last by file and row, so of each group exactly one row
    is kept. Texts of any length are compared whole. Other columns are not looked at; an empty table gives no rows.
    """
    folder = f"{shared_folder(spark)}/exact-{uuid.uuid4().hex}"
    ingest(spark, path, folder, digest)
    known = cut(decisions(spark, folder)) if _has(spark, f"{folder}/changes") else spark.createDataFrame([], "digest binary, n long, keep struct<doc_id: long, at: struct<file: string, row: long>>")
    remove(spark, folder)
    return decide(spark.read.parquet(path), known, digest)


def _has(spark: SparkSession, folder: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`exact_duplicates` of all of the table `documents`."""
    return exact_duplicates(spark, f"{sf_dir}/documents.parquet")


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
