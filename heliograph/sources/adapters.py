"""Views of the test tables in the schema of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.signals import signature_column

#: Documents as catalogue rows, in SQL that Spark and DuckDB both run over views documents and labels.
CATALOGUE_SQL = """
SELECT d.doc_id AS id, '/lib/' || d.source || '/' || d.lang || '/' || CAST(d.doc_id AS VARCHAR(20)) || '.txt' AS path,
  {sha}(d.text{bits}) AS content_hash, d.n_chars AS file_size, 1600000000 + d.doc_id * 60 AS mtime,
  CAST(100 + d.n_chars % 640 AS INT) AS width, CAST(100 + d.n_chars % 480 AS INT) AS height, 'TXT' AS format,
  CASE WHEN l.toxic IS NULL THEN NULL WHEN l.toxic = 1 THEN 0.9E0 WHEN l.quality = 0 THEN 0.6E0 ELSE 0.1E0 END AS nsfw_score,
  CASE WHEN l.toxic IS NULL OR d.doc_id % 3 = 0 THEN NULL WHEN d.doc_id % 10 = 1 THEN 0.62E0 ELSE 0.2E0 END AS nsfw_tile_mean,
  CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE CAST(d.n_chars % 250 AS DOUBLE) END AS blur_score,
  CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE 1500000000 + (d.doc_id % 1000) * 200000 END AS exif_taken,
  CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE d.source END AS exif_camera,
  CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE CAST(1700000000 AS BIGINT) END AS analyzed_at,
  CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE CAST(1700000100 AS BIGINT) END AS dupe_checked_at,
  CAST(CASE WHEN d.doc_id % 4 = 0 THEN 0 WHEN d.doc_id % 2 = 0 THEN 5 ELSE 7 END AS INT) AS dupe_checked_kinds
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def catalogue_sql(duckdb: bool) -> str:
    return CATALOGUE_SQL.format(sha="sha256" if duckdb else "sha2", bits="" if duckdb else ", 256")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = catalogue_sql(False).replace("FROM documents d LEFT JOIN labels l", "FROM {documents} d LEFT JOIN {labels} l")
    return spark.sql(sql, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"), labels=spark.read.parquet(f"{sf_dir}/labels.parquet"))


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 64 numbers of each embedding as an 8 x 8 grey grid: id, phash (one word a turn), bytes."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("id"), signature_column(F.col("embedding"), 8).alias("phash"), F.col("label").cast("long").alias("bytes"))


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as photos: id, camera, taken (whole seconds), phash of one word a turn made of the value."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    word = F.floor(F.col("value") * 1000).cast("long")
    return rows.select(
        F.col("event_id").alias("id"), F.concat(F.lit("/shots/"), F.col("event_id").cast("string")).alias("path"), F.col("user_id").cast("string").alias("camera"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("taken"), F.array(word, word, word, word).alias("phash"), F.col("value").alias("blur"), word.alias("bytes"), F.lit(1).cast("long").alias("pixels"),
    )


def order_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as photos with full signatures: id and 20 words, alike for the orders of one customer but for up to two
    bits that the order sets in the upright turn."""
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("o_orderkey") % n).cast("int"))
    word = lambda k: F.xxhash64(F.col("o_custkey"), F.lit(k)).bitwiseAND((1 << 16) - 1 if k % 5 == 4 else -1)
    words = [word(0).bitwiseXOR(bit(64)), word(1).bitwiseXOR(bit(61)), *[word(k) for k in range(2, 20)]]
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.array(*words).alias("phash"))
