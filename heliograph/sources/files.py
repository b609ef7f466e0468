"""Files under a root, and what is known of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.paths import extension, in_scope

#: File types that are decoded, and types that are recognised but can't be.
DECODED = ("JPG", "JPEG", "PNG", "WEBP", "GIF", "BMP", "TIF", "TIFF")
RECOGNISED = ("HEIC", "HEIF", "AVIF", "CR2", "CR3", "NEF", "ARW", "DNG", "ORF", "RW2", "RAF", "SRW", "PEF")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, file_size, mtime (unix seconds), content of all files under `root`.

    Columns that are not selected are not read, so select before a join: content is the file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", r"^file:/+", "/")
    return files.select(path.alias("path"), F.col("length").alias("file_size"), F.unix_seconds("modificationTime").alias("mtime"), "content")


def supported(files: DataFrame, types: tuple[str, ...] = DECODED) -> DataFrame:
    return files.where(extension(F.col("path")).isin(*types))


def unsupported_counts(files: DataFrame, types: tuple[str, ...] = RECOGNISED) -> DataFrame:
    """extension and n of recognised files that can't be decoded, most first."""
    ext = extension(F.col("path"))
    return files.where(ext.isin(*types)).groupBy(ext.alias("extension")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "extension")


def probe(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """`files` with status: cached (analysed, same size and second), changed or new.

    Only three columns of the catalogue are read, none of the content of files.
    """
    known = catalogue.select("path", F.col("file_size").alias("known_size"), F.col("mtime").alias("known_mtime"), F.col("analyzed_at").isNotNull().alias("analysed"))
    same = F.coalesce(F.col("analysed") & (F.col("known_size") == F.col("file_size")) & (F.col("known_mtime") == F.col("mtime")), F.lit(False))
    status = F.when(same, "cached").when(F.col("known_size").isNotNull(), "changed").otherwise("new")
    return files.join(known, "path", "left").withColumn("status", status).drop("known_size", "known_mtime", "analysed")


def rescan(files: DataFrame, catalogue: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """One folder anew, the session's root left alone: its files with their status, and the catalogue without its rows
    whose files are gone. Rows beyond the folder stay as they are."""
    from heliograph.operators.catalog import prune

    here = files.where(in_scope(F.col("path"), folder))
    return probe(here, catalogue.where(in_scope(F.col("path"), folder))), prune(catalogue, here.select("path"), folder)


def failure_reasons(failures: DataFrame, first: int = 8) -> DataFrame:
    """reason, n, and the first paths of each reason with how many more there are; most first."""
    from pyspark.sql import Window

    order = Window.partitionBy("reason").orderBy("path")
    top = failures.withColumn("k", F.row_number().over(order)).where(F.col("k") <= first)
    paths = top.groupBy("reason").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    counts = failures.groupBy("reason").agg(F.count("*").alias("n"))
    return counts.join(paths, "reason").withColumn("more", F.greatest(F.col("n") - first, F.lit(0))).orderBy(F.desc("n"), "reason")


def failing_folders(failures: DataFrame) -> DataFrame:
    from heliograph.functions.paths import folder_of

    return failures.agg(F.count_distinct(folder_of(F.col("path"))).alias("folders"))
