"""Cutting lineage, and connected components of edge lists."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Write `df` into the shared checkpoint folder and go on from there.

    The folder is `shared_folder`. The files outlive any executor; they go when the session's application does
    where spark.cleaner.referenceTracking.cleanCheckpoints is set, else the folder's owner clears it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """`cut`, and Spark's estimate of the size is forgotten too; for tables that loops make of each other.

    A checkpoint keeps the estimate, and that of a join is the product of its sides, so from round to round its digits
    double, until the driver holds nothing else. Without one a table counts as large, until adaptive execution has its real size.
    """
    rows = cut(df)
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(rows._jdf.toJavaRDD(), rows._jdf.schema()), spark)


def released(spark: SparkSession) -> None:
    """Shuffle files that nothing refers to any more go now: Spark removes them when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def shuffled(df: DataFrame) -> DataFrame:
    """`df`, whose rows grow with the input, for a join: never sent to all executors by way of the driver.

    Spark estimates a table by its compressed files and an array as one element, and a checkpoint keeps that estimate, so a
    table of hundreds of MB can pass for a small one.
    """
    return df.hint("merge")


def tasks(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Only a session on one machine (local master) without either gets a temporary folder; a cluster without one is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="heliograph-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def children(spark: SparkSession, folder: str) -> list[str]:
    """Paths of what lies in a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return [str(x.getPath()) for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (node, root), root the smallest node reachable.

    Alternates the large-star and small-star steps, which end after O(log n) rounds and never
    hold a component in one task: each round is an aggregation with map-side minima and an
    equi-join that adaptive execution can split where one node has very many edges. Only the
    number of edges and a checksum reach the driver. Loops (a = b) are ignored; an empty edge
    list gives no rows.
    """
    edges = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.where("u != v").distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1000003).cast("decimal(38,0)"))).first()
    return row[0], row[1]
