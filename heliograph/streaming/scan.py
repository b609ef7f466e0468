"""The incremental scan as a stream (an extension): new files arrive, the catalogue's next version is written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.functions.labels import format_eta
from heliograph.operators.catalog import publish, upsert
from heliograph.sources.files import supported

BINARY = "path string, modificationTime timestamp, length long, content binary"


def listing_stream(spark: SparkSession, root: str) -> DataFrame:
    """New files under a root as they come: path, file_size, mtime, content."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").load(root)
    return supported(files.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), F.col("length").alias("file_size"), F.unix_seconds("modificationTime").alias("mtime"), "content"))


def merge_stream(files: DataFrame, analyse: Callable[[DataFrame], DataFrame], current: Callable[[], DataFrame], folder: str, publish_path: Callable[[str], None], checkpoint: str):
    """Analyse each batch of files and publish the catalogue merged with it. A batch that is run again merges to the same
    rows, as paths are keys."""

    def step(batch: DataFrame, epoch: int) -> None:
        publish_path(publish(upsert(current(), analyse(batch)), folder))

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of events (ts, event_type) by window and type, with a watermark; batch frames work the same."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n")


def seconds_left(progress: DataFrame, total: int, window: int = 4000) -> DataFrame:
    """`progress` (job, ms, done) with eta, the seconds left by the rate over the last `window` milliseconds; null where
    that can't be said. The form of `Eta` for logs of many jobs."""
    recent = Window.partitionBy("job").orderBy("ms").rangeBetween(-window, 0)
    first = F.first(F.struct("ms", "done")).over(recent)
    elapsed, more = F.col("ms") - first["ms"], F.col("done") - first["done"]
    rate = more / (elapsed / 1000)
    known = (elapsed > 0) & (more > 0) & (F.col("done") < total)
    return progress.withColumn("eta", F.when(known, (total - F.col("done")) / rate))


class Eta:
    """Time left by the rate over the samples of the last `window` milliseconds."""

    def __init__(self, window: int = 4000):
        self.window, self.samples = window, []

    def add(self, now: int, done: int, total: int) -> float | None:
        """Seconds left, or None where that can't be said."""
        self.samples.append((now, done))
        while len(self.samples) > 1 and now - self.samples[0][0] > self.window:
            self.samples.pop(0)
        elapsed, more = now - self.samples[0][0], done - self.samples[0][1]
        if total <= 0 or done >= total or elapsed <= 0 or more <= 0:
            return None
        return (total - done) / (more / (elapsed / 1000))

    format = staticmethod(format_eta)
