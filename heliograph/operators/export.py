"""Exports: where each row goes, what that takes, the journal and its manifest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions.paths import file_name, in_scope, scope_bounds

#: Fixed value: numbers tried for a name that is taken.
LAST_NUMBER = 9999
SAMPLE_ROWS = 5


def directory(structure: str, destination: str, source_root: str = "") -> Column:
    """flat: the destination; mirror: as under the source root; date: year/year-month, or undated."""
    if structure == "date":
        t = F.timestamp_seconds("exif_taken")
        tail = F.coalesce(F.concat(F.date_format(t, "yyyy"), F.lit("/"), F.date_format(t, "yyyy-MM")), F.lit("undated"))
        return F.concat(F.lit(destination + "/"), tail)
    if structure == "mirror":
        bounds = scope_bounds(source_root)
        inside = F.substring(F.col("path"), F.lit(len(bounds[0]) + 1 if bounds else 1), F.length("path"))
        relative = F.when(in_scope(F.col("path"), source_root), F.regexp_replace(inside, "/?[^/]*$", "")).otherwise(F.lit(""))
        return F.when(relative == "", F.lit(destination)).otherwise(F.concat(F.lit(destination + "/"), relative))
    return F.lit(destination)


def resolve(names: list[str], hashes: list[str], taken: dict[str, str] | None = None) -> list[tuple[str | None, bool]]:
    """(name, whether an identical file is there already) in turn; name None where all numbers are taken.

    For each name the next number to try and the slots passed so far are remembered, so no slot is tried twice.
    """
    there, out = dict(taken or {}), []
    tries: dict[str, tuple[Iterator[str], dict[str, str]]] = {}
    for name, content in zip(names, hashes):
        if name not in tries:
            tries[name] = _slots(name), {}
        slots, passed = tries[name]
        slot = passed.get(content)
        while slot is None and (slot := next(slots, "")) in there:
            passed.setdefault(there[slot], slot)
            slot = slot if there[slot] == content else None
        if slot and slot not in there:
            there[slot], passed[content] = content, slot
            out.append((slot, False))
        else:
            out.append((slot or None, bool(slot)))
    return out


def _slots(name: str) -> Iterator[str]:
    dot = name.rfind(".")
    stem, ext = (name[:dot], name[dot:]) if dot >= 0 else (name, "")
    yield name
    yield from (f"{stem} ({n}){ext}" for n in range(2, LAST_NUMBER + 1))


def plan(rows: DataFrame, structure: str, destination: str, source_root: str = "", existing: DataFrame | None = None) -> DataFrame:
    """image_id, dest_path, status (copy, skipped, failed) of rows (id, path, content_hash, exif_taken), by id.

    Names are settled by window: within a folder and name, different contents are numbered by first
    appearance and repeats are skipped. Names that could meet a numbered one (they end in a number in
    brackets), and folders where files exist, are settled in turn instead, folder and stem at a time.
    existing: path and content_hash of files at the destination.
    """
    unknown = F.concat(F.lit("unknown "), F.col("id").cast("string"))  # never taken for a copy
    rows = rows.select("id", F.coalesce("content_hash", unknown).alias("content"), directory(structure, destination, source_root).alias("dir"), file_name(F.col("path")).alias("name"))
    family = F.regexp_replace(F.regexp_replace("name", r"(\.[^.]*)$", ""), r"( \(\d+\))+$", "")
    ext = F.regexp_extract("name", r"(\.[^.]*)$", 1)
    rows = rows.withColumn("family", F.concat_ws("\0", family, ext))
    hard = rows.where(F.col("name").rlike(r" \(\d+\)(\.[^.]*)?$")).select("dir", "family").distinct()
    if existing is not None:
        found = existing.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), file_name(F.col("path")).alias("name"), F.col("content_hash").alias("content"))
        found = found.withColumn("family", F.concat_ws("\0", family, ext))
        hard = hard.unionByName(found.select("dir", "family")).distinct()
    easy = rows.join(hard, ["dir", "family"], "left_anti")
    heads = easy.groupBy("dir", "name", "content").agg(F.min("id").alias("first"))  # so a window holds contents, not rows
    heads = heads.withColumn("slot", F.row_number().over(Window.partitionBy("dir", "name").orderBy("first")))
    first = easy.join(heads, ["dir", "name", "content"])
    stem, tail = F.regexp_replace("name", r"(\.[^.]*)$", ""), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    slot = F.when(F.col("slot") == 1, F.col("name")).otherwise(F.concat(stem, F.lit(" ("), F.col("slot").cast("string"), F.lit(")"), tail))
    status = F.when(F.col("slot") > LAST_NUMBER, "failed").when(F.col("id") == F.col("first"), "copy").otherwise("skipped")
    out = first.select(F.col("id").alias("image_id"), F.when(F.col("slot") <= LAST_NUMBER, F.concat("dir", F.lit("/"), slot)).alias("dest_path"), status.alias("status"))
    turns = rows.join(hard, ["dir", "family"], "left_semi").select("dir", "family", "id", "name", "content")
    if existing is not None:
        turns = turns.unionByName(found.join(hard, ["dir", "family"], "left_semi").select("dir", "family", F.lit(None).cast("long").alias("id"), "name", "content"))

    def in_turn(frame: pd.DataFrame) -> pd.DataFrame:
        there = frame[frame["id"].isna()]
        own = frame[frame["id"].notna()].sort_values("id")
        settled = resolve(own["name"].tolist(), own["content"].tolist(), dict(zip(there["name"], there["content"])))
        state = ["failed" if n is None else "skipped" if skip else "copy" for n, skip in settled]
        paths = [None if n is None else f"{d}/{n}" for d, (n, _) in zip(own["dir"], settled)]
        return pd.DataFrame({"image_id": own["id"].astype("int64"), "dest_path": paths, "status": state})

    return out.unionByName(turns.groupBy("dir", "family").applyInPandas(in_turn, "image_id long, dest_path string, status string"))


def preflight(rows: DataFrame, structure: str, destination: str, source_root: str = "", hardlink: bool = False, free: int | None = None) -> DataFrame:
    """One row: files, bytes, enough (null free space counts as enough), and folders of the first five rows."""
    total = rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"), F.lit(1).alias("one"))
    few = rows.orderBy("id").limit(SAMPLE_ROWS).select(directory(structure, destination, source_root).alias("dir")).distinct()
    samples = few.agg(F.sort_array(F.collect_list("dir")).alias("samples"), F.lit(1).alias("one"))
    enough = F.lit(True) if hardlink or free is None else F.col("bytes") < free
    return total.join(samples, "one").select("files", "bytes", enough.alias("enough"), "samples")


def effective_mode(mode: str, same_volume: bool) -> str:
    return "copy" if mode == "hardlink" and not same_volume else mode


def remaining(planned: DataFrame, journal: DataFrame, run: int) -> DataFrame:
    """What a run that is resumed still has to do: planned rows that the journal doesn't have as settled."""
    settled = journal.where((F.col("run_id") == run) & F.col("status").isin("verified", "skipped")).select("image_id")
    return planned.join(settled, "image_id", "left_anti")


def verified(planned: DataFrame, found: DataFrame, run: int, by_size: bool = False) -> DataFrame:
    """Journal rows of a run: planned rows against what is at their destinations (path and content_hash, or
    file_size for links). A copy counts only if its content is what it should be."""
    fact = "file_size" if by_size else "content_hash"
    there = found.select(F.col("path").alias("dest_path"), F.col(fact).alias("there"))
    joined = planned.join(there, "dest_path", "left")
    ok = F.coalesce(F.col("there") == F.col(fact), F.lit(False))
    status = F.when(F.col("status") != "copy", F.col("status")).when(ok, "verified").otherwise("failed")
    error = F.when((F.col("status") == "copy") & ~ok, F.when(F.col("there").isNull(), "missing").otherwise("differs"))
    reason = F.when(F.col("status") == "skipped", "identical file exists")
    return joined.select(F.lit(run).cast("long").alias("run_id"), "image_id", "dest_path", status.alias("status"), reason.alias("skip_reason"), error.alias("error"))


def run_status(journal: DataFrame) -> DataFrame:
    """run_id, exported, skipped, failed, status: done if nothing failed, else partial."""
    counts = [F.count_if(F.col("status") == s).alias(n) for s, n in (("verified", "exported"), ("skipped", "skipped"), ("failed", "failed"))]
    return journal.groupBy("run_id").agg(*counts).withColumn("status", F.when(F.col("failed") == 0, "done").otherwise("partial"))


def to_recycle(rejected: DataFrame, journal: DataFrame, run: int) -> DataFrame:
    """Rejects to recycle once a run has settled its keepers, also where some of them failed; none before it has any."""
    ran = journal.where(F.col("run_id") == run).limit(1).select(F.lit(1).alias("one"))
    return rejected.withColumn("one", F.lit(1)).join(F.broadcast(ran), "one", "left_semi").drop("one")


def manifest(journal: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, status, source, destination, detail; '' for what there is not."""
    sources = images.select(F.col("id").alias("image_id"), F.col("path").alias("source"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    joined = journal.join(sources, "image_id", "left")
    return joined.select("image_id", "status", blank(F.col("source")).alias("source"), blank(F.col("dest_path")).alias("destination"), blank(F.coalesce("skip_reason", "error")).alias("detail"))


def csv_quote(c: Column) -> Column:
    """Quoted only where a comma, a quote or a line feed asks for it."""
    return F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def write_manifest(rows: DataFrame, folder: str) -> None:
    """The manifest as CSV lines with a header, and as JSON, one object a line."""
    ordered = rows.orderBy("image_id")
    ordered.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{folder}/csv")
    ordered.write.json(f"{folder}/json")
