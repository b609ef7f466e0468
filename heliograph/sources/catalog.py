"""Reading a catalogue: scans, look-ups, settings."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from math import isfinite

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph import schema
from heliograph.functions.labels import pixels
from heliograph.functions.paths import in_scope
from heliograph.functions.scores import Rule


def scan(images: DataFrame, root: str | None = None) -> DataFrame:
    """All columns of the rows under a root, by id."""
    return images.where(in_scope(F.col("path"), root)).orderBy("id")


def detector_rows(images: DataFrame, root: str | None = None) -> DataFrame:
    """The eight columns that detectors use."""
    return images.where(in_scope(F.col("path"), root)).select(
        "id", "path", "phash", pixels(F.col("width"), F.col("height")).alias("pixels"), F.col("file_size").alias("bytes"),
        F.col("exif_taken").alias("taken"), F.col("exif_camera").alias("camera"), F.col("blur_score").alias("blur"),
    )


def by_ids(images: DataFrame, ids: list[int] | DataFrame) -> DataFrame:
    """Rows of the ids in their order, repeats kept and unknown ids dropped; column pos is the order.

    A list comes from the driver and is small by nature; larger orders are given as (pos, id) rows.
    """
    if not isinstance(ids, DataFrame):
        ids = images.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, id long")
    return ids.join(images, "id").orderBy("pos")


def path_index(images: DataFrame) -> DataFrame:
    return images.select("path", "id", pixels(F.col("width"), F.col("height")).alias("pixels"), F.col("file_size").alias("bytes"))


def pending_signatures(images: DataFrame, root: str | None = None) -> DataFrame:
    return images.where(F.col("phash").isNull() & in_scope(F.col("path"), root)).select("id", "path")


def pending_scores(images: DataFrame, root: str | None = None, ids: DataFrame | None = None, tiled: bool = True, rescore: bool = False) -> DataFrame:
    """Rows to classify: of the ids if given, else under the root; all of them if `rescore`."""
    rows = images.join(ids.select("id").distinct(), "id", "left_semi") if ids is not None else images.where(in_scope(F.col("path"), root))
    owed = F.col("nsfw_score").isNull() | (F.col("nsfw_tile_mean").isNull() if tiled else F.lit(False))
    return (rows if rescore else rows.where(owed)).select("id", "path").orderBy("id")


def meta(table: DataFrame) -> dict[str, str]:
    """The settings table, a handful of rows, as a dict."""
    return {row.key: row.value for row in table.collect()}


@dataclass(frozen=True)
class Settings:
    """Of the detectors. Out-of-range or malformed stored values fall back to these."""

    variant_enabled: bool = True
    variant_maxbits: int = 20
    variant_rotations: bool = True
    burst_windowsec: int = 3
    burst_maxbits: int = 60

    @property
    def covered(self) -> int:
        bits = schema.KIND_BITS
        return bits[schema.EXACT] | bits[schema.BURST] | (bits[schema.VARIANT] if self.variant_enabled else 0)


#: Keys of the stored settings, and the bounds of numbers.
_BOUNDS = {"variant_maxbits": (0, schema.BITS), "burst_windowsec": (0, 3600), "burst_maxbits": (0, schema.BITS)}


def load_settings(stored: dict[str, str]) -> Settings:
    out = {}
    for f in fields(Settings):
        text = stored.get("dedup." + f.name.replace("_", "."))
        if f.name in _BOUNDS:
            try:
                value = int(text)
            except (TypeError, ValueError):
                continue
            if _BOUNDS[f.name][0] <= value <= _BOUNDS[f.name][1]:
                out[f.name] = value
        elif text in ("0", "1"):
            out[f.name] = text == "1"
    return Settings(**out)


def save_settings(settings: Settings) -> dict[str, str]:
    return {"dedup." + f.name.replace("_", "."): str(int(getattr(settings, f.name))) for f in fields(Settings)}


def load_rule(stored: dict[str, str]) -> tuple[Rule, bool]:
    """The stored thresholds of the score, sanitised, and whether tiles are scored; what is missing or no number is the default."""
    values = {}
    for f in fields(Rule):
        try:
            values[f.name] = float(stored["score." + f.name.replace("_", ".")])
        except (KeyError, TypeError, ValueError):
            continue
    return Rule(**{k: v for k, v in values.items() if isfinite(v)}).sanitised(), stored.get("score.tiled", "1") == "1"


def save_rule(rule: Rule, tiled: bool = True) -> dict[str, str]:
    rule = rule.sanitised()
    return {"score." + f.name.replace("_", "."): repr(getattr(rule, f.name)) for f in fields(Rule)} | {"score.tiled": str(int(tiled))}


@dataclass(frozen=True)
class Preprocess:
    """How a classifier's input is made."""

    size: int = 224
    mean: tuple[float, ...] = (0.5, 0.5, 0.5)
    std: tuple[float, ...] = (0.5, 0.5, 0.5)
    rescale: float = 1 / 255

    @staticmethod
    def load(text: str) -> Preprocess:
        """From the JSON of a model's preprocessor; size is a number or has height or shortest_edge."""
        raw = json.loads(text)
        size = raw.get("size", 224)
        if isinstance(size, dict):
            size = size.get("height") or size.get("shortest_edge") or 224
        get = lambda k, d: tuple(raw.get(k) or d)
        return Preprocess(int(size), get("image_mean", Preprocess.mean), get("image_std", Preprocess.std), float(raw.get("rescale_factor") or Preprocess.rescale))


def footprint(images: DataFrame, stored: DataFrame) -> DataFrame:
    """photos, and bytes of the stored files (rows with file_size)."""
    one = F.lit(1).alias("one")
    stored = stored.agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"), one)
    return images.agg(F.count("*").alias("photos"), one).join(stored, "one").select("photos", "bytes")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stored catalogue; columns it was written without are null."""
    stored = spark.read.parquet(path)
    missing = [f for f in schema.IMAGES if f.name not in stored.columns]
    return stored.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
