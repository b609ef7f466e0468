"""Classifier scores: tensors, tiles, and a scorer that loads its model once in each worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.sources.catalog import Preprocess

#: Nine tiles of 40 % at offsets 0, 0.3 and 0.6; smaller tiles than 32 pixels are left out.
TILES = tuple((x, y, 0.4, 0.4) for y in (0.0, 0.3, 0.6) for x in (0.0, 0.3, 0.6))
LEAST_TILE = 32


def tile_rects(width: int, height: int) -> list[tuple[int, int, int, int]]:
    """(left, top, width, height) in pixels of the tiles that are large enough."""
    rects = [(int(x * width), int(y * height), int(w * width), int(h * height)) for x, y, w, h in TILES]
    return [r for r in rects if r[2] >= LEAST_TILE and r[3] >= LEAST_TILE]


def tile_rows(images: DataFrame) -> DataFrame:
    """A row for each large enough tile of rows with id, width and height."""
    tiles = F.array(*[F.struct(F.lit(k).alias("tile"), *[F.lit(v).alias(n) for n, v in zip("xywh", t)]) for k, t in enumerate(TILES)])
    cut = lambda share, side: F.floor(F.col("t." + share) * F.col(side)).cast("int")
    rows = images.select("id", "width", "height", F.explode(tiles).alias("t"))
    rows = rows.select("id", "t.tile", cut("x", "width").alias("left"), cut("y", "height").alias("top"), cut("w", "width").alias("w"), cut("h", "height").alias("h"))
    return rows.where((F.col("w") >= LEAST_TILE) & (F.col("h") >= LEAST_TILE))


def tile_means(scores: DataFrame) -> DataFrame:
    """(id, tile_mean) of rows (id, score)."""
    return scores.groupBy("id").agg(F.avg("score").alias("tile_mean"))


def resize(pixels: np.ndarray, size: int) -> np.ndarray:
    """size x size by bilinear sampling at pixel centres."""
    h, w = pixels.shape[:2]
    axis = lambda n: np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
    y, x = axis(h), axis(w)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    p = pixels.astype(np.float32)
    top, bottom = p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx, p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx
    return (top * (1 - fy) + bottom * fy).astype(np.float32)


def tensor(pixels: np.ndarray, how: Preprocess) -> np.ndarray:
    """A model's input, 1 x 3 x size x size, of pixels (height, width, 3)."""
    x = resize(pixels, how.size) * np.float32(how.rescale)
    x = (x - np.array(how.mean, np.float32)) / np.array(how.std, np.float32)
    return np.ascontiguousarray(x.transpose(2, 0, 1)[None], dtype=np.float32)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max())
    return e / e.sum()


def scored(files: DataFrame, load: Callable[[], Callable[[np.ndarray], float] | None], decode: Callable[[bytes], np.ndarray | None], tiled: bool = True) -> DataFrame:
    """(id, nsfw_score, nsfw_tile_mean, error) of rows (id, content).

    load runs once in each worker and gives the scorer, or None where there is no model: then rows have
    nulls and say so. Failures are rows with an error, so one bad file stops nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for batch in batches:
            rows = []
            for i, content in zip(batch["id"], batch["content"]):
                whole = mean = error = None
                try:
                    pixels = decode(content) if score else None
                    if not score:
                        error = "no model"
                    elif pixels is None:
                        error = "not a picture that can be decoded"
                    else:
                        whole = float(score(pixels))
                        rects = tile_rects(pixels.shape[1], pixels.shape[0]) if tiled else []
                        mean = float(np.mean([score(pixels[t : t + h, x : x + w]) for x, t, w, h in rects])) if rects else None
                except Exception as e:  # counted by the caller
                    error = str(e)[:200]
                rows.append((i, whole, mean, error))
            yield pd.DataFrame(rows, columns=["id", "nsfw_score", "nsfw_tile_mean", "error"]).astype({"nsfw_score": "Float64", "nsfw_tile_mean": "Float64"})

    return files.select("id", "content").mapInPandas(run, "id long, nsfw_score double, nsfw_tile_mean double, error string")
