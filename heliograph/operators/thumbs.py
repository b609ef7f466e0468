"""Thumbnails and previews: pictures fitted within an edge, named by content."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Longest edges of thumbnails and previews.
THUMB, PREVIEW = 320, 1600


def encode_pgm(gray: np.ndarray) -> bytes:
    """A binary portable grey map; the default, as no picture codec is at hand."""
    h, w = gray.shape
    return f"P5 {w} {h} 255\n".encode() + np.clip(np.rint(gray), 0, 255).astype(np.uint8).tobytes()


def fitted(gray: np.ndarray, edge: int) -> np.ndarray:
    """Scaled down to a longest edge by means of boxes; smaller pictures stay as they are."""
    h, w = gray.shape
    scale = min(1.0, edge / max(h, w))
    if scale == 1.0:
        return gray
    new = max(1, int(h * scale)), max(1, int(w * scale))
    y, x = (np.arange(n + 1) * old // n for n, old in zip(new, (h, w)))
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = gray.cumsum(0, dtype=np.float64).cumsum(1)
    area = np.diff(y)[:, None] * np.diff(x)[None]
    return (total[y[1:]][:, x[1:]] - total[y[:-1]][:, x[1:]] - total[y[1:]][:, x[:-1]] + total[y[:-1]][:, x[:-1]]) / area


def thumbnails(files: DataFrame, decode: Callable[[bytes], np.ndarray | None], edge: int = THUMB, encode: Callable[[np.ndarray], bytes] = encode_pgm, suffix: str = ".pgm") -> DataFrame:
    """(path, thumb_path, thumb) of rows (path, content); thumb_path is sharded by the first two digits of the content's
    hash, so equal contents share one. Rows that can't be decoded have nulls. Write it with any Spark sink."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                digest = hashlib.sha256(content).hexdigest()
                try:
                    gray = decode(content)
                except Exception:  # a broken file has no thumbnail
                    gray = None
                rows.append((path, None, None) if gray is None else (path, f"{digest[:2]}/{digest}{suffix}", encode(fitted(gray, edge))))
            yield pd.DataFrame(rows, columns=["path", "thumb_path", "thumb"])

    return files.select("path", "content").mapInPandas(run, "path string, thumb_path string, thumb binary")
