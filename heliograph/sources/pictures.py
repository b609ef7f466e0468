"""What picture files say of themselves: format, dimensions, and EXIF, read from their bytes without a codec.

`header` and `exif` look at one file's bytes. Every offset and length in a file is held against what is there: an entry
that points outside is absent, a directory that is cut short gives its whole entries, and no directory is read twice. A
file that is none of the known formats, or empty, has nulls.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions import labels
from heliograph.functions.signals import blur_score, box_sample, orient, signature

#: Tags of the main directory, of its pointer to the EXIF directory, and of that directory.
IMAGE_WIDTH, IMAGE_HEIGHT, MAKE, MODEL, ORIENTATION, MODIFIED, EXIF_IFD = 0x0100, 0x0101, 0x010F, 0x0110, 0x0112, 0x0132, 0x8769
ORIGINAL, DIGITIZED = 0x9003, 0x9004
#: Bytes of a value of each type.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
#: JPEG markers that start a frame (not the tables DHT, JPG and DAC between them), and those without a length.
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
BARE = frozenset([0x01, *range(0xD0, 0xD9)])

_HEAD = b"Exif\0\0"
_META = "path string, format string, width int, height int, orientation int, make string, model string, original string, digitized string, modified string"
_SIGNALS = "blur_score double, phash array<long>, error string"


def _segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start, end) of the segments of a JPEG up to its first scan."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:  # fill bytes
            at += 1
        elif marker in BARE:
            at += 2
        else:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if marker in (0xD9, 0xDA) or size < 2:
                return
            yield marker, at + 4, min(at + 2 + size, len(data))
            at += 2 + size


def _chunks(data: bytes, at: int, png: bool) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks of a PNG (length, name, data, checksum) or a RIFF file (name, length, data, even)."""
    while at + 8 <= len(data):
        name, size = (data[at + 4 : at + 8], int.from_bytes(data[at : at + 4], "big")) if png else (data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little"))
        yield name, at + 8, min(at + 8 + size, len(data))
        at += 8 + size + (4 if png else size % 2)


def _directory(block: bytes, at: int, order: str) -> dict[int, int | str]:
    """The texts and whole numbers of the directory at `at`, by tag; of a tag that comes twice the first."""
    found: dict[int, int | str] = {}
    if not 0 < at <= len(block) - 2:
        return found
    for k in range(struct.unpack_from(order + "H", block, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 12 > len(block):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", block, entry)
        size = TYPE_BYTES.get(kind, 0) * count
        start = entry + 8 if size <= 4 else struct.unpack_from(order + "I", block, entry + 8)[0]
        if not size or start + size > len(block) or tag in found:
            continue
        if kind == 2:
            found[tag] = block[start : start + size].split(b"\0")[0].decode("utf-8", "replace")
        elif kind in (1, 3, 4):
            found[tag] = struct.unpack_from(order + {1: "B", 3: "H", 4: "I"}[kind], block, start)[0]
    return found


def _tiff(block: bytes) -> tuple[dict[int, int | str], dict[int, int | str]]:
    """The main and the EXIF directory of a TIFF block."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(block[:4])
    if order is None or len(block) < 8:
        return {}, {}
    first = struct.unpack_from(order + "I", block, 4)[0]
    main = _directory(block, first, order)
    at = main.get(EXIF_IFD)
    return main, _directory(block, at, order) if isinstance(at, int) and at != first else {}


def exif_block(data: bytes) -> bytes:
    """The TIFF block of a JPEG, PNG, WebP or TIFF file; of several the first. Empty where there is none."""
    if data[:2] == b"\xff\xd8":
        found = (data[a + 6 : b] for m, a, b in _segments(data) if m == 0xE1 and data[a : a + 6] == _HEAD)
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        found = (data[a:b] for name, a, b in _chunks(data, 8, True) if name == b"eXIf")
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        found = (data[a + 6 if data[a : a + 6] == _HEAD else a : b] for name, a, b in _chunks(data, 12, False) if name == b"EXIF")
    else:
        return data if data[:4] in (b"II*\0", b"MM\0*") else b""
    return next(found, b"")


def _webp_size(data: bytes) -> tuple[int, int] | None:
    for name, a, b in _chunks(data, 12, False):
        x = data[a:b]
        if name == b"VP8X" and len(x) >= 10:
            return int.from_bytes(x[4:7], "little") + 1, int.from_bytes(x[7:10], "little") + 1
        if name == b"VP8 " and len(x) >= 10 and x[3:6] == b"\x9d\x01\x2a":
            return tuple(v & 0x3FFF for v in struct.unpack_from("<HH", x, 6))
        if name == b"VP8L" and len(x) >= 5 and x[0] == 0x2F:
            bits = int.from_bytes(x[1:5], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    return None


def header(data: bytes) -> tuple[str | None, int | None, int | None]:
    """(format, width, height) as stored, before the orientation is applied; nulls where the file doesn't say."""
    size, name = None, None
    if data[:2] == b"\xff\xd8":
        name, frame = "JPEG", next((a for m, a, b in _segments(data) if m in FRAMES and b - a >= 5), None)
        size = struct.unpack_from(">HH", data, frame + 1)[::-1] if frame else None
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        name, size = "PNG", struct.unpack_from(">II", data, 16) if len(data) >= 24 and data[12:16] == b"IHDR" else None
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        name, size = "WEBP", _webp_size(data)
    elif data[:6] in (b"GIF87a", b"GIF89a"):
        name, size = "GIF", struct.unpack_from("<HH", data, 6) if len(data) >= 10 else None
    elif data[:2] == b"BM":
        name, size = "BMP", tuple(map(abs, struct.unpack_from("<ii", data, 18))) if len(data) >= 26 else None
    elif data[:4] in (b"II*\0", b"MM\0*"):
        main = _tiff(data)[0]
        name, size = "TIFF", (main.get(IMAGE_WIDTH), main.get(IMAGE_HEIGHT))
    elif data[:2] in (b"P5", b"P6"):
        name = "PGM"
    sides = [v if isinstance(v, int) and 0 < v < 1 << 31 else None for v in size or (None, None)]
    return name, *(sides if None not in sides else (None, None))


def exif(data: bytes) -> dict[str, int | str | None]:
    """orientation (1 to 8, else null), make, model, and the three times as they are written."""
    main, sub = _tiff(exif_block(data))
    text = lambda tags, tag: tags[tag] if isinstance(tags.get(tag), str) else None
    turn = main.get(ORIENTATION)
    return {
        "orientation": turn if isinstance(turn, int) and 1 <= turn <= 8 else None, "make": text(main, MAKE), "model": text(main, MODEL),
        "original": text(sub, ORIGINAL), "digitized": text(sub, DIGITIZED), "modified": text(main, MODIFIED),
    }


def _facts(path: str | None, data: bytes | None) -> dict:
    """One row of _META: width and height are those of the picture as it is shown."""
    data = data or b""
    name, width, height = header(data)
    tags = exif(data)
    if (tags["orientation"] or 1) >= 5:
        width, height = height, width
    return {"path": path, "format": name, "width": width, "height": height, **tags}


def _run(files: DataFrame, schema: str, row: Callable[[str | None, bytes | None], dict], *carried: str) -> DataFrame:
    """`row` of each (path, content) by the columns of `schema`, and the columns `carried`; a batch's files are taken one
    by one, and results go out 1,000 at most at a time."""
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    target = pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                out = pa.RecordBatch.from_pylist([row(p.as_py(), c.as_py()) for p, c in zip(part["path"], part["content"])], schema=target)
                yield pa.RecordBatch.from_arrays([*out.columns, *(part[c] for c in carried)], names=[*target.names, *carried])

    rows = files.select("path", "content", *carried)
    return rows.mapInArrow(run, ", ".join([schema, *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried)]))


def _rules(rows: DataFrame, *more: str) -> DataFrame:
    """exif_taken and exif_camera by the column rules."""
    taken, camera = labels.taken(F.col("original"), F.col("digitized"), F.col("modified")), labels.camera(F.col("make"), F.col("model"))
    return rows.select("path", "format", "width", "height", F.coalesce("orientation", F.lit(1)).alias("orientation"), taken.alias("exif_taken"), camera.alias("exif_camera"), *more)


def metadata(files: DataFrame) -> DataFrame:
    """path, format, width, height, orientation, exif_taken, exif_camera of files (path, content).

    width and height are those of the picture upright. A file that says nothing, can't be understood, is empty or null
    has nulls and orientation 1. Rows that repeat a path stay rows of their own; other columns are not looked at; an
    empty table gives no rows. Narrow: nothing is shuffled.
    """
    return _rules(_run(files, _META, _facts))


def analyse(files: DataFrame, decode: Callable[[bytes], np.ndarray | None], now: int = 0) -> DataFrame:
    """Catalogue rows of files (path, file_size, mtime, content), and error: content hash, what the file says of itself,
    and the signals of its pixels upright, all by one reading.

    decode gives grey values as stored, height by width, or None. Each signal is best effort: a file that can't be decoded
    keeps its hash, its dimensions and its EXIF, and has an error; a failure drops no row.
    """

    def row(path: str | None, data: bytes | None) -> dict:
        out = _facts(path, data) | {"blur_score": None, "phash": None, "error": None}
        try:
            gray = decode(data or b"")
            if gray is None:
                return out | {"error": "not a picture that can be decoded"}
            gray = orient(gray, out["orientation"] or 1)
            return out | {"width": gray.shape[1], "height": gray.shape[0], "blur_score": blur_score(gray), "phash": signature(box_sample(gray))}
        except Exception as e:  # a broken file is a row of the result, not a failed job
            return out | {"error": str(e)[:200]}

    own = ["content_hash", "file_size", "mtime"]
    rows = _run(files.withColumn("content_hash", F.sha2("content", 256)), f"{_META}, {_SIGNALS}", row, *own)
    return _rules(rows, *own, "blur_score", "phash", "error").drop("orientation").withColumn("analyzed_at", F.lit(now).cast("long"))
