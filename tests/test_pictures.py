"""What picture files say of themselves, of files made here by hand."""

import itertools
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.functions.signals import decode_pgm, orient, signature, box_sample
from heliograph.sources.pictures import analyse, exif, exif_block, header, metadata

COLUMNS = "path string, content binary"


def block(order=">", make=None, model=None, turn=None, modified=None, original=None, digitized=None, size=None, pad=0):
    """A TIFF block with what is given; `pad` bytes stand before the main directory."""
    at = 8 + pad

    def directory(entries, at):
        entries = sorted(entries)
        tail_at, body, tail = at + 2 + 12 * len(entries) + 4, struct.pack(order + "H", len(entries)), b""
        for tag, kind, value in entries:
            data = value.encode() + b"\0" if kind == 2 else struct.pack(order + {3: "H", 4: "I"}[kind], value)
            field = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(order + "I", tail_at + len(tail))
            tail += data if len(data) > 4 else b""
            body += struct.pack(order + "HHI", tag, kind, len(data) if kind == 2 else 1) + field
        return body + b"\0\0\0\0" + tail

    main = [(t, k, v) for t, k, v in ((0x10F, 2, make), (0x110, 2, model), (0x112, 3, turn), (0x132, 2, modified), *(((0x100, 4, size[0]), (0x101, 3, size[1])) if size else ())) if v is not None]
    sub = [(t, 2, v) for t, v in ((0x9003, original), (0x9004, digitized)) if v is not None]
    if sub:
        length = len(directory([*main, (0x8769, 4, 0)], at))
        return b"".join([b"II*\0" if order == "<" else b"MM\0*", struct.pack(order + "I", at), b"x" * pad, directory([*main, (0x8769, 4, at + length)], at), directory(sub, at + length)])
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at) + b"x" * pad + directory(main, at)


def segment(marker, data):
    return bytes([0xFF, marker]) + struct.pack(">H", len(data) + 2) + data


def jpeg(data=None, size=(40, 30), before=b"", frame=0xC0):
    app = segment(0xE1, b"Exif\0\0" + data) if data is not None else b""
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0") + before + app + segment(0xC4, b"\0" * 9) + segment(frame, struct.pack(">BHH", 8, size[1], size[0]) + b"\1") + b"\xff\xda\0\2pixels\xff\xd9"


def png(data=None, size=(40, 30)):
    chunk = lambda name, x: struct.pack(">I", len(x)) + name + x + struct.pack(">I", zlib.crc32(name + x))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", *size, 8, 0, 0, 0, 0)) + chunk(b"IDAT", b"p" * 33) + (chunk(b"eXIf", data) if data is not None else b"") + chunk(b"IEND", b"")


def webp(data=None, size=(40, 30), preamble=b""):
    chunk = lambda name, x: name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2)
    body = b"WEBP" + chunk(b"VP8X", b"\x08\0\0\0" + (size[0] - 1).to_bytes(3, "little") + (size[1] - 1).to_bytes(3, "little")) + chunk(b"ALPH", b"odd") + (chunk(b"EXIF", preamble + data) if data is not None else b"")
    return b"RIFF" + struct.pack("<I", len(body)) + body


WRAPS = {"jpeg": jpeg, "png": png, "webp": webp, "webp with preamble": lambda d, s=(40, 30): webp(d, s, b"Exif\0\0"), "tiff": lambda d, s=None: d}
WHEN = ("2021:03:04 05:06:07", "2020:01:02 03:04:05", "2019:10:11 12:13:14")


@pytest.mark.parametrize("wrap", WRAPS)
def test_tags_of_every_container(wrap):
    """Either byte order, any place of the directory, any of the tags absent."""
    for order, pad, bits in itertools.product("<>", (0, 3, 200), range(64)):
        given = {k: v for n, (k, v) in enumerate([("make", "Acme"), ("model", "A"), ("turn", 6), ("modified", WHEN[2]), ("original", WHEN[0]), ("digitized", WHEN[1])]) if bits >> n & 1}
        got = exif(WRAPS[wrap](block(order, pad=pad, **given)))
        assert got == {k: given.get({"orientation": "turn"}.get(k, k)) for k in got}


def test_headers():
    for size in ((1, 1), (40, 30), (5000, 7)):
        assert header(jpeg(size=size)) == header(jpeg(size=size, frame=0xC2)) == ("JPEG", *size)
        assert header(png(size=size)) == ("PNG", *size)
        assert header(webp(size=size)) == ("WEBP", *size)
        assert header(block("<", size=size)) == header(block(">", size=size, pad=5)) == ("TIFF", *size)
        assert header(b"GIF89a" + struct.pack("<HH", *size)) == ("GIF", *size)
        assert header(b"BM" + b"\0" * 16 + struct.pack("<ii", size[0], -size[1])) == ("BMP", *size)
    lossy = b"WEBPVP8 " + struct.pack("<I", 10) + b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 40 | 1 << 14, 30)
    lossless = b"WEBPVP8L" + struct.pack("<I", 5) + b"\x2f" + struct.pack("<I", 39 | 29 << 14)
    assert header(b"RIFF\0\0\0\0" + lossy) == header(b"RIFF\0\0\0\0" + lossless) == ("WEBP", 40, 30)
    assert header(b"") == header(b"text") == (None, None, None) and header(png(size=(0, 4))) == ("PNG", None, None)


def test_first_block_counts_and_other_segments_are_passed():
    first, second = block(make="First"), block(make="Second")
    assert exif_block(jpeg(second, before=segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0") + b"\xff\xff" + segment(0xE1, b"Exif\0\0" + first)[1:])) == first
    assert exif_block(jpeg()) == exif_block(png()) == exif_block(webp()) == exif_block(b"") == b""
    hidden = jpeg() + segment(0xE1, b"Exif\0\0" + first)  # after the first scan
    assert exif_block(hidden) == b""


@pytest.mark.parametrize("wrap", WRAPS)
def test_damaged_files_give_what_is_whole(wrap):
    """Cut anywhere or with any bytes changed: no error, and no text that isn't in the file."""
    whole = WRAPS[wrap](block("<", make="Acme Works", model="A 100", turn=3, original=WHEN[0], modified=WHEN[2]))
    full = exif(whole)
    for n in range(len(whole)):
        got = exif(whole[:n])
        header(whole[:n])
        assert all(got[k] in (None, full[k]) for k in full)
    draw = random.Random(11)
    for _ in range(3000):
        data = bytearray(whole)
        for _ in range(draw.randint(1, 4)):
            data[draw.randrange(len(data))] = draw.choice((0, 1, 255, draw.randrange(256)))
        header(bytes(data)), exif(bytes(data))


def test_directories_that_point_at_themselves_or_outside():
    data = bytearray(block(">", make="Acme", original=WHEN[0]))
    entry = data.index(b"\x87\x69\0\4")
    for at in (8, 0, 1 << 31, (1 << 32) - 1, len(data), len(data) - 1):
        data[entry + 8 : entry + 12] = struct.pack(">I", at)
        assert exif(bytes(data)) | {"original": None} == exif(bytes(data)) and exif(bytes(data))["make"] == "Acme"
    wide = b"MM\0*" + struct.pack(">IH", 8, 65535) + struct.pack(">HHII", 0x10F, 2, (1 << 32) - 1, 8)
    assert exif(wide)["make"] is None


def test_metadata_follows_the_rules(spark):
    rows = [
        ("/original", jpeg(block(make="Acme", model="ACME A1", turn=6, original=WHEN[0], digitized=WHEN[1], modified=WHEN[2]))),
        ("/digitized", png(block("<", make=" Acme ", model="B2", turn=1, original="0000:00:00 00:00:00", digitized=WHEN[1], modified=WHEN[2]))),
        ("/modified", webp(block(model="  ", turn=9, original="?", modified=WHEN[2]))),
        ("/forms", block("<", make="Acme", original="2021-03-04T05:06:07", size=(9, 4))),
        ("/none", jpeg()), ("/text", b"not a picture"), ("/empty", b""), ("/null", None), (None, jpeg()), ("/none", jpeg()),
    ]
    out = metadata(spark.createDataFrame([(*r, 7) for r in rows], COLUMNS + ", format int"))
    got = sorted((tuple(r) for r in out.collect()), key=str)
    want = [
        ("/original", "JPEG", 30, 40, 6, 1614834367, "ACME A1"), ("/digitized", "PNG", 40, 30, 1, 1577934245, "Acme B2"), ("/modified", "WEBP", 40, 30, 1, 1570795994, None),
        ("/forms", "TIFF", 9, 4, 1, 1614834367, "Acme"), ("/none", "JPEG", 40, 30, 1, None, None), ("/text", None, None, None, 1, None, None), ("/empty", None, None, None, 1, None, None),
        ("/null", None, None, None, 1, None, None), (None, "JPEG", 40, 30, 1, None, None), ("/none", "JPEG", 40, 30, 1, None, None),
    ]
    assert got == sorted(want, key=str)
    assert metadata(spark.createDataFrame([], COLUMNS)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_every_orientation_has_the_signature_of_the_upright_picture(spark):
    """Pixels stored in each of the eight ways, tagged as such, decoded as stored."""
    upright = np.random.default_rng(5).integers(0, 256, (51, 34)).astype(np.float32)
    stored = {1: upright, 2: upright[:, ::-1], 3: upright[::-1, ::-1], 4: upright[::-1], 5: upright.T, 6: np.rot90(upright, 1), 7: upright[::-1, ::-1].T, 8: np.rot90(upright, -1)}
    assert all((orient(x, k) == upright).all() for k, x in stored.items())

    def decode(content: bytes):  # pixels follow the file's tags
        at = content.find(b"P5")
        return decode_pgm(content[at:]) if at >= 0 else None

    def file(k, x):
        return jpeg(block(turn=k), x.shape[::-1]) + f"P5 {x.shape[1]} {x.shape[0]} 255\n".encode() + x.astype(np.uint8).tobytes()

    rows = [(f"/{k}", 5, 6, file(k, x)) for k, x in stored.items()] + [("/broken", 1, 2, jpeg(block(turn=8, make="Acme"))), ("/cut", 1, 2, jpeg() + b"P5 9 9 255\n..")]
    out = {r.path: r for r in analyse(spark.createDataFrame(rows, "path string, file_size long, mtime long, content binary"), decode, 77).collect()}
    want = signature(box_sample(upright))
    for k in stored:
        r = out[f"/{k}"]
        assert (r.width, r.height, r.phash, r.error, r.analyzed_at, r.file_size, r.mtime) == (34, 51, want, None, 77, 5, 6) and r.blur_score == pytest.approx(out["/1"].blur_score)
    assert (out["/broken"].width, out["/broken"].height, out["/broken"].exif_camera, out["/broken"].phash) == (30, 40, "Acme", None) and out["/broken"].error
    assert out["/cut"].error and out["/cut"].width == 40 and len(out["/cut"].content_hash) == 64


def test_files_of_a_folder(spark, tmp_path):
    from heliograph.operators.catalog import upsert
    from heliograph.schema import IMAGES
    from heliograph.sources.files import listing, supported

    (tmp_path / "in").mkdir()
    (tmp_path / "a.jpg").write_bytes(jpeg(block(make="Acme", original=WHEN[0])))
    (tmp_path / "in" / "b.png").write_bytes(png(block(turn=5, digitized=WHEN[1])))
    (tmp_path / "c.txt").write_bytes(b"text")
    rows = analyse(supported(listing(spark, str(tmp_path))), lambda content: None, 3)
    merged = upsert(spark.createDataFrame([], IMAGES), rows.drop("error"))
    got = {r.path[len(str(tmp_path)) :]: (r.width, r.height, r.exif_taken, r.exif_camera, r.format) for r in merged.collect()}
    assert got == {"/a.jpg": (40, 30, 1614834367, "Acme", "JPEG"), "/in/b.png": (30, 40, 1577934245, None, "PNG")}
    assert rows.where(F.col("error").isNull()).count() == 0
