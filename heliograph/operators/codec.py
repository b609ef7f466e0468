"""Payloads behind pictures: zip, encryption, and the footer that says where they are."""

from __future__ import annotations

import hashlib
import io
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the formats.
FOOTER_MAGIC, FOOTER = b"SNZC", 13
VERSION, SALT, NONCE, TAG, KEY, MOST_ITERATIONS = 1, 16, 12, 16, 32, 10_000_000
HEADER = 1 + 4 + SALT + NONCE + TAG
ENTRY_BYTES, TOTAL_BYTES = 2_000_000_000, 4_000_000_000
LAST_NUMBER = 9999
_FORBIDDEN = set('/\\:*?"<>|\0')


def embed(carrier: Column, payload: Column, encrypted: Column) -> Column:
    """carrier, payload, magic, flag, big-endian length."""
    flag = F.when(encrypted, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    size = F.unhex(F.lpad(F.hex(F.octet_length(payload).cast("long")), 16, "0"))
    return F.concat(carrier, payload, F.lit(bytearray(FOOTER_MAGIC)), flag, size)


def extract(content: Column) -> Column:
    """struct(payload, encrypted, error): error says why there is none."""
    n = F.octet_length(content)
    foot = F.substring(content, F.greatest(n - (FOOTER - 1), F.lit(1)), F.lit(FOOTER))
    magic = F.hex(F.substring(foot, 1, 4)) == FOOTER_MAGIC.hex().upper()
    digits = F.hex(F.substring(foot, 6, 8))
    size = F.when(F.substring(digits, 1, 8) == "00000000", F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")).otherwise(F.lit(1 << 40))
    start = n - FOOTER - size
    error = F.when((n < FOOTER) | ~magic, F.lit("no hidden data")).when(start < 0, F.lit("hidden data corrupted"))
    payload = F.when(error.isNull(), F.substring(content, (start + 1).cast("int"), size.cast("int")))
    return F.struct(payload.alias("payload"), (F.hex(F.substring(foot, 5, 1)) != "00").alias("encrypted"), error.alias("error"))


def derive_key(passphrase: str, salt: bytes, iterations: int) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode("utf-8"), salt, iterations, KEY)


def _keys(passphrase: str):
    @F.pandas_udf(T.BinaryType())
    def key(salt: pd.Series, iterations: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or n is None or not 0 < n <= MOST_ITERATIONS else derive_key(passphrase, s, int(n)) for s, n in zip(salt, iterations)], dtype=object)

    return key


@F.pandas_udf(T.BinaryType())
def _random(n: pd.Series) -> pd.Series:
    return pd.Series([os.urandom(int(k)) for k in n], dtype=object)


def encrypt(rows: DataFrame, passphrase: str, iterations: int = 600_000, column: str = "payload") -> DataFrame:
    """`rows` with the column encrypted: version, iterations, salt, nonce, tag, text. AES-GCM runs in the JVM."""
    rows = rows.withColumns({"_salt": _random.asNondeterministic()(F.lit(SALT)), "_nonce": _random.asNondeterministic()(F.lit(NONCE))})
    rows = rows.withColumn("_key", _keys(passphrase)(F.col("_salt"), F.lit(iterations)))
    sealed = F.aes_encrypt(F.col(column), F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), F.col("_nonce"))  # nonce, text, tag
    n = F.octet_length("_sealed")
    text, tag = F.substring("_sealed", F.lit(NONCE + 1), n - NONCE - TAG), F.substring("_sealed", n - (TAG - 1), F.lit(TAG))
    head = F.lit(bytearray([VERSION]) + bytearray(iterations.to_bytes(4, "big")))
    return rows.withColumn("_sealed", sealed).withColumn(column, F.concat(head, F.col("_salt"), F.col("_nonce"), tag, text)).drop("_salt", "_nonce", "_key", "_sealed")


def decrypt(rows: DataFrame, passphrase: str, column: str = "payload") -> DataFrame:
    """`rows` with the column decrypted and `error` where that can't be (version, damage, passphrase)."""
    c = F.col(column)
    iterations = F.conv(F.hex(F.substring(c, 2, 4)), 16, 10).cast("long")
    salt, nonce, tag = F.substring(c, 6, SALT), F.substring(c, 6 + SALT, NONCE), F.substring(c, 6 + SALT + NONCE, TAG)
    text = F.substring(c, F.lit(HEADER + 1), F.greatest(F.octet_length(c) - HEADER, F.lit(0)))
    shape = F.when(F.octet_length(c) < HEADER, "corrupted").when(F.hex(F.substring(c, 1, 1)) != f"{VERSION:02X}", "unknown version").when((iterations == 0) | (iterations > MOST_ITERATIONS), "corrupted")
    rows = rows.withColumn("_shape", shape).withColumn("_key", _keys(passphrase)(F.when(F.col("_shape").isNull(), salt), F.when(F.col("_shape").isNull(), iterations)))
    rows = rows.withColumn("_plain", F.when(F.col("_shape").isNull(), F.try_aes_decrypt(F.concat(nonce, text, tag), F.col("_key"), F.lit("GCM"))))
    error = F.coalesce(F.col("_shape"), F.when(F.col("_plain").isNull(), F.lit("wrong passphrase or corrupted")))
    return rows.withColumn(column, F.col("_plain")).withColumn("error", error).drop("_shape", "_key", "_plain")


def unique_name(name: str, taken: set[str]) -> str:
    """`name`, or `stem (n).ext` with the first free n from 2; taken holds names in upper case."""
    if name.upper() not in taken:
        return name
    stem, ext = os.path.splitext(name)
    for n in range(2, LAST_NUMBER + 1):
        if (other := f"{stem} ({n}){ext}").upper() not in taken:
            return other
    raise OSError(f"no free name for {name}")


def make_zip(files: list[tuple[str, bytes]]) -> bytes:
    out, taken = io.BytesIO(), set()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for path, content in files:
            name = unique_name(path.replace("\\", "/").rsplit("/", 1)[-1], taken)
            taken.add(name.upper())
            archive.writestr(zipfile.ZipInfo(name), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def open_zip(data: bytes, entry_bytes: int = ENTRY_BYTES, total_bytes: int = TOTAL_BYTES) -> list[tuple[str, bytes]]:
    """Entries by name. Names with folders or forbidden characters, and sizes beyond the bounds, are errors."""
    out, total, taken = [], 0, set()
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for info in archive.infolist():
            name = info.filename.rsplit("/", 1)[-1]
            if not name or _FORBIDDEN & set(name):
                raise ValueError(f"invalid entry name: {info.filename!r}")
            with archive.open(info) as f:
                content = f.read(min(entry_bytes, total_bytes - total) + 1)
            if len(content) > entry_bytes or total + len(content) > total_bytes:
                raise ValueError("implausible entry size")
            total += len(content)
            name = unique_name(name, taken)
            taken.add(name.upper())
            out.append((name, content))
    return out


def zipped(files: DataFrame) -> DataFrame:
    """(batch, payload): the files (batch, path, content) of each batch in one archive, by path. A batch is one hidden
    payload, which must fit in a cell; it is what a user hides at once, so its size is small by nature."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("path")
        return pd.DataFrame({"batch": [frame["batch"].iloc[0]], "payload": [make_zip(list(zip(frame["path"], frame["content"])))]})

    return files.select("batch", "path", "content").groupBy("batch").applyInPandas(run, "batch string, payload binary")


#: Bytes of opened entries that a task holds before it passes them on; an archive's own entries are held at once.
HELD = 16_000_000


def opened(frames: Iterator[pd.DataFrame], entry_bytes: int = ENTRY_BYTES, total_bytes: int = TOTAL_BYTES) -> Iterator[pd.DataFrame]:
    """The entries of all archives (batch, payload), passed on as soon as there are `HELD` bytes of them."""
    columns = ["batch", "name", "content", "error"]
    for frame in frames:
        rows, size = [], 0
        for batch, payload in zip(frame["batch"], frame["payload"]):
            try:
                found = open_zip(payload, entry_bytes, total_bytes)
                rows += [(batch, n, c, None) for n, c in found]
                size += sum(len(c) for _, c in found)
            except (ValueError, OSError, zipfile.BadZipFile) as e:
                rows.append((batch, None, None, str(e)))
            if size >= HELD:
                yield pd.DataFrame(rows, columns=columns)
                rows, size = [], 0
        yield pd.DataFrame(rows, columns=columns)


def unzipped(payloads: DataFrame, entry_bytes: int = ENTRY_BYTES, total_bytes: int = TOTAL_BYTES) -> DataFrame:
    """(batch, name, content, error): an archive's entries, or one row that says what is wrong with it."""
    run = lambda frames: opened(frames, entry_bytes, total_bytes)
    return payloads.select("batch", "payload").mapInPandas(run, "batch string, name string, content binary, error string")
