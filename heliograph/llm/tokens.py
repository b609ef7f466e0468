"""Token ids by a vocabulary file of the tokenizers library, in packed form."""

from __future__ import annotations

import functools
import os
import sys
from array import array

import numpy as np
import pyarrow as pa
import zstandard

#: Parts whose ids a process remembers at most (some 200 bytes each), and their longest.
REMEMBERED, LONGEST = 600_000, 32
#: Texts that are encoded at once.
ENCODED = 4096
#: Lead bytes of characters among which there is white space.
_WHITE_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each two bytes whether a word surely ends between them, for each byte whether it is ASCII white space, and the length
    of the character that it begins, 0 where that could be white space."""
    byte = np.arange(256)
    letter = ((byte | 0x20) >= 0x61) & ((byte | 0x20) <= 0x7A) & (byte < 0x80)
    digit, white = (byte >= 0x30) & (byte <= 0x39), np.isin(byte, [0x20, 0x09, 0x0A, 0x0D])
    mark = (byte > 0x20) & (byte < 0x7F) & ~letter & ~digit
    ends = np.outer(letter, digit | mark | white) | np.outer(digit, letter | mark | white) | np.outer(mark, white)
    lead = (byte >= 0xC3) & ~np.isin(byte, _WHITE_LEADS)
    return ends.ravel(), white, np.where(lead, 2 + (byte >= 0xE0) + (byte >= 0xF0), 0)


_ENDS, _WHITE, _SIZE = _tables()


def _cuts(data: np.ndarray) -> np.ndarray:
    """Where a byte-level word surely begins in UTF-8: after an ASCII letter, digit or mark, or a character that is no white space.

    No such word has a letter, a digit or anything but white space before something of another kind, but for marks before letters,
    and none looks behind; so the ids of a text are those of its parts one after another. What is not cut only makes a part longer.
    """
    pairs = (data[:-1].astype(np.uint16) << 8) | data[1:]
    found = _ENDS[pairs]
    at = np.flatnonzero(_WHITE[data[1:]] & (data[:-1] >= 0x80)) + 1
    for size in (2, 3, 4):
        found[at[(_SIZE[data[np.maximum(at - size, 0)]] == size)] - 1] = True
    return np.flatnonzero(found) + 1


class Encoder:
    """Ids of texts as little-endian bytes, two to an id where the vocabulary allows it, else four.

    All ids are the tokenizers library's. Where the file is a plain byte-level one, texts are cut where words surely begin,
    and the library encodes the different parts of a batch in one call, but for those whose ids the process
    remembers, also from task to task; with any other file it encodes whole texts. Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        self.vocabulary = t.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        before, added = t.pre_tokenizer, t.get_added_tokens_decoder().values()
        byte_level = isinstance(before, pre_tokenizers.ByteLevel) and before.use_regex and not before.add_prefix_space
        self.cut = byte_level and t.normalizer is None and all(x.special for x in added)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.dtype.itemsize == 2 else "I"
        out = [array(kind, x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if sys.byteorder == "big":
            for x in out:
                x.byteswap()
        return [x.tobytes() for x in out]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; none for a null or empty one."""
        if not self.cut:
            several = [*{x for x in texts if x}]
            ids = dict(zip(several, self._ids(several)))
            return [ids[x] if x else b"" for x in texts]
        whole = pa.array([x or "" for x in texts], pa.large_string())
        ends = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1)
        data = whole.buffers()[2]
        if not ends[-1]:
            return [b""] * len(texts)
        bounds = np.zeros(ends[-1] + 1, bool)
        bounds[_cuts(np.frombuffer(data, np.uint8, ends[-1]))] = True
        bounds[ends] = True
        bounds = np.flatnonzero(bounds)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), data]).dictionary_encode()
        ids = pa.array(self._known(parts.dictionary.to_pylist()), pa.large_binary()).take(parts.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[np.searchsorted(bounds, ends)].tolist()
        out = memoryview(ids.buffers()[2])
        return [out[s:e].tobytes() for s, e in zip(at, at[1:])]

    def _known(self, parts: list[bytes]) -> list[bytes]:
        """The ids of different parts. Of what is remembered the half that was not asked for lately goes when there is too much."""
        if len(self.known) > REMEMBERED // 2:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        out = [known.get(x) for x in parts]
        missing = [k for k, x in enumerate(out) if x is None]
        fresh = []
        for k in missing:
            if (x := before.get(parts[k])) is None:
                fresh.append(k)
            else:
                out[k] = known[parts[k]] = x
        for k, x in zip(fresh, self._ids([parts[k].decode("utf-8") for k in fresh])):
            out[k] = x
            if len(parts[k]) <= LONGEST:
                known[parts[k]] = x
        return out

    def __call__(self, text: str | None) -> bytes:
        return self.batch([text])[0]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The process's encoder for a vocabulary file."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def press(ids: bytes, dtype: np.dtype) -> bytes:
    """Ids on their way through a shuffle or checkpoint; the first byte is the size of an id."""
    return bytes([dtype.itemsize]) + _zstd()[0].compress(ids)


def unpress(data: bytes) -> np.ndarray:
    return np.frombuffer(_zstd()[1].decompress(data[1:]), f"<u{data[0]}")
