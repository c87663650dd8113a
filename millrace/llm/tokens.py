"""Words as 64-bit hashes, computed over whole Arrow text buffers with numpy, and packed arrays of numbers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
#: What is left of eight bytes read at once when 0 to 8 of them belong to the word.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG = 64
_COMPRESS, _EXPAND = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets): text i has the words offsets[i] to offsets[i + 1]. Null text: no words.

    Words are stretches without space or code points 9 to 13; with `lower`, A to
    Z count as a to z. The hash chains scrambles of eight bytes at a time, from
    the word's length on; words of more than LONG bytes take BLAKE2b.
    """
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0] if n else np.zeros(1, "<i8")
    size = len(data)
    inside = ~_SPACE[data]
    # A position starts a word if the one before is white space or belongs to another text.
    cut = np.zeros(size + 1, bool)
    cut[bounds] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:size]
    end = inside
    end[:-1] &= ~inside[1:] | cut[1:size]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    return _hashes((_LOWER if lower else _SAME)[data], a, b), np.searchsorted(a, bounds).astype("<i8")


def _hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    wide = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = b - a
    h = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    rows = np.flatnonzero(size <= LONG)
    for at in range(0, LONG, 8):
        rows = rows[size[rows] > at]
        if not len(rows):
            break
        h[rows] = mix(h[rows] ^ (wide[a[rows] + at] & _MASK[np.minimum(size[rows] - at, 8)]))
    for i in np.flatnonzero(size > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[a[i] : b[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def _planes(x: np.ndarray, width: int) -> bytes:
    """Numbers as byte planes, lowest bytes first, compressed: high planes are mostly zero."""
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + _COMPRESS.compress(raw.tobytes())


def pack(x: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit numbers, as the planes of their differences."""
    return _planes(np.diff(x, prepend=np.uint64(0)), 8)


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(data).view(np.uint64), dtype=np.uint64)


def pack_ints(x: np.ndarray) -> bytes:
    """Numbers from 0 on, in as many planes as the largest needs."""
    return _planes(x, max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1)


def unpack_ints(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(_EXPAND.decompress(memoryview(data)[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").ravel()
