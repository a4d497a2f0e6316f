"""Number arrays as compressed bytes, and the exchange of keys that several operators use."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(x: np.ndarray) -> bytes:
    """Bytes of an integer array: equal bytes of neighbours side by side, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T) if len(x) else np.empty(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def pack_sorted(x: np.ndarray) -> bytes:
    """A sorted array of unsigned numbers, by differences."""
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def text_bytes(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def bytes_text(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def slices(keys: np.ndarray, parts: int):
    """(part, begin, end) of a sorted key array, cut into equal ranges of the key space."""
    edges = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    for r in range(parts):
        if cuts[r] < cuts[r + 1]:
            yield r, cuts[r], cuts[r + 1]
