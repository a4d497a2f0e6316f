"""64-bit hashes of words and word runs, vectorised; used inside Arrow functions."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words that a task remembers at most before it starts anew.
REMEMBERED = 300_000
#: White space by byte, the bytes of a word that a load of eight holds by its length, and the
#: length from which words are hashed one at a time.
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_HELD = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_LONG = 256


class WordHash(dict):
    """Word to 64-bit hash, remembered per task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n word hashes, in order."""
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = mix(out) * _STEP + h[i : len(h) - n + 1 + i]
    return mix(out + np.uint64(n))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of every word of ``words``, in order, eight bytes of all words at once."""
    raw = text.encode("utf-8", "surrogatepass").lower() if text else b""
    word = np.zeros(len(raw) + 2, bool)
    np.logical_not(_SPACE[np.frombuffer(raw, np.uint8)], out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[0::2], edges[1::2]
    size = ends - starts
    load = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))
    h = mix(load[starts] & _HELD[np.minimum(size, 8)])
    for at in range(8, min(_LONG, int(size.max(initial=0))), 8):
        rest = np.flatnonzero(size > at)
        h[rest] = mix(h[rest] * _STEP + (load[starts[rest] + at] & _HELD[np.minimum(size[rest] - at, 8)]))
    h = mix(h + size.astype(np.uint64) * _STEP)
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]])
    return h


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted set of hashes of runs of n words; fewer words are one run; none is empty."""
    h = word_hashes(text)
    if not len(h):
        return np.empty(0, np.uint64)
    s = np.sort(runs(h, min(n, len(h))))
    return s[np.append(True, s[1:] != s[:-1])]
