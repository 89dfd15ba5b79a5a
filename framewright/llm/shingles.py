"""Word and shingle fingerprints of whole texts, vectorised inside a task.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.  A word's
64-bit fingerprint mixes its bytes in, eight at a time; long words are hashed by
BLAKE2.  A shingle's is a mixed combination of its words'.  Equality of sets is
equality of fingerprints: two different 5-word sequences share one with
probability 2**-64.
"""

from __future__ import annotations

import hashlib

import numpy as np

_RNG = np.random.default_rng(7)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Texts are hashed in pieces of about this many bytes, so that work arrays stay small.
PIECE = 1 << 20
#: Longer words are hashed one by one.
LONG_WORD = 64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_COEF = (_RNG.integers(1, 2**63, 8, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
WIDTH = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Spans of a byte array, A-Z lower-cased, eight bytes at a time."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self.low = np.append(_LOWER[data], np.zeros(8, np.uint8))
        self.eight = np.ndarray((len(data) + 1,), "<u8", self.low, strides=(1,))
        self.start, self.size = start, end - start

    def chunk(self, which: np.ndarray, j: int) -> np.ndarray:
        """The j-th eight bytes of some spans that reach that far, zeros after their end."""
        return self.eight[self.start[which] + 8 * j] & _MASK[np.minimum(self.size[which] - 8 * j, 8)]

    def bytes(self, i: int) -> bytes:
        return self.low[self.start[i] : self.start[i] + self.size[i]].tobytes()

    def hashes(self) -> np.ndarray:
        out = self.size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(LONG_WORD // 8):
            live = np.flatnonzero((self.size > 8 * j) & (self.size <= LONG_WORD))
            if not len(live):
                break
            out[live] = mix(out[live] * np.uint64(0xD6E8FEB86659FD93) ^ self.chunk(live, j))
        for i in np.flatnonzero(self.size > LONG_WORD).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.bytes(i), digest_size=8).digest(), "little")
        return out

    def equal(self, other: np.ndarray) -> bool:
        """Whether every span has the bytes of the span that ``other`` names."""
        if (self.size != self.size[other]).any():
            return False
        for j in range(LONG_WORD // 8):
            live = np.flatnonzero((self.size > 8 * j) & (self.size <= LONG_WORD))
            if len(live) and (self.chunk(live, j) != self.chunk(other[live], j)).any():
                return False
        return all(self.bytes(i) == self.bytes(other[i]) for i in np.flatnonzero(self.size > LONG_WORD).tolist())


def _piece_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return Spans(data, edge[::2], edge[1::2]).hashes(), edge[::2]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, start) of every word of a byte array of any length, taken in pieces that end at blanks."""
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        to = at + PIECE
        while to < len(data):
            space = np.flatnonzero(_SPACE[data[to : to + PIECE]])
            if len(space):
                to += int(space[0])
                break
            to += PIECE
        h, s = _piece_words(data[at:to])
        hashes.append(h)
        starts.append(s + at)
        at = to
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of all texts one after another, count per text)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    words, starts = word_hashes(data)
    first = np.searchsorted(starts, begin)
    out, sizes = [], np.zeros(len(texts), np.int64)
    if len(words) >= WIDTH:
        rolled = words[: len(words) - WIDTH + 1] * _COEF[0]
        for k in range(1, WIDTH):
            rolled = rolled + words[k : len(words) - WIDTH + 1 + k] * _COEF[k]
        rolled = mix(rolled)
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b - a >= WIDTH:
            found = np.sort(rolled[a : b - WIDTH + 1])
            found = found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) > 1 else found
        elif b > a:
            few = words[a:b]
            found = mix((few * _COEF[: b - a]).sum(keepdims=True) + _COEF[5] * np.arange(1, 5, dtype=np.uint64)[b - a - 1 : b - a])
        else:
            continue
        sizes[i] = len(found)
        out.append(found)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def in_slices(texts: list, most: int = 2 << 20):
    """Runs of consecutive texts of about ``most`` bytes in all: (from, to)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
