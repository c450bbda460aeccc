"""Words and word n-grams of a batch of texts as 64-bit hashes, in numpy.

A batch is one byte buffer, texts parted by newlines. Words are maximal runs of
bytes of a class (bytes from 0x80 up always belong to words, so runs of bytes
are runs of code points). A word's hash is a polynomial over its bytes, taken
from prefix sums, then mixed; n-grams combine word hashes. Whole texts are
read; long buffers are hashed in pieces cut between words.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes hashed at once; the tables of powers and the arrays of a piece stay below a few MB each.
_PIECE = 1 << 19
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def byte_class(outside: str) -> np.ndarray:
    """True for the bytes of words; outside: the other characters, all ASCII."""
    inside = np.ones(256, bool)
    inside[[ord(c) for c in outside]] = False
    return inside


#: Words are runs of anything but ASCII white space.
BY_SPACE = byte_class("\x20\x09\x0a\x0b\x0c\x0d")
#: Words are runs of ASCII letters and digits and of all other characters from U+0080 up.
ALPHANUMERIC = byte_class("".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (public-domain splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    up = _powers(1 << 16, _BASE)
    down = _powers(1 << 16, pow(_BASE, -1, 1 << 64))

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = _powers(size, _BASE), _powers(size, pow(_BASE, -1, 1 << 64))
        return cls.up, cls.down


def words(texts: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text); A-Z are lower-cased."""
    data = b"\n".join(texts).translate(_LOWER) + b"\n"
    buffer = np.frombuffer(data, np.uint8)
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    hashes, starts, at = [], [], 0
    while at < len(buffer):
        end = min(at + _PIECE, len(buffer))
        if end < len(buffer):
            gaps = np.flatnonzero(~inside[buffer[at:end]])
            while not len(gaps):  # one word longer than a piece
                end = min(end + _PIECE, len(buffer))
                gaps = np.flatnonzero(~inside[buffer[at:end]])
            end = at + int(gaps[-1]) + 1
        piece = buffer[at:end]
        change = np.diff(inside[piece].view(np.int8), prepend=np.int8(0), append=np.int8(0))
        s, e = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        up, down = _Tables.upto(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        at = end
    starts = np.concatenate(starts)
    return np.concatenate(hashes), np.diff(np.searchsorted(starts, edges))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words, texts not minded: entry i covers words i to i + n - 1."""
    size = max(len(hashes) - n + 1, 0)
    out = np.full(size, n, np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD1342543DE82EF95) + hashes[j : j + size]
    return mix(out)


def pieces(texts: list[bytes], most: int = 1 << 20):
    """Ranges of texts of about `most` bytes together, so that arrays stay small."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield first, i
            first, total = i, 0
        total += len(t) + 1
    if first < len(texts):
        yield first, len(texts)
