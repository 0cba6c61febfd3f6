"""Word and shingle hashes of whole Arrow text columns, as numpy arrays.

Texts stay UTF-8 bytes. A word is a longest run of bytes that are no separators; its hash is a sum of random per-byte numbers times
powers of an odd constant, modulo 2^64, mixed at the end. Texts are hashed piece by piece, cut between words, so memory stays at a
few times the text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
_STEP = 0x9E3779B97F4A7C15

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes above 127 belong to letters of other scripts more often than not and so count as word bytes.
NOT_WORD = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the output."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Hasher:
    """Hashes words of byte buffers; keeps its power tables, so make one per task."""

    def __init__(self, separators: np.ndarray = SPACES, lower: bool = True):
        self.separators = separators
        with np.errstate(over="ignore"):
            self.byte = mix((np.arange(1, 257, dtype=np.uint64)) * np.uint64(_STEP))
        if lower:
            self.byte = self.byte[_LOWER]
        self._grow(PIECE + 4096)

    def _grow(self, n: int) -> None:
        self.up, self.down = _powers(_STEP, n), _powers(pow(_STEP, -1, 1 << 64), n)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, byte behind, and hash of each word, in order. `offsets` bound the texts in `data`."""
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        parts, a, n = [], 0, len(data)
        while a < n:
            b = min(a + PIECE, n)
            while b < n:  # no word is cut
                cut = self.separators[data[b : b + 4096]] | first[b : min(b + 4096, n)]
                k = int(cut.argmax())
                if cut[k]:
                    b += k
                    break
                b = min(b + 4096, n)
            parts.append(self._piece(data[a:b], first[a : b + 1], a))
            a = b
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _piece(self, data: np.ndarray, first: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(data) > len(self.up):
            self._grow(len(data))
        inside = ~self.separators[data]
        before, behind = np.empty(len(data), bool), np.empty(len(data), bool)
        before[0], behind[-1] = False, False
        before[1:], behind[:-1] = inside[:-1], inside[1:]
        starts = np.flatnonzero(inside & (~before | first[:-1]))
        ends = np.flatnonzero(inside & (~behind | first[1:])) + 1
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.byte[data] * self.up[: len(data)], out=total[1:])
            h = (total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)
        return starts + at, ends + at, mix(h)


#: Scripts written without spaces: each character is a word.
_UNSPACED = [(0x0E00, 0x1100), (0x1780, 0x1800), (0x3005, 0x3008), (0x3040, 0x3130), (0x31A0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0xFF66, 0xFF9E), (0x20000, 0x40000)]
_LETTER, _SIGN, _SINGLE = 0, 1, 2


@cache
def _kinds() -> np.ndarray:
    """Kind of each code point: in words, a sign between words (punctuation, symbols, spaces), or a word of its own."""
    kind = np.zeros(0x110000, np.uint8)
    for a, b in _UNSPACED:
        kind[a:b] = _SINGLE
    for c in range(0x80, 0x20000):
        if unicodedata.category(chr(c))[0] in "PSZ" or c < 0xA0 or c in (0x200B, 0x2060, 0xFEFF):
            kind[c] = _SIGN
    return kind


def unicode_words(hasher: Hasher, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `hasher.words`, but words also end at signs beyond ASCII, and each character of a script without spaces is a word."""
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return hasher.words(data, offsets)
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    point = data[lead].astype(np.int64) & (0xFF >> (size + 1))
    for i in range(1, 4):
        more = size > i
        point[more] = point[more] << 6 | data[lead[more] + i] & 0x3F
    kind = _kinds()[point]
    sign, cut = kind == _SIGN, kind == _SINGLE
    if sign.any():
        data = data.copy()
        for i in range(4):
            data[lead[sign & (size > i)] + i] = 0x20
    return hasher.words(data, np.concatenate([offsets, lead[cut], lead[cut] + size[cut]]))


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, and their number per text.

    `hashes` are the words of all texts in order, `counts` the words of each. A text with fewer than k words, but one at least, has its
    whole sequence as its one shingle.
    """
    ends = np.cumsum(counts)
    begins = ends - counts
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.repeat(begins - (np.cumsum(made) - made), made) + np.arange(made.sum())
    short = np.repeat(counts < k, made)
    last = np.repeat(ends, made)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            word = padded[at + i]
            if short.any():
                word = np.where(at + i < last, word, np.uint64(0))
            out = mix(out * np.uint64(_STEP) + word + np.uint64(i + 1))
    return out, made


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column without copying; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with at most `most` bytes of text each, one row at least."""
    _, offsets = utf8(batch.column(column))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of words of each text."""
    return np.diff(np.searchsorted(starts, offsets))
