"""Words of a batch of texts as arrays.

A word is a run of bytes other than space and 0x09-0x0D.  Texts are taken as
one UTF-8 buffer and cut by array operations; no word becomes a Python object
unless asked for.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Random odd code of each byte and the base of the polynomial word hash.
_CODE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes hashed at once.
_SPAN = 1 << 20


class Words(NamedTuple):
    data: np.ndarray  # the bytes
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    row: np.ndarray  # first word of each text, and the number of words

    def text(self, word: int) -> str:
        return self.data[self.start[word] : self.end[word]].tobytes().decode()

    def texts(self, which: np.ndarray) -> list[str]:
        """The words with these numbers; a line feed is in none of them."""
        if not len(which):
            return []
        size = self.end[which] - self.start[which] + 1
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1])) + np.repeat(self.start[which] - ends + size, size)
        data = self.data[np.minimum(at, len(self.data) - 1)]
        data[ends - 1] = 10
        return data[:-1].tobytes().decode().split("\n")

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.row) - 1), np.diff(self.row))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins; NULL is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[
        texts.offset : texts.offset + len(texts) + 1
    ]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def cut_words(texts: pa.Array, lower: bool = False) -> Words:
    """The words of each text; ``lower`` maps A-Z to a-z."""
    data, offsets = text_buffer(texts)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    ends[first[1:] - 1] = inside[first[1:] - 1]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def mix(value: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the result depend on all of the value."""
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < size:
        have = np.full(max(size, _SPAN + 1024), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if size <= _SPAN + 1024:
            _POWERS[base] = have
    return have[:size]


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every process."""
    out = np.empty(len(words.start), dtype=np.uint64)
    at = 0
    while at < len(out):
        base = words.start[at]
        stop = max(at + 1, int(np.searchsorted(words.end, base + _SPAN, "right")))
        span = words.data[base : words.end[stop - 1]]
        total = np.zeros(len(span) + 1, dtype=np.uint64)
        np.cumsum(_CODE[span] * _powers(_BASE, len(span)), out=total[1:])
        begin = words.start[at:stop] - base
        value = total[words.end[at:stop] - base] - total[begin]
        out[at:stop] = value * _powers(_INVERSE, len(span) + 1)[begin]
        at = stop
    return mix(out)


def chain(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive word hashes (one fewer than
    ``size`` shorter than the input); runs across texts are the caller's to drop."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, seed, dtype=np.uint64)
    for k in range(size):
        out *= np.uint64(_BASE)
        out += hashes[k : k + n]
    return mix(out)


def runs_inside(row: np.ndarray, size: int) -> np.ndarray:
    """For :func:`chain`: which runs lie inside one text."""
    n = int(row[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    left = np.repeat(row[1:], np.diff(row))[:n]
    return np.arange(n) + size <= left


def span_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of word hashes ``begin`` (included) to ``end`` (excluded)."""
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * _powers(_BASE, len(hashes)), out=total[1:])
    value = (total[end] - total[begin]) * _powers(_INVERSE, len(hashes) + 1)[begin]
    return mix(value + (end - begin).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
