"""Vectorised words, rolling hashes and shingles over the texts of an Arrow batch.

Words are maximal runs of bytes other than blank, tab, line feed, vertical tab, form feed and
carriage return. Hashes have 64 bits and depend on content alone, never on position or batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are worked on in slices of about this many bytes, which bounds a task's memory.
SLICE_BYTES = 1 << 20

_U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15) + _U64(salt))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Everything but ASCII letters and the bytes of other characters.
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_BYTES = seeds(256, 1)
_LOWER = _BYTES.copy()
_LOWER[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, _U64), np.ones(1, _U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n; kept, because every slice needs them."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, factor in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, factor, _U64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=_U64)
    return _POWERS[0][:n], _POWERS[1][:n]


class Rolling:
    """Hashes of any spans of a sequence of 64-bit values, each in constant time."""

    def __init__(self, values: np.ndarray):
        powers, _ = _powers(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, _U64)
        np.cumsum(values * powers[: len(values)], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, inverse = _powers(len(self._sums))
        raw = (self._sums[ends] - self._sums[starts]) * inverse[starts]
        return mix(raw + (ends - starts).astype(_U64) * _U64(0xD1342543DE82EF95))


class Words:
    """The words of the texts in one slice.

    With ``letters``, words are runs of letters. ``first[d] : first[d + 1]`` are the words of text ``d``; ``begin`` and ``end`` are byte places.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, letters: bool = False):
        inside = ~(_NO_LETTER if letters else _SPACE)[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        edges = offsets[:-1][np.diff(offsets) > 0]
        before[edges] = False
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        self.begin = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.begin, offsets)
        self.counts = np.diff(self.first)
        # Hashes of any bytes of the slice.
        self.bytes = Rolling((_LOWER if lower else _BYTES)[data])
        self.hash = self.bytes(self.begin, self.end)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of ``length`` words, and each window's text."""
        n = np.maximum(self.counts - length + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        return self.first[text] + place, text

    def shingles(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingle hashes of every text, and the bounds of each text's run.

        A text with fewer words has one shingle, the whole sequence; one without words has none.
        """
        span = np.minimum(self.counts, length)
        n = np.where(span > 0, self.counts - span + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        starts = self.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        values = Rolling(self.hash)(starts, starts + span[text])
        bounds = np.concatenate([[0], np.cumsum(n)])
        for a, b in zip(bounds[:-1], bounds[1:]):
            values[a:b].sort()
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
        kept = np.zeros(len(values) + 1, np.int64)
        np.cumsum(fresh, out=kept[1:])
        return values[fresh], kept[bounds]


def column_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and the offsets of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(
    texts: pa.Array, lower: bool = False, most: int = SLICE_BYTES, letters: bool = False
) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for consecutive runs of rows of about ``most`` bytes."""
    if not len(texts):
        return
    data, offsets = column_bytes(texts)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower, letters)
        a = b


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
