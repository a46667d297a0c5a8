"""Words of whole texts as arrays.

A byte table tells word bytes from separators, so all texts of an Arrow array
are cut at once. Words and word windows are named by 64-bit polynomial hashes
(Rabin-Karp with prefix sums modulo 2**64 and a final mix). Memory is bounded
by the slices of ``slices`` and, inside a very long text, by ``SEGMENT``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 16  # bytes (or words) hashed in one step
SLICE = 1 << 18  # bytes of text handled in one step
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finishing steps of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Roll:
    """Hash of any stretch of a sequence from prefix sums: sum(v[i] * B**(i - start))."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = _powers(base, 1), _powers(self.inverse, 1)

    def stretch(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(values)
        if n + 1 > len(self.up):
            size = 1 << (n + 1).bit_length()
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * self.up[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts])


_BYTES, _WORDS = _Roll(0x9E3779B97F4A7C15), _Roll(0xD1342543DE82EF95)
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def table(separators) -> np.ndarray:
    """Byte table that is true for word bytes."""
    out = np.ones(256, dtype=bool)
    out[list(separators)] = False
    return out


#: Words ``[^\x20\x09-\x0D]+``.
BLANKS = table([0x20, *range(0x09, 0x0E)])
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, letters, all beyond ASCII.
PLAIN = table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # first byte of each text, and the end
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    bounds: np.ndarray  # first word of each text, and the end
    letters: np.ndarray  # number that stands for each byte in hashes

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc_of(self) -> np.ndarray:
        """Number of the text that each word stands in."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def hashes(self, first: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first bytes (shorter words: whole)."""
        return self.stretches(self.starts, self.ends if first is None else np.minimum(self.starts + first, self.ends))

    def stretches(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each stretch of bytes; both arrays ascend."""
        out = np.empty(len(starts), dtype=np.uint64)
        i = 0
        while i < len(out):
            base = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, base + SEGMENT, side="right")))
            part = self.data[base:ends[j - 1]]
            out[i:j] = _BYTES.stretch(self.letters[part], starts[i:j] - base, ends[i:j] - base)
            i = j
        return out


def cut(texts: pa.Array, words: np.ndarray = BLANKS, fold: bool | np.ndarray = False) -> Words:
    """Words of each text of a string array; a null text has none.

    ``fold`` maps bytes before they are compared: true lower-cases A-Z, an
    array of 256 bytes gives any other mapping.
    """
    mapping = fold if isinstance(fold, np.ndarray) else _FOLD if fold else np.arange(256)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.string()) if not pa.types.is_string(texts.type) else texts
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0:
        offsets = np.zeros(1, dtype=np.int64)
    else:
        offsets = np.frombuffer(offsets, dtype=np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    base = offsets[0]
    data = (np.frombuffer(data, dtype=np.uint8)[base:offsets[-1]] if data is not None
            else np.zeros(0, dtype=np.uint8))
    offsets = offsets - base
    inside = words[mapping][data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begin[inner] = inside[inner]
    end[inner - 1] = inside[inner - 1]
    starts = np.flatnonzero(begin)
    return Words(data, offsets, starts, np.flatnonzero(end) + 1,
                 np.searchsorted(starts, offsets), _LETTER[mapping])


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` entries; entry i starts at word i."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for i in range(0, n, SEGMENT):
        j = min(n, i + SEGMENT)
        at = np.arange(j - i)
        out[i:j] = _WORDS.stretch(hashes[i:j + width - 1], at, at + width)
    return out


def window_starts(bounds: np.ndarray, width: int) -> np.ndarray:
    """Mask over ``windows``: true where the window lies in one text."""
    n = int(bounds[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return doc[:n] == doc[width - 1:]


def slices(table_or_batch, column: str, size: int = SLICE) -> Iterator:
    """Consecutive row ranges with about ``size`` bytes of text each (one long text: alone)."""
    texts = table_or_batch.column(column)
    chunks = texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]
    at = 0
    for chunk in chunks:
        n = len(chunk)
        if n == 0:
            continue
        offsets = np.frombuffer(chunk.buffers()[1], dtype=np.int32)[chunk.offset:chunk.offset + n + 1]
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, int(offsets[i]) + size, side="right")) - 1)
            j = min(j, n)
            yield table_or_batch.slice(at + i, j - i)
            i = j
        at += n
