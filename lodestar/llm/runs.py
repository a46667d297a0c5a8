"""Whole texts of an Arrow array in runs of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null text is empty."""
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """String array over the bytes that ``offsets`` cut out of UTF-8 ``data``."""
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [
        None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def runs(texts: pa.Array, cuts: Callable[[np.ndarray], np.ndarray], size: int) -> Iterator[tuple]:
    """(number of the first text, bytes, offsets, whether the texts end here) in order.

    A run holds consecutive whole texts of about ``size`` bytes, or a part of one
    longer text that ends where ``cuts`` allows it: ``cuts`` maps bytes to the mask
    of those before which a text may be cut. A stretch without such a place stays whole.
    """
    data, offsets = buffers(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        own = data[offsets[i]:offsets[j]]
        if len(own) <= size:
            yield i, own, offsets[i:j + 1] - offsets[i], True
        else:
            for part, last in _parts(own, cuts, size):
                yield i, part, np.array([0, len(part)]), last
        i = j


def _parts(text: np.ndarray, cuts: Callable[[np.ndarray], np.ndarray], size: int) -> Iterator[tuple]:
    at, step = 0, size
    while at + step < len(text):
        places = np.flatnonzero(cuts(text[at:at + step]))
        if len(places) and places[-1]:
            yield text[at:at + places[-1]], False
            at, step = at + int(places[-1]), size
        else:
            step *= 2  # one stretch is longer than the run
    yield text[at:], True
