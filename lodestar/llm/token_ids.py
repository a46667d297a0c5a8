"""Token ids of whole texts under a public byte-level vocabulary.

A text is cut before every space that follows a visible ASCII character or a
letter U+00C0 to U+00FF: no pre-token of the vocabulary's pattern spans such a
place, so the ids of a text are those of its chunks in a row. Texts repeat most
chunks, so each distinct chunk of a slice is encoded once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from lodestar.llm.runs import runs, strings

#: Bytes of text that are cut and encoded in one step.
SLICE = 4 << 20
#: Chunks of more bytes, or with characters beyond U+00FF, are left to ``tokenizers``.
PLAIN_BYTES = 512


def vocabulary(name: str) -> str:
    """Place of a file of the public vocabularies on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Ids of chunks as ``tokenizers`` gives them for the file ``name``.json, special tokens read as text.

    ``name``.tiktoken holds the same vocabulary as ranks; where it exists, short
    chunks of ASCII and U+00C0 to U+00FF go through it, as it is several times faster.
    """

    def __init__(self, name: str):
        import base64
        import os

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary(f"{name}.json"))
        self.whole.encode_special_tokens = True
        self.ranked = None
        if os.path.exists(ranks := vocabulary(f"{name}.tiktoken")):
            with open(ranks, "rb") as lines:
                order = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ranked = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=order, special_tokens={})

    def _ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in a row, and the number of each."""
        texts = chunks.to_pylist()
        ids: list = [None] * len(texts)
        other = range(len(texts))
        if self.ranked is not None:
            plain = [len(t) <= PLAIN_BYTES and (t.isascii() or max(t) <= "ÿ") for t in texts]
            encode = self.ranked.encode_ordinary
            ids = [encode(t) if p else None for t, p in zip(texts, plain)]
            other = [i for i, p in enumerate(plain) if not p]
        for i in other:
            ids[i] = self.whole.encode(texts[i], add_special_tokens=False).ids
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for part in ids for i in part), np.uint32, int(sizes.sum())), sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that ``offsets`` cut out of UTF-8 ``data``, and where each text's begin and end."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        first = safe_cuts(data)
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(first)
        coded = strings(data, np.append(starts, len(data))).dictionary_encode()
        flat, sizes = self._ids(coded.dictionary)
        which = coded.indices.to_numpy()
        counts = sizes[which]
        ends = np.cumsum(counts)
        begin = np.cumsum(sizes) - sizes
        ids = flat[np.arange(ends[-1]) + np.repeat(begin[which] - (ends - counts), counts)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(name)


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Mask of the bytes before which a text may be cut without changing its ids."""
    out = np.zeros(len(data), dtype=bool)
    before = (data[:-1] > 32) & (data[:-1] < 127)
    before[1:] |= data[:-2] == 0xC3
    out[1:] = (data[1:] == 32) & before
    return out


def token_parts(texts: pa.Array, name: str) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(number of the text, some of its ids, whether they are its last) in order; a text has one part or more."""
    coder = encoder(name)
    for first, data, offsets, last in runs(texts, safe_cuts, SLICE):
        ids, bounds = coder.encode(data, offsets)
        for k in range(len(offsets) - 1):
            yield first + k, ids[bounds[k]:bounds[k + 1]], last
