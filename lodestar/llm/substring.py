"""Substring deduplication: word windows that occur anywhere else are cut out."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, LongType, StringType, StructField, StructType)

from lodestar.llm import words
from lodestar.llm.repeats import blocks, flat, members, repeated


def _span(name: str) -> StructField:
    return StructField(name, ArrayType(StructType([StructField("start", LongType()),
                                                   StructField("end", LongType())])))


def _window_hashes(part: pa.Table, width: int) -> np.ndarray:
    out = [np.zeros(0, np.uint64)]
    for piece in words.slices(part, "text"):
        cut = words.cut(piece.column("text"))
        out.append(words.windows(cut.hashes(), width)[words.window_starts(cut.bounds, width)])
    return np.concatenate(out)


def substring_dedup(docs: DataFrame, width: int = 35, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Remove every word that a repeated window of ``width`` words covers.

    Rabin-Karp hashes of all windows of all texts are counted in Spark; windows
    found twice or more, in one text or in several, merge into maximal removal
    intervals. Windows are judged on the input, so every copy goes. Words are
    ``[^\\x20\\x09-\\x0D]+``.

    Returns per input row: the id, ``n_words``, ``removed`` (intervals of word
    numbers, end exclusive, apart from each other) and ``kept_text`` (remaining
    words joined by one space). A null, empty or blank text has no words, no
    intervals and an empty kept text; a text with fewer words than ``width``
    keeps all; repeated rows (also of one id) are places of their own; null ids
    stay null; other columns are not read. Equal 64-bit hashes count as equal
    windows: with n windows the chance of one wrong match is n * n / 2**65.
    """
    parted = blocks(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")),
                    "id", "text")
    twice = repeated(parted, lambda part: _window_hashes(part, width))

    def remove(part: pa.Table, found: pa.Table) -> pa.Table:
        known = np.unique(flat(found.column("hashes"))[0])
        ids, counts, spans, kept = [], [], [], []
        for piece in words.slices(part, "text"):
            cut = words.cut(piece.column("text"))
            hit = members(words.windows(cut.hashes(), width), known) & words.window_starts(cut.bounds, width)
            change = np.zeros(len(cut.starts) + 1, dtype=np.int64)
            change[np.flatnonzero(hit)] += 1
            change[np.flatnonzero(hit) + width] -= 1
            gone = np.cumsum(change[:-1]) > 0
            n, bounds = cut.counts(), cut.bounds
            any_gone = np.zeros(len(gone) + 1, dtype=np.int64)
            np.cumsum(gone, out=any_gone[1:])
            for i, raw in enumerate(piece.column("text")):
                own = (raw.as_buffer().to_pybytes() if raw.is_valid else b"").split()
                a, b = bounds[i], bounds[i + 1]
                if any_gone[b] > any_gone[a]:
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone[a:b], [False]))))
                    spans.append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
                    own = compress(own, (~gone[a:b]).tolist())
                else:
                    spans.append([])
                kept.append(b" ".join(own))
            ids.append(piece.column("id"))
            counts.append(n)
        id_type = part.schema.field("id").type
        return pa.table({
            id_col: pa.chunked_array([c for t in ids for c in (t.chunks if isinstance(t, pa.ChunkedArray) else [t])],
                                     id_type),
            "n_words": pa.array(np.concatenate([np.zeros(0, np.int64), *counts]), pa.int64()),
            "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("n_words", LongType()),
                         _span("removed"), StructField("kept_text", StringType())])
    return (parted.groupBy("block").cogroup(twice.groupBy("block"))
            .applyInArrow(remove, schema))
