"""Language identification by hyperdimensional letter profiles."""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lodestar.llm import words
from lodestar.llm.tables import maybe_broadcast, small_batches, written

DIMENSIONS = 1024
GRAMS = 8192  # n-gram vectors held at once
#: Most labelled texts a language's prototype is learned from, in expectation.
TEXTS_PER_LANGUAGE = 3_000
UNKNOWN = "und"
SPACE = 32


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _letter_vectors(points: np.ndarray) -> np.ndarray:
    """Random vector of +1 and -1 for each code point, the same everywhere."""
    n = DIMENSIONS // 64
    bits = words.mix(points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
                     + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return (np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1)


def profiles(texts: list[str | None]) -> np.ndarray:
    """One bundle per text: the sum of its letter trigrams' vectors.

    Letters are lower-cased; each run of letters stands between two spaces, and a
    trigram is the product of its letters' vectors, the first rotated by two
    places and the second by one. A text without letters gives zeros.
    """
    n = len(texts)
    out = np.zeros((n, DIMENSIONS), np.float32)
    lower = [(t or "").lower() for t in texts]
    points = np.frombuffer(f" {'\n'.join(lower)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(n), np.array([len(t) for t in lower], int) + 1)  # each with the separator behind it
    text = np.concatenate(([0], text))
    letter = _is_letter()[points]
    at = np.flatnonzero(letter[1:-1]) + 1
    if not len(at):
        return out
    points = np.where(letter, points, SPACE)
    alphabet, codes = np.unique(points, return_inverse=True)
    vectors = _letter_vectors(alphabet)
    size = len(alphabet)
    grams, which = np.unique((codes[at - 1] * size + codes[at]) * size + codes[at + 1], return_inverse=True)
    rotated = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
    order = np.argsort(which, kind="stable") if len(grams) > GRAMS else None
    if order is not None:
        which, at = which[order], at[order]
    for lo in range(0, len(grams), GRAMS):
        part = grams[lo:lo + GRAMS]
        a, b = (np.searchsorted(which, (lo, lo + len(part))) if order is not None else (0, len(which)))
        counts = np.bincount((which[a:b] - lo) * n + text[at[a:b]], minlength=len(part) * n).reshape(len(part), n)
        bound = rotated[0][part // size // size] * rotated[1][part // size % size] * vectors[part % size]
        out += counts.T.astype(np.float32) @ bound.astype(np.float32)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return rows / np.where(size > 0, size, 1)


def prototypes(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
               texts_per_language: int = TEXTS_PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Prototype vector of each language: the bundle of its texts' unit profiles.

    Learned from at most ``texts_per_language`` texts a language, in
    expectation, picked by a hash of the text. Rows without text or language
    teach nothing.
    """
    known = (labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
             .filter("lang is not null and text is not null"))
    counts = written(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    picked = known.join(maybe_broadcast(counts), "lang").filter(
        F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1_000_000 * F.col("n") < float(texts_per_language))

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in words.slices(batch, "text"):
                rows = _unit(profiles(piece.column("text").to_pylist()))
                for lang, row in zip(piece.column("lang").to_pylist(), rows):
                    sums[lang] = sums.get(lang, 0) + row
        yield pa.record_batch([pa.array(list(sums), pa.string()),
                               pa.array([np.asarray(v, np.float64).tobytes() for v in sums.values()], pa.binary())],
                              names=["lang", "bundle"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.float64) for b in part["bundle"])
        return pd.DataFrame({"lang": part["lang"][:1], "bundle": [total.tobytes()]})

    small_batches(labelled.sparkSession)
    parts = picked.select("lang", "text").mapInArrow(bundle, "lang string, bundle binary")
    rows = parts.groupBy("lang").applyInPandas(add, "lang string, bundle binary").collect()  # one per language
    return {r.lang: _unit(np.frombuffer(r.bundle, np.float64)[None])[0] for r in sorted(rows, key=lambda r: r.lang)}


def language_id(docs: DataFrame, known: dict[str, np.ndarray], id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The language whose prototype has the largest cosine with each whole text's profile.

    Returns per input row: the id, ``lang_pred`` and ``score``, the cosine (at
    least 0, at most 1). A null text or one without a letter gets ``und`` and
    score 0, as does every text when no language is known; equal cosines go to
    the language first in the alphabet; repeated rows are predicted each; null
    ids stay null; other columns are not read; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    langs = sorted(known)
    matrix = np.array([known[lang] for lang in langs], np.float32).reshape(len(langs), DIMENSIONS).T

    def predict(batches):
        for batch in batches:
            for piece in words.slices(batch, "text"):
                rows = profiles(piece.column("text").to_pylist())
                some = rows.any(axis=1) & bool(langs)
                if langs:
                    near = _unit(rows) @ matrix
                    best = near.argmax(axis=1)
                    score = np.where(some, np.clip(near.max(axis=1), 0, 1), 0).astype(np.float64)
                    names = [langs[b] if s else UNKNOWN for b, s in zip(best, some)]
                else:
                    names, score = [UNKNOWN] * len(rows), np.zeros(len(rows))
                yield pa.record_batch([piece.column("id"), pa.array(names, pa.string()), pa.array(score)],
                                      names=[id_col, "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(predict, StructType([
        StructField(id_col, docs.schema[id_col].dataType), StructField("lang_pred", StringType()),
        StructField("score", DoubleType())]))
