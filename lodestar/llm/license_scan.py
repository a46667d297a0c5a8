"""License scans with a positional index of rare template words."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType)

from lodestar.llm import words
from lodestar.llm.tables import small_batches

#: Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Fixed values: (label, customary notice, phrases without which the notice is not it).
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the Software), to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software", ("permission is hereby granted", "without restriction")),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at", ("apache license", "in compliance with")),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
     "any later version", ("gnu general public license",)),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
     "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
     "your option) any later version", ("lesser general public license",)),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version", ("affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
     "this list of conditions and the following disclaimer", ("redistribution and use in source and binary forms",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
     "was not distributed with this file, You can obtain one at", ("mozilla public license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
     ("with or without fee", "appear in all copies")),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
     "modify, publish, use, compile, sell, or distribute this software", ("unencumbered software",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License",
     ("creative commons attribution",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
     "this work", ("related or neighboring rights",)),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be "
     "held liable for any damages arising from the use of this software", ("without any express or implied warranty",)),
    ("boost", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
)
LEAST_SCORE = 0.6  # share of a template's IDF weight that stands in place
SLACK = 8  # words by which inserted and missing words may move a word against a looked-up one
BLOCK = 4_096  # relative positions compared at once


def _names(text: str) -> np.ndarray:
    return words.cut(pa.array([text]), words.PLAIN, fold=True).hashes()


def _places(hashes: np.ndarray, doc: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Word numbers where the phrase's words stand consecutively inside one text."""
    k = len(phrase)
    at = np.flatnonzero(hashes[:len(hashes) - k + 1] == phrase[0]) if len(hashes) >= k else np.zeros(0, np.int64)
    for j in range(1, k):
        at = at[hashes[at + j] == phrase[j]]
    return at[doc[at] == doc[at + k - 1]]


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all texts each vocabulary word (sorted hashes) stands, and the number of texts."""
    n = len(vocabulary)

    def run(batches):
        total, texts = np.zeros(n + 1, np.int64), 0
        for batch in batches:
            for piece in words.slices(batch, "text"):
                cut = words.cut(piece.column("text"), words.PLAIN, fold=True)
                at, hit = _lookup(cut.hashes(), vocabulary)
                pairs = np.unique(cut.doc_of()[hit] * n + at[hit])
                total[:n] += np.bincount(pairs % n, minlength=n)
                total[n] += piece.num_rows
        full = np.flatnonzero(total)
        yield pa.record_batch([pa.array(full, pa.int32()), pa.array(total[full], pa.int64())], names=["word", "n"])

    counts = (docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word int, n long")
              .groupBy("word").agg(F.sum("n").alias("n")))
    out = np.zeros(n + 1, np.int64)
    for row in counts.collect():  # one row per vocabulary word
        out[row.word] = row.n
    return out[:n], int(out[n])


def _lookup(hashes: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return at, vocabulary[at] == hashes


class _Index:
    """Template words with IDF weights, and their postings (template, position)."""

    def __init__(self, templates, vocabulary: np.ndarray, weights: np.ndarray):
        self.vocabulary, self.weights = vocabulary, weights
        self.labels = [label for label, _, _ in templates]
        self.lines = [_lookup(_names(text), vocabulary)[0] for _, text, _ in templates]
        self.keys = [[_names(phrase) for phrase in keys] for _, _, keys in templates]
        self.totals = np.array([weights[line].sum() for line in self.lines])
        self.bound = np.zeros((len(vocabulary), len(templates)))
        self.postings: list[dict[int, list[int]]] = []
        for t, line in enumerate(self.lines):
            spots = defaultdict(list)
            for position, word in enumerate(line):
                spots[int(word)].append(position)
                self.bound[word, t] += weights[word]
            self.postings.append(spots)

    def _in_place(self, at: np.ndarray, hit: np.ndarray, t: int, shifts: np.ndarray) -> np.ndarray:
        """Most weight of words in template order within SLACK words of each shift.

        Rows are template words, after each of which the best weights per shift and
        offset are kept: (words + 1, shifts, 2 * SLACK + 1).
        """
        line, n = self.lines[t], len(at)
        offsets = shifts[:, None] + np.arange(-SLACK, SLACK + 1)
        best = np.zeros((len(line) + 1, *offsets.shape))
        for i, word in enumerate(line):
            place = offsets + i
            inside = np.clip(place, 0, n - 1)
            same = (place == inside) & hit[inside] & (at[inside] == word)
            row = best[i] + np.where(same, self.weights[word], 0.0)
            row[:, :-1] = np.maximum(row[:, :-1], best[i][:, 1:])  # the text lacks the word
            best[i + 1] = np.maximum.accumulate(row, axis=1)  # the text has words between
        return best

    def _ends(self, at: np.ndarray, hit: np.ndarray, t: int, shift: int) -> tuple[int, int]:
        """First word and end of the template as its first and last words in place put it."""
        best, line, n = self._in_place(at, hit, t, np.array([shift]))[:, 0], self.lines[t], len(at)
        i, o, found = len(line), 2 * SLACK, []
        while i and best[i, o] > 0:
            if o and best[i, o] == best[i, o - 1]:
                o -= 1
            elif o < 2 * SLACK and best[i, o] == best[i - 1, o + 1]:
                i, o = i - 1, o + 1
            else:
                i -= 1
                if best[i + 1, o] > best[i, o]:
                    found.append(shift + o - SLACK)
        return max(0, found[-1]), min(n, found[0] + len(line))

    def matches(self, at: np.ndarray, hit: np.ndarray, names: np.ndarray, t: int):
        """Best place of template t among the words of one text: (first word, end, score), or None.

        ``at`` has the vocabulary number of each word where ``hit``. Postings of the
        text's highest-IDF template words give relative positions, each of which is
        compared along the whole template, in its order and within SLACK words; so many
        words are looked up that no place with enough weight is missed.
        """
        spots, n = self.postings[t], len(at)
        own = [int(w) for w in np.unique(at[hit]) if int(w) in spots]
        seen = self.totals[t] - sum(self.bound[w, t] for w in own)  # weight of words that the text lacks
        shifts = set()
        for word in sorted(own, key=lambda w: (-self.weights[w], w)):
            places = np.flatnonzero(hit & (at == word))
            shifts.update((places[:, None] - np.array(spots[word])).ravel().tolist())
            seen += self.bound[word, t]
            if seen > (1 - LEAST_SCORE) * self.totals[t]:
                break  # a place that has none of these words can't carry the weight
        doc = np.zeros(n, np.int64)
        if not all(len(_places(names, doc, key)) for key in self.keys[t]):
            return None
        best, ordered = None, np.array(sorted(shifts), np.int64)
        for i in range(0, len(ordered), BLOCK):
            scores = self._in_place(at, hit, t, ordered[i:i + BLOCK])[-1, :, -1] / self.totals[t]
            top = int(scores.argmax())
            if best is None or scores[top] > best[1]:
                best = (int(ordered[i + top]), float(scores[top]))
        if best is None or best[1] < LEAST_SCORE:
            return None
        return *self._ends(at, hit, t, best[0]), best[1]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=None,
                 templates=None) -> DataFrame:
    """Licence notices in whole texts.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z in lower case. Every
    place of a base phrase counts. Besides, the words of customary notices form
    a positional index with IDF weights counted over all texts: a text's
    highest-IDF template words are looked up, their postings give relative
    positions, and a notice is found where the words in template order within
    ``SLACK`` words of one of these carry 0.6 or more of its weight and all its key
    phrases stand in the text. A template is only
    tried on a text whose different words could carry that weight.

    Returns per input row: the id, ``n_words`` and ``matches`` (label, start,
    end, score, base) in word numbers, end exclusive, sorted by place; score is 1
    for a phrase. A null, empty or wordless text has no words and no matches;
    overlapping places count each; ties between places of one template go to the
    first; repeated rows are scanned each; null ids stay null; other columns are
    not read; an empty table gives none.
    """
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    vocabulary = np.unique(np.concatenate([_names(text) for _, text, _ in templates]))
    df, n_texts = document_frequencies(rows, vocabulary)
    index = _Index(templates, vocabulary, np.log((n_texts + 1) / (df + 1)) + 1e-3)
    exact = [(_names(phrase), label) for phrase, label in phrases.items()]

    def run(batches):
        for batch in batches:
            for piece in words.slices(batch, "text"):
                cut = words.cut(piece.column("text"), words.PLAIN, fold=True)
                names, doc, n = cut.hashes(), cut.doc_of(), piece.num_rows
                found = [[] for _ in range(n)]
                for phrase, label in exact:
                    for place in _places(names, doc, phrase).tolist():
                        start = place - int(cut.bounds[doc[place]])
                        found[doc[place]].append({"label": label, "start": start, "end": start + len(phrase),
                                                  "score": 1.0, "base": True})
                at, hit = _lookup(names, vocabulary)
                present = np.zeros((n, len(vocabulary)), bool)
                present[doc[hit], at[hit]] = True
                tried = present @ index.bound >= LEAST_SCORE * index.totals
                for d, t in zip(*np.nonzero(tried)):
                    a, b = cut.bounds[d], cut.bounds[d + 1]
                    best = index.matches(at[a:b], hit[a:b], names[a:b], t)
                    if best:
                        found[d].append({"label": index.labels[t], "start": best[0], "end": best[1],
                                         "score": min(1.0, best[2]), "base": False})
                for matches in found:
                    matches.sort(key=lambda m: (m["start"], m["end"], m["label"], not m["base"]))
                yield pa.record_batch(
                    [piece.column("id"), pa.array(cut.counts(), pa.int64()), pa.array(found, spans)],
                    names=[id_col, "n_words", "matches"])

    spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                ("score", pa.float64()), ("base", pa.bool_())]))
    match = StructType([StructField("label", StringType()), StructField("start", LongType()),
                        StructField("end", LongType()), StructField("score", DoubleType()),
                        StructField("base", BooleanType())])
    return rows.mapInArrow(run, StructType([
        StructField(id_col, docs.schema[id_col].dataType), StructField("n_words", LongType()),
        StructField("matches", ArrayType(match))]))
