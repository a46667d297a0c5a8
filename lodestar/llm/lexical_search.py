"""Ranked lexical search by branch and bound over trees of documents."""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from lodestar.llm import words
from lodestar.llm.runs import runs, strings
from lodestar.llm.tables import small_batches, written

#: Bytes of item texts that are asked in one pass over the documents.
ITEM_BYTES = 16 << 20
#: Distinct terms of the items that share one tree; an item with more has a tree of its own.
TREE_TERMS = 8192
#: Documents of one tree.
TREE_DOCS = 16384
#: Documents of a leaf, and entries of the table of tf maxima beyond which leaves grow.
LEAF, MAXIMA = 32, 1 << 24
#: Bytes of text whose terms are cut in one step.
SLICE = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _apart(data: np.ndarray) -> np.ndarray:
    """Bytes before which a text may be cut without parting a term (A-Z, a-z, digits, beyond ASCII)."""
    return ~(words.PLAIN[words._FOLD])[data]


def term_counts(texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, ...]:
    """Terms per text, and (text, known term, tf) of the terms whose sorted hashes are ``known``."""
    sizes, keys, most = np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)], max(len(known), 1)
    for first, data, offsets, _ in runs(texts, _apart, SLICE):
        cut = words.cut(strings(data, offsets), words.PLAIN, fold=True)
        counts = cut.counts()
        sizes[first:first + len(counts)] += counts
        hashes = cut.hashes()
        hit = np.flatnonzero(words_in(hashes, known))
        doc = np.repeat(np.arange(first, first + len(counts)), counts)[hit]
        keys.append(doc * most + np.searchsorted(known, hashes[hit]))
    found, tf = np.unique(np.concatenate(keys), return_counts=True)
    return sizes, found // most, found % most, tf


def words_in(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), dtype=bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def vectors(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """(id, n, terms, tfs): terms with repeats of each document that has one, and the tf of its known terms."""
    schema = StructType([docs.schema["id"], StructField("n", LongType()),
                         *[StructField(c, ArrayType(IntegerType())) for c in ("terms", "tfs")]])

    def run(batches):
        for batch in batches:
            n, doc, term, tf = term_counts(batch.column("text").cast(pa.string()), known)
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (term, tf)]
            out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), *lists], schema.names)
            yield out.filter(pa.array(n > 0))

    return docs.mapInArrow(run, schema)


@dataclass
class Rows:
    """Restricted term vectors: entry ``bounds[i]`` to ``bounds[i + 1]`` of ``terms`` and ``tfs`` belong to row i."""

    bounds: np.ndarray
    terms: np.ndarray
    tfs: np.ndarray
    m: np.ndarray
    ids: list  # per row the least ids of the documents that it stands for

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.m)), np.diff(self.bounds))

    def take(self, order: np.ndarray) -> Rows:
        sizes = np.diff(self.bounds)[order]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(ends[-1]) + np.repeat(self.bounds[order] - ends[:-1], sizes)
        return Rows(ends, self.terms[at], self.tfs[at], self.m[order], [self.ids[i] for i in order])

    def restricted(self, place: np.ndarray, k: int) -> Rows:
        """Rows over the terms with a place (0 and up), in the order of places; rows alike in all merge, with their k least ids."""
        spot = place[self.terms]
        keep = spot >= 0
        owner, spot, tf = self.owners()[keep], spot[keep], self.tfs[keep]
        order = np.lexsort((spot, owner))
        owner, spot, tf = owner[order], spot[order], tf[order]
        bounds = np.searchsorted(owner, np.arange(len(self.m) + 1))
        lines, weights = spot.astype(">u4"), tf.astype(">u4")
        alike: dict = {}
        for i in np.flatnonzero(np.diff(bounds)).tolist():
            a, b = bounds[i], bounds[i + 1]
            alike.setdefault((lines[a:b].tobytes(), weights[a:b].tobytes(), int(self.m[i])), []).append(i)
        ordered = sorted(alike)  # terms in the order of places: rows with a common beginning are neighbours
        first = np.array([alike[key][0] for key in ordered], np.int64)
        out = Rows(bounds, spot, tf, self.m, self.ids).take(first)
        out.ids = [sorted((d for i in alike[key] for d in self.ids[i]), key=_id_order)[:k] for key in ordered]
        return out


def _id_order(x):
    return x is None, 0 if x is None else x


class Tree:
    """Prefix tree of rows sorted by their frequency-ordered terms.

    A node stands for the rows that share a path of terms. It holds, over its
    subtree, each term's largest tf and the least m. Paths without a branch are
    one edge, and neighbouring branches of few rows share a leaf.
    """

    def __init__(self, rows: Rows, n_terms: int, leaf: int = LEAF):
        self.rows = rows
        while True:
            self._grow(leaf)
            if len(self.low) * n_terms <= MAXIMA or leaf >= len(rows.m):
                break
            leaf *= 2
        self.maxima = np.zeros((len(self.low), n_terms), np.int32)
        self.least = np.zeros(len(self.low), np.int64)
        for node in range(len(self.low) - 1, -1, -1):
            below = self.children[node]
            if below:
                self.maxima[node] = self.maxima[below].max(axis=0)
                self.least[node] = self.least[below].min()
            else:
                a, b = rows.bounds[self.low[node]], rows.bounds[self.high[node]]
                np.maximum.at(self.maxima[node], rows.terms[a:b], rows.tfs[a:b])
                self.least[node] = rows.m[self.low[node]:self.high[node]].min()

    def _grow(self, leaf: int) -> None:
        rows, sizes = self.rows, np.diff(self.rows.bounds)
        self.low, self.high, self.children = [0], [len(rows.m)], [[]]
        open_ = [(0, 0)]
        while open_:
            node, depth = open_.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= leaf:
                continue
            while True:  # follow the path to its first branch
                own = np.arange(low, high)
                at = np.minimum(rows.bounds[own] + depth, len(rows.terms) - 1)
                step = np.where(sizes[own] > depth, rows.terms[at], -1)
                edges = low + 1 + np.flatnonzero(step[1:] != step[:-1])
                if len(edges) or step[0] < 0:
                    break
                depth += 1
            if not len(edges):
                continue  # all rows have the same terms
            groups, start = [], low
            ends = [*edges.tolist(), high]
            for i, end in enumerate(ends):
                if i + 1 == len(ends) or ends[i + 1] - start > leaf:
                    groups.append((start, end))
                    start = end
            if len(groups) == 1:
                groups = [(a, b) for a, b in zip([low, *ends[:-1]], ends)]
            for a, b in groups:
                self.children[node].append(len(self.low))
                open_.append((len(self.low), depth))
                self.low.append(a)
                self.high.append(b)
                self.children.append([])

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Depth-first, larger bounds first; a subtree whose bound is below the kth score is passed over."""
        tf = self.maxima[:, terms].astype(np.int64)
        bounds = _gain(weights, tf, self.least[:, None]).sum(axis=1)
        place = np.full(self.maxima.shape[1], -1)
        place[terms] = np.arange(len(terms))
        stack = [0]
        while stack:
            node = stack.pop()
            if bounds[node] <= 0 or bounds[node] < best.least:
                continue
            below = self.children[node]
            if below:
                stack += sorted(below, key=bounds.__getitem__)
            else:
                self._score(node, place, weights, best)

    def _score(self, node: int, place: np.ndarray, weights: np.ndarray, best: Best) -> None:
        rows, low, high = self.rows, self.low[node], self.high[node]
        a, b = rows.bounds[low], rows.bounds[high]
        spot = place[rows.terms[a:b]]
        hit = np.flatnonzero(spot >= 0)
        owner = np.repeat(np.arange(high - low), np.diff(rows.bounds[low:high + 1]))[hit]
        scores = np.zeros(high - low, np.int64)
        np.add.at(scores, owner, _gain(weights[spot[hit]], rows.tfs[a:b][hit].astype(np.int64), rows.m[low:high][owner]))
        for i in np.flatnonzero((scores > 0) & (scores >= best.least)).tolist():
            for key in rows.ids[low + i]:
                best.add(int(scores[i]), key)


def _gain(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Score of terms; grows with tf and falls with m."""
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Best:
    """The k best documents found so far, by score, then id."""

    def __init__(self, k: int):
        self.k, self.found, self.least = k, [], 0

    def add(self, score: int, key) -> None:
        insort(self.found, (-score, *_id_order(key), key), key=lambda x: x[:3])
        if len(self.found) > self.k:
            self.found.pop()
        if len(self.found) == self.k:
            self.least = -self.found[-1][0]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _tree_blocks(items: list[Counter], most: int = TREE_TERMS) -> Iterator[list[int]]:
    """Items in order, as many together as have ``most`` distinct terms (one at least)."""
    block, seen = [], set()
    for i, item in enumerate(items):
        if block and len(seen | item.keys()) > most:
            yield block
            block, seen = [], set()
        block.append(i)
        seen |= item.keys()
    if block:
        yield block


def _answers(found: DataFrame, items: list[Counter], df: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, id, score): per task the best ``k`` documents of each item."""
    order = np.argsort(-df, kind="stable")  # frequent terms first
    rank = np.empty(len(df), np.int64)
    rank[order] = np.arange(len(df))
    weights = np.array([weight(n_docs, int(d)) for d in df], np.int64)
    blocks = []
    for block in _tree_blocks(items):
        own = np.array(sorted({t for i in block for t in items[i]}, key=lambda t: rank[t]), np.int64)
        spot = {t: j for j, t in enumerate(own.tolist())}
        asked = []
        for i in block:
            terms = np.array([spot[t] for t in items[i]], np.int64)
            asked.append((i, terms, weights[own[terms]] * np.array(list(items[i].values()), np.int64)))
        blocks.append((own, asked))
    schema = StructType([StructField("item", LongType()), found.schema["id"], StructField("score", LongType())])

    def run(batches):
        best = [Best(k) for _ in items]
        waiting, n, kind = [], 0, None

        def ask(parts):
            t = pa.Table.from_batches(parts).combine_chunks()
            terms, tfs = (t.column(c).combine_chunks() for c in ("terms", "tfs"))
            bounds = terms.offsets.to_numpy().astype(np.int64)
            m = 25 + (75 * t.column("n").to_numpy() * n_docs) // n_terms
            rows = Rows(bounds - bounds[0], terms.flatten().to_numpy(), tfs.flatten().to_numpy(), m,
                        [[x] for x in t.column("id").to_pylist()])
            for own, asked in blocks:
                place = np.full(len(df), -1)
                place[own] = np.arange(len(own))
                some = rows.restricted(place, k)
                if len(some.m):
                    tree = Tree(some, len(own))
                    for i, terms_, weights_ in asked:
                        if len(terms_):
                            tree.search(terms_, weights_, best[i])

        for batch in batches:
            kind = batch.schema.field("id").type
            while batch.num_rows:
                part = batch.slice(0, TREE_DOCS - n)
                batch = batch.slice(part.num_rows)
                waiting.append(part)
                n += part.num_rows
                if n == TREE_DOCS:
                    ask(waiting)
                    waiting, n = [], 0
        if waiting:
            ask(waiting)
        out = [(i, x[3], -x[0]) for i, b in enumerate(best) for x in b.found]
        if out:
            item, key, score = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int64()), pa.array(key, kind), pa.array(score, pa.int64())], schema.names)

    return found.mapInArrow(run, schema)


def item_terms(text) -> Counter:
    """Terms of an item's text with their repeats."""
    import regex
    folded = (text or "").translate(str.maketrans(UPPER, LOWER))
    return Counter(regex.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded))


def _hash(terms: list[str]) -> np.ndarray:
    """Hash of each term, as ``term_counts`` takes it."""
    return words.cut(pa.array(terms, pa.string()), words.PLAIN, fold=True).hashes()


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of every item by a weighted sum over the item's terms.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z
    lower-cased. With N documents that have terms and L terms in them, a term
    found in df documents weighs w = floor(1000 * ln((2N + 2) / (2df + 1))); a
    document of n terms has m = 25 + 75 * n * N div L, and a term tf times in it
    adds w * (10**9 * tf div (1000 * tf + 8 * m)), for each repeat in the item.

    One pass over the texts restricts every document to the terms of the items.
    Every task then grows prefix trees over its restricted vectors, most frequent
    terms first; a subtree's tf maxima and least m bound its scores, so that a
    depth-first search passes over subtrees below the kth score. Rows alike in
    all asked terms and m are one row with its k least ids. Items are asked in blocks of about
    ``ITEM_BYTES`` of text, only these reach the driver.

    Returns (item, ``rank`` from 1, id, ``score``) with scores above 0, equal
    scores by ascending id, null ids last; an item with fewer such documents has
    all. Null, empty or blank texts have no terms; repeated documents and items
    are rows of their own (equal rows of equal items share ranks 1 to k each);
    other columns are not read; empty tables give no rows. Terms are compared by
    64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = written(items.select(F.col(item_col).alias("key"), F.col(item_text_col).cast("string").alias("text"),
                                 F.expr("uuid()").alias("place")))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // ITEM_BYTES))
    out = None
    for b in range(n_blocks):
        rows = asked.filter(F.pmod(F.xxhash64("place"), F.lit(n_blocks)) == b).orderBy("place").collect()
        part = _block(texts, [r.key for r in rows], [item_terms(r.text) for r in rows], k,
                      asked.schema["key"], item_col, id_col)
        out = part if out is None else out.unionByName(part)
    return out


def _block(texts: DataFrame, keys: list, items: list[Counter], k: int, key_field: StructField, item_col: str,
           id_col: str) -> DataFrame:
    spark = texts.sparkSession
    terms = sorted({t for item in items for t in item})
    hashes = _hash(terms)
    order = np.argsort(hashes)
    number = dict(zip((terms[i] for i in order.tolist()), range(len(terms))))
    numbered = [Counter({number[t]: c for t, c in item.items()}) for item in items]
    found = written(vectors(texts, hashes[order]))
    total = found.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(terms), np.int64)
    for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # terms of the items
        df[r["term"]] = r["count"]
    best = _answers(found, numbered, df, total.docs, max(total.terms, 1), k)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    names = spark.createDataFrame(list(enumerate(keys)), StructType([
        StructField("item", LongType()), StructField("key", key_field.dataType)]))
    return (best.withColumn("rank", rank).filter(F.col("rank") <= k).join(names, "item")
            .select(F.col("key").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
