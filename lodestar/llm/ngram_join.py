"""Self join of documents by the Jaccard similarity of their word shingles."""

from __future__ import annotations

import zlib
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import (BinaryType, IntegerType, LongType, StringType, StructField,
                               StructType)

from lodestar.functions.columns import n_rows
from lodestar.llm import words
from lodestar.llm.components import components
from lodestar.llm.repeats import binary, blocks, flat, members, repeated
from lodestar.llm.tables import maybe_broadcast, small_batches, written

#: Cells of the count sketch over all shingles: a fixed 8 MB on the driver, one byte each for the tasks.
CELLS_LOG2 = 21
CHUNK = 1 << 15
#: Most shared prefix shingles that a document may ask for.
MOST_MATCHES = 8
#: Shingles before a shared one that are compared to see whether the pair was named already.
BEFORE = 32
#: Documents of a shingle from which on that is worth the comparison; pairs are the same either way.
LONG_LIST = 64


def _sets(texts, width: int):
    """Per text: (64-bit name of its word sequence, sorted distinct shingle hashes)."""
    cut = words.cut(texts, fold=True)
    names = cut.hashes()
    shingles = words.windows(names, width)
    for a, b in zip(cut.bounds[:-1], cut.bounds[1:]):
        if a == b:
            yield 0, np.zeros(0, np.uint64)
            continue
        own = names[a:b].tobytes()
        name = int.from_bytes(blake2b(own, digest_size=8).digest(), "little", signed=True)
        if b - a < width:
            yield name, np.frombuffer(blake2b(own, digest_size=8, person=b"short").digest(), np.uint64)
        else:
            yield name, np.unique(shingles[a:b - width + 1])


def _profiles(width: int):
    """Rows (id, node, n) of all texts, then the task's part of the count sketch in compressed chunks."""
    cells = 1 << CELLS_LOG2

    def run(batches):
        counts = np.zeros(cells, np.uint32)
        empty = None
        for batch in batches:
            empty = batch.schema.field("id").type
            for piece in words.slices(batch, "text"):
                nodes, sizes, seen = [], [], [np.zeros(0, np.uint64)]
                for node, own in _sets(piece.column("text"), width):
                    nodes.append(node if len(own) else None)
                    sizes.append(len(own))
                    seen.append(own >> np.uint64(64 - CELLS_LOG2))
                cell, n = np.unique(np.concatenate(seen), return_counts=True)
                counts[cell] += n.astype(np.uint32)
                k = len(nodes)
                yield pa.record_batch([piece.column("id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                                       pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                                      names=["id", "node", "n", "chunk", "counts"])
        if empty is None:
            return
        full = [i for i in range(cells // CHUNK) if counts[i * CHUNK:(i + 1) * CHUNK].any()]
        k = len(full)
        yield pa.record_batch([pa.nulls(k, empty), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                               pa.array(full, pa.int32()),
                               pa.array([zlib.compress(counts[i * CHUNK:(i + 1) * CHUNK].tobytes(), 1) for i in full],
                                        pa.binary())],
                              names=["id", "node", "n", "chunk", "counts"])

    return run


def _add_chunks(part: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.uint64)
    for value in part.column("counts"):
        total += np.frombuffer(zlib.decompress(value.as_buffer()), np.uint32)
    return pa.table({"chunk": part.column("chunk").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def _levels(chunks: DataFrame) -> np.ndarray:
    """Per sketch cell: log2 of how often its commonest shingle occurs, above the usual load of a cell."""
    total = np.zeros(1 << CELLS_LOG2, np.float64)
    summed = chunks.groupBy("chunk").applyInArrow(_add_chunks, "chunk int, counts binary")
    for row in summed.collect():  # a fixed number of chunks of fixed size
        total[row.chunk * CHUNK:(row.chunk + 1) * CHUNK] = np.frombuffer(row.counts, np.uint64)
    load = total.mean()
    return np.log2(np.maximum(1.0, total - load - 4 * np.sqrt(load))).astype(np.uint8)


def _prefix(own: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The document's prefix in the global order (count level, hash), and the matches it asks for.

    With n shingles a partner shares at least o = ceil(percent * n / 100), so
    prefixes of n - o + l shingles share at least l. The length l is the one of
    least estimated cost: entries read plus candidates (entries / l) verified.
    """
    n = len(own)
    level = levels[(own >> np.uint64(64 - CELLS_LOG2)).astype(np.int64)]
    order = np.argsort(level, kind="stable")  # own is sorted by hash
    least = (percent * n + 99) // 100
    choices = np.arange(1, min(MOST_MATCHES, least) + 1)
    entries = np.cumsum(np.exp2(level[order].astype(np.float64)))[n - least - 1 + choices]
    cost = entries + (8 + n / 64) * entries / choices
    best = int(choices[np.argmin(cost)])
    return own[order[:n - least + best]], best


def _firsts(width: int):
    """One row (node, text) per different word sequence of a partition, so that copies are not dealt out."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for piece in words.slices(batch, "text"):
                keep, nodes = [], []
                for i, (node, own) in enumerate(_sets(piece.column("text"), width)):
                    if len(own) and node not in seen:
                        seen.add(node)
                        keep.append(i)
                        nodes.append(node)
                yield pa.record_batch([pa.array(nodes, pa.int64()), piece.column("text").take(pa.array(keep, pa.int64()))],
                                      names=["node", "text"])

    return run


def _different(part: pa.Table, width: int):
    """(node, set) of the different word sequences of a block."""
    seen: set[int] = set()
    names = part.column("node")
    at = 0
    for piece in words.slices(part, "text"):
        for node, own in _sets(piece.column("text"), width):
            assert node == names[at].as_py()
            at += 1
            if node not in seen:
                seen.add(node)
                yield node, own


def _entries(distinct: DataFrame, levels, width: int, percent: int) -> DataFrame:
    """Per word sequence with prefix shingles that another one has too: those, its size, its matches, its set.

    ``most`` bounds the overlap with a partner in which the shingle is a prefix
    shingle as well: what stands before it in the order and in no other prefix
    is not in the partner.
    """
    parted = blocks(distinct, "node")

    def prefixes(part: pa.Table) -> np.ndarray:
        out = [_prefix(own, levels.value, percent)[0] for _, own in _different(part, width)]
        return np.concatenate([np.zeros(0, np.uint64), *out])

    def shared(part: pa.Table, found: pa.Table) -> pa.Table:
        known = np.unique(flat(found.column("hashes"))[0])
        rows = []
        for node, own in _different(part, width):
            prefix, matches = _prefix(own, levels.value, percent)
            hit = members(prefix, known)
            if hit.any():
                rows.append((node, len(own), matches, int((~hit).sum()), prefix[hit].view(np.int64),
                             len(own) - np.cumsum(~hit)[hit], own))
        nodes, sizes, needs, alone, common, most, own = zip(*rows) if rows else ((),) * 7
        return pa.table({"node": pa.array(nodes, pa.int64()), "n": pa.array(sizes, pa.int64()),
                         "need": pa.array(needs, pa.int32()), "alone": pa.array(alone, pa.int32()),
                         "tokens": pa.array(list(common), pa.list_(pa.int64())),
                         "most": pa.array(list(most), pa.list_(pa.int64())), "own": binary(list(own))})

    found = repeated(parted, prefixes)
    return parted.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        shared, "node long, n long, need int, alone int, tokens array<long>, most array<long>, own binary")


@pandas_udf(LongType())
def _overlap(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([int(members(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)).sum())
                      for a, b in zip(x, y)], dtype="int64")


def _verified(pairs: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity; written, as are ``pairs`` and ``entries``."""
    side = lambda c: entries.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"),
                                    F.col("own").alias(f"own_{c}"))
    low = side("a").join(maybe_broadcast(written(pairs.select("a").distinct())), "a", "left_semi")
    both = side("b").join(maybe_broadcast(pairs), "b").join(low, "a")
    common = both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("sizes"),
                         _overlap("own_a", "own_b").alias("common"))
    return written(common.filter(100 * F.col("common") >= percent * (F.col("sizes") - F.col("common"))).select("a", "b"))


def _fit(x: str, y: str, percent: int):
    """Sizes and overlap bounds of two documents allow the similarity."""
    n, m = F.col(f"n{x}"), F.col(f"n{y}")
    return ((100 * F.least(n, m) >= percent * F.greatest(n, m))
            & ((100 + percent) * F.least(f"most{x}", f"most{y}") >= percent * (n + m)))


def _matched(pairs: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes share the smaller number asked for, and enough for the similarity at best."""
    side = lambda c: entries.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in (
        "n", "need", "alone", "tokens")])
    both = side("b").join(maybe_broadcast(pairs), "b").join(side("a"), "a")
    common = both.withColumn("common", F.size(F.array_intersect("tokens_a", "tokens_b")))
    beyond = lambda c: F.col(f"n_{c}") - F.col(f"alone_{c}") - F.size(f"tokens_{c}")
    best = F.col("common") + F.greatest(beyond("a"), beyond("b"))  # what stands behind the prefixes
    return common.filter((F.col("common") >= F.least("need_a", "need_b"))
                         & ((100 + percent) * best >= percent * (F.col("n_a") + F.col("n_b")))).select("a", "b")


def _links(entries: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) whose components are those of all similar pairs of different word sequences."""
    postings = (entries.select("node", "n", "need", "alone", F.posexplode(F.arrays_zip("tokens", "most")).alias("at", "x"))
                .select("node", "n", "need", "alone", "at", F.col("x.tokens").alias("token"), F.col("x.most").alias("most")))
    # Of each shingle's documents, the one with the fewest prefix shingles of its own leads (in a group of near
    # copies: the text that they were made from); the others are compared with it first.
    lead = F.min(F.struct("alone", "node", "n", "need", "most")).alias("lead")
    leaders = written(postings.groupBy("token").agg(lead, F.min("node").alias("lo"), F.max("node").alias("hi"))
                      .filter("lo < hi").select("token", F.col("lead.node").alias("a"),
                                                *[F.col(f"lead.{c}").alias(f"{c}_a") for c in ("n", "need", "most")]))
    shared = postings.join(leaders, "token")
    star = written(shared.filter((F.col("node") != F.col("a")) & _fit("", "_a", percent))
                   .groupBy("a", F.col("node").alias("b"))
                   .agg(F.count(F.lit(1)).alias("common"), F.first(F.least("need", "need_a")).alias("need"))
                   .filter("common >= need").select("a", "b"))
    first = _verified(star, entries, percent)
    # What is tied already needs no more comparisons; shingles within one component drop out.
    roots = written(components(first))
    held = (shared.join(roots, "node", "left").select(
        "token", "node", "n", "most", "at", F.coalesce("root", "node").alias("comp")))
    contested = written(held.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), n_rows().alias("size"))
                        .filter("lo < hi").select("token", "size"))
    # A pair is looked for at its first shared shingle: what stands before it in either prefix is not shared. In a
    # long list the shingles just before are compared, so that a pair is not named at all of its shared shingles.
    before = F.slice("tokens", F.greatest(F.col("at") - BEFORE + 1, F.lit(1)), F.least(F.col("at"), F.lit(BEFORE)))
    open_ = written(held.join(contested, "token").join(entries.select("node", "tokens"), "node").select(
        "token", "node", "n", (F.col("most") - F.col("at")).alias("most"), "comp",
        F.when(F.col("size") > LONG_LIST, before).alias("before")))
    other = open_.select("token", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "most", "comp", "before")])
    pair = (F.col("node") < F.col("node_b")) & (F.col("comp") != F.col("comp_b")) & _fit("", "_b", percent)
    named = (open_.join(other, "token").filter(pair & ~F.coalesce(F.arrays_overlap("before", "before_b"), F.lit(False)))
             .select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()
             .join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    rest = _matched(written(named), entries, percent)
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(
        _verified(written(rest), entries, percent))


def ngram_join(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a document's set
    is its distinct shingles of ``width`` words, or its whole word sequence where
    it has fewer. Adaptive multi-match prefixes find the candidates: shingles are
    ordered by a count sketch over all documents, each document chooses by
    estimated cost how many shingles to add to its prefix, and a pair is
    verified on whole sets only when the prefixes share the smaller number asked
    for. Equal word sequences are joined by name; the others are compared with
    the least document of each shared shingle, and then all pairs that still lie
    in different components, so that a large group of near copies costs one
    comparison a member.

    Returns per input row: the id, ``n_shingles``, ``class_id`` (least id with
    the same word sequence) and ``component_id`` (least id reachable by links).
    Null, empty and blank texts have no shingles and are alone; rows with equal
    ids are documents of their own; a null id is the component's id only where no
    document of the component has one; other columns are not read. Shingles and
    word sequences are compared by 64-bit hashes.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([StructField("id", id_type), StructField("node", LongType()), StructField("n", LongType()),
                         StructField("chunk", IntegerType()), StructField("counts", BinaryType())])
    profile = written(rows.mapInArrow(_profiles(width), schema))
    levels = spark.sparkContext.broadcast(_levels(profile.filter("chunk is not null").select("chunk", "counts")))
    distinct = rows.select("text").mapInArrow(
        _firsts(width), StructType([StructField("node", LongType()), StructField("text", StringType())]))
    entries = written(_entries(distinct, levels, width, percent))
    roots = components(_links(entries, percent))

    listed = profile.filter("chunk is null").select("id", "node", "n")
    named = listed.filter("n > 0")
    classes = (named.groupBy("node").agg(F.min("id").alias("class")).join(roots, "node", "left")
               .withColumn("root", F.coalesce("root", "node")))
    least = classes.groupBy("root").agg(F.min("class").alias("component"))
    ids = written(classes.join(least, "root").select("node", "class", "component"))
    out = named.join(ids, "node").select("id", "n", "class", "component").unionByName(
        listed.filter("n = 0").select("id", "n", F.col("id").alias("class"), F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.col("class").alias("class_id"), F.col("component").alias("component_id"))
