"""Hashes that stand in more than one place, found with one shuffle of packed hashes.

Texts are dealt to blocks by a hash. Each block keeps every
hash at most twice (pre-aggregation: a hash of a third of all texts costs two
entries a block), cuts the sorted hashes into ranges and sends one row per
(block, range). A range counts its hashes over all blocks and answers each
block with those that came twice or more. Nothing is gathered beyond one block
or one range, whose number follows ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import partitions

GROUPS = 2  # blocks, and ranges, per shuffle partition


def blocks(rows: DataFrame, *by: str) -> DataFrame:
    """Rows with a block number from the columns ``by``; each block lies in one partition."""
    n = partitions(rows)
    return (rows.withColumn("block", F.pmod(F.xxhash64(*by), F.lit(GROUPS * n)).cast("int"))
            .repartition(n, "block"))


def at_most_twice(values: np.ndarray) -> np.ndarray:
    """Sorted values; of equal ones the first two."""
    values = np.sort(values)
    keep = np.ones(len(values), dtype=bool)
    keep[2:] = values[2:] != values[:-2]
    return values[keep]


def binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """All 64-bit numbers of a binary column, and the number of each row's."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in column]
    return (np.concatenate(rows) if rows else np.zeros(0, np.uint64)), np.array([len(r) for r in rows], int)


def repeated(parted: DataFrame, hashes: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """Per block the hashes that ``hashes`` gives twice or more over all blocks.

    ``parted`` comes from ``blocks``. Returns (block, hashes): hashes is a
    sorted packed array of 64-bit numbers per row, and a block may have several rows.
    """
    n = GROUPS * partitions(parted)
    width = (1 << 64) // n + 1
    cuts = np.array([i * width for i in range(1, n)], dtype=np.uint64)

    def send(part: pa.Table) -> pa.Table:
        values = at_most_twice(hashes(part))
        edges = [0, *np.searchsorted(values, cuts), len(values)]
        full = [i for i in range(n) if edges[i + 1] > edges[i]]
        block = part.column("block")[0].as_py()
        return pa.table({
            "range": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int32()),
            "hashes": binary([values[edges[i]:edges[i + 1]] for i in full])})

    def answer(part: pa.Table) -> pa.Table:
        values, sizes = flat(part.column("hashes"))
        ordered = np.sort(values)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        del ordered
        at = np.searchsorted(twice, values)
        hit = twice[np.minimum(at, len(twice) - 1)] == values if len(twice) else np.zeros(len(values), bool)
        ends = np.cumsum(sizes)
        found = [np.unique(values[e - s:e][hit[e - s:e]]) for s, e in zip(sizes, ends)]
        full = [i for i, f in enumerate(found) if len(f)]
        blocks_ = part.column("block").combine_chunks()
        return pa.table({"block": blocks_.take(pa.array(full, pa.int64())),
                         "hashes": binary([found[i] for i in full])})

    sent = parted.groupBy("block").applyInArrow(send, "range int, block int, hashes binary")
    return sent.groupBy("range").applyInArrow(answer, "block int, hashes binary")


def members(values: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Mask: which values are in the sorted array ``within``."""
    if not len(within):
        return np.zeros(len(values), dtype=bool)
    return within[np.minimum(np.searchsorted(within, values), len(within) - 1)] == values
