"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lodestar.llm.mixing import WORD
from lodestar.session import partitions

CAPACITIES = (512, 1024, 2048, 4096)
#: Pieces packed together; a partition is worked through in groups of this size.
GROUP = 50_000
#: Length at which attention costs as much as everything else.
ATTENTION = 8192


def cost(capacity: int) -> float:
    """Cost of one sequence: linear work and attention."""
    return capacity * (1 + capacity / ATTENTION)


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing with several bin sizes, for pieces no longer than the largest.

    A piece goes into the open bin that it leaves the least room in. Where none
    has room, the bin size is opened that costs least per token it can expect to
    hold: the piece, and as much of the shorter pieces to come as fit beside it.
    At last each bin shrinks to the least capacity that holds its contents.
    Returns each piece's bin and offset, and each bin's capacity.
    """
    capacities = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    # tokens of the pieces up to each length that are still to come
    ahead = np.bincount(np.asarray(lengths, int), weights=np.asarray(lengths, float), minlength=capacities[-1] + 1)
    below = np.cumsum(ahead)
    bins, offsets, used = [0] * len(lengths), [0] * len(lengths), []
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    for at, i in enumerate(order):
        size = lengths[i]
        if at and size != lengths[order[at - 1]]:
            below[size:] = below[size]  # longer pieces are all placed
        spot = bisect_left(room, (size, -1))
        if spot < len(room):
            left, number = room.pop(spot)
        else:
            left = min((c for c in capacities if c >= size),
                       key=lambda c: cost(c) / (size + min(c - size, below[min(c - size, size)])))
            number = len(used)
            used.append(0)
        bins[i], offsets[i] = number, used[number]
        used[number] += size
        if left > size:
            insort(room, (left - size, number))
    return bins, offsets, [capacities[bisect_left(capacities, u)] for u in used]


def best_fit(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, extra: int = 1, group: int = GROUP,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into sequences of the permitted lengths.

    A document's length is its words plus ``extra`` (the end mark). Longer ones
    are cut into pieces of the largest capacity and a rest. Pieces are dealt out
    by a hash; every partition packs its pieces in groups, so no bin, key or hot
    document needs more than one group in memory, and every piece is packed.

    Returns one row per piece: the id, ``piece`` (from 0), ``start`` (token in the
    document), ``length``, ``bin``, ``offset`` (token in the bin) and ``capacity``
    of the shrunk bin. A null, empty or blank text has one row with length 0 and
    no bin; repeated rows are packed each; null ids stay null; other columns are
    not read; an empty table gives no rows.
    """
    capacities = sorted(set(capacities))
    most = capacities[-1]
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = docs.select(F.col(id_col).alias("id"), words.alias("words")).withColumn(
        "tokens", F.when(F.col("words") > 0, F.col("words") + extra).otherwise(0))
    last = F.greatest(F.ceil(F.col("tokens") / most) - 1, F.lit(0)).cast("long")
    pieces = (sizes.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
              .withColumn("start", F.col("piece") * most)
              .withColumn("length", F.least(F.lit(most).cast("long"), F.col("tokens") - F.col("start")))
              .select("id", "piece", "start", "length"))

    def run(batches):
        task, opened, waiting, n = TaskContext.get().partitionId() << 32, 0, [], 0

        def packed(parts):
            nonlocal opened
            rows = pa.Table.from_batches(parts).combine_chunks()
            lengths = np.array(rows.column("length").to_pylist(), int)
            some = np.flatnonzero(lengths)
            bins, offsets, sizes_ = pack(lengths[some].tolist(), capacities)
            number, offset, capacity = [None] * len(lengths), [None] * len(lengths), [None] * len(lengths)
            for i, b, o in zip(some.tolist(), bins, offsets):
                number[i], offset[i], capacity[i] = task + opened + b, o, sizes_[b]
            opened += len(sizes_)
            out = rows.append_column("bin", pa.array(number, pa.int64())).append_column(
                "offset", pa.array(offset, pa.int64())).append_column("capacity", pa.array(capacity, pa.int32()))
            return out.to_batches()

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, group - n)
                batch = batch.slice(part.num_rows)
                waiting.append(part)
                n += part.num_rows
                if n == group:
                    yield from packed(waiting)
                    waiting, n = [], 0
        if waiting:
            yield from packed(waiting)

    dealt = (pieces.withColumn("deal", F.xxhash64("id", "piece", "length")).repartition(partitions(docs), "deal")
             .sortWithinPartitions("deal", "id", "piece", "length").drop("deal"))
    schema = StructType([StructField("id", docs.schema[id_col].dataType),
                         *[StructField(c, LongType()) for c in ("piece", "start", "length", "bin", "offset")],
                         StructField("capacity", IntegerType())])
    return dealt.mapInArrow(run, schema).withColumnRenamed("id", id_col)
