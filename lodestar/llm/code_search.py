"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.tables import written

#: Most codes of an index (by a hash, about) and queries that are asked of it at once.
CODES, QUERIES = 1 << 18, 1 << 14


def signs(vector: Column, bits: int, segment: int) -> Column:
    """Binary code of a vector: its first ``bits`` signs, as an array of segment numbers."""
    def number(lo: int) -> Column:
        return reduce(lambda a, b: a + b, [
            F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << (i - lo)).cast("long")).otherwise(F.lit(0).cast("long"))
            for i in range(lo, min(bits, lo + segment))])
    return F.array(*[number(lo) for lo in range(0, bits, segment)])


def search(rows: DataFrame, is_query: Column, k: int = 10, bits: int = 64, segment: int | None = None,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest other rows of every query by the Hamming distance of sign codes; exact.

    Equal codes are searched once. They are dealt into blocks of about ``CODES``,
    and every block answers all queries by its own index. Codes are cut into
    segments of ``segment`` bits (default: as many as number the codes of a
    block, 8 to 20, evened out), each with an index from its value to the codes.
    Round r looks up, for every open query and segment, the values at distance
    r; found codes are verified on all bits. A code not yet found differs by more
    than r in every segment, so its distance is at least segments * (r + 1); a
    query is closed once its kth verified distance is below that. Of each code
    only its k + 1 least ids can be answers, so a code of a third of all rows
    costs no more than any other.

    Returns (query_id, neighbour_id, distance, rank) with ranks from 1 by
    distance, then id. Rows with a null id, or a null or too short vector, are
    neither found nor asked; null entries count as not positive; repeated rows of
    one id count once; with fewer than k other rows all are returned; other
    columns are not read.
    """
    known = rows.filter(F.col(id_col).isNotNull() & (F.size(vector_col) >= bits))
    if not segment:
        segment = min(20, max(8, min(known.count(), CODES).bit_length()))
        segment = -(-bits // -(-bits // segment))  # no short segment, which would hit a large share of all codes
    codes = (known.select(F.col(id_col).alias("id"), signs(F.col(vector_col), bits, segment).alias("code"),
                          F.coalesce(is_query, F.lit(False)).alias("asked"))
             .groupBy("id").agg(F.min("code").alias("code"), F.max("asked").alias("asked")))
    codes = written(codes)
    by_code = Window.partitionBy("code").orderBy("id")
    kept = (codes.select("code", "id").withColumn("place", F.row_number().over(by_code)).filter(F.col("place") <= k + 1)
            .groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))  # at most k + 1 ids
    classes = written(kept)
    queries = written(codes.filter("asked").select("code").distinct().withColumn("query", F.monotonically_increasing_id()))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_codes, n_queries = classes.count(), queries.count()
    blocks = max(1, -(-n_codes // CODES))
    turns = max(1, -(-n_queries // QUERIES), min(-(-n_queries // 256), -(-tasks // blocks)))

    def dealt(df: DataFrame, own: str, parts: int, other: str, times: int) -> DataFrame:
        """Every row with its block, once for each block of the other side."""
        return (df.withColumn(own, F.pmod(F.xxhash64("code"), F.lit(parts)))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))
                .repartition(min(2_048, 4 * blocks * turns), "block", "turn").groupBy("block", "turn"))

    kind = dict(classes.dtypes)["ids"]
    found = written(dealt(classes, "block", blocks, "turn", turns).cogroup(dealt(queries, "turn", turns, "block", blocks))
                    .applyInArrow(lambda left, right: _asked(left, right, k, -(-bits // segment), segment),
                                  f"query long, ids {kind}, distance int"))
    asked = (codes.filter("asked").select(F.col("id").alias("query_id"), "code").join(queries, "code")
             .select("query_id", "query"))
    answers = (asked.join(_nearest(found, k), "query").select("query_id", "distance", F.explode("ids").alias("neighbour_id"))
               .filter("neighbour_id != query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return (answers.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", "neighbour_id", F.col("distance").cast("int").alias("distance"), "rank"))


def _segments(table: pa.Table, n: int) -> np.ndarray:
    """Codes as rows of segment numbers."""
    return table.column("code").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n).astype(np.int32)


def _words(codes: np.ndarray, segment: int) -> list[np.ndarray]:
    """As many segments as fit into 64 bits in one number each."""
    per = max(1, 64 // segment)
    return [reduce(np.bitwise_or, [codes[:, i + j].astype(np.uint64) << np.uint64(segment * j)
                                   for j in range(min(per, codes.shape[1] - i))])
            for i in range(0, codes.shape[1], per)]


def _asked(left: pa.Table, right: pa.Table, k: int, n: int, segment: int) -> pa.Table:
    """Per query the codes of a block that can hold one of its k + 1 nearest ids, by the block's index."""
    answers = []
    if left.num_rows and right.num_rows:
        codes, queries = _segments(left, n), _segments(right, n)
        ids = left.column("ids").combine_chunks()
        sizes, first = pc.list_value_length(ids).to_numpy(), np.empty(len(codes), np.int64)
        first[pc.sort_indices(pc.list_element(ids, 0)).to_numpy()] = np.arange(len(codes))
        order = [np.argsort(codes[:, i], kind="stable") for i in range(n)]
        starts = [np.concatenate([[0], np.cumsum(np.bincount(codes[:, i], minlength=1 << segment))]) for i in range(n)]
        ones = np.bitwise_count(np.arange(1 << segment, dtype=np.int32))
        masks = [np.flatnonzero(ones == r).astype(np.int32) for r in range(segment + 1)]
        words, asked = _words(codes, segment), _words(queries, segment)
        for q, own in enumerate(queries):
            rows, far, most = np.zeros(0, np.int64), np.zeros(0, np.int64), n * segment
            for r in range(segment + 1):
                new = []
                for i in range(n):
                    value = masks[r] ^ own[i]
                    lo = starts[i][value]
                    some = starts[i][value + 1] - lo
                    at = np.repeat(lo - np.cumsum(some) + some, some) + np.arange(some.sum())
                    new.append(order[i][at])
                part = np.repeat(np.arange(n), [len(x) for x in new])
                new = np.concatenate(new)
                d = sum(np.bitwise_count(w[new] ^ a[q]).astype(np.int64) for w, a in zip(words, asked))
                near = np.flatnonzero(d <= most)
                new, part, d = new[near], part[near], d[near]
                apart = np.bitwise_count(codes[new] ^ own)
                # a code is found where the first of its nearest segments is looked up, and there only
                once = (apart.min(1) == r) & (apart.argmin(1) == part)
                rows, far = _closest(np.concatenate([rows, new[once]]), np.concatenate([far, d[once]]), first, sizes, k)
                if sizes[rows].sum() >= k + 1:
                    most = far[-1]
                    if most < n * (r + 1):
                        break
            answers.append((np.full(len(rows), q), rows, far))
    q, rows, far = (np.concatenate(x) for x in zip(*answers)) if answers else (np.zeros(0, np.int64),) * 3
    return pa.table({"query": right.column("query").take(pa.array(q)), "ids": left.column("ids").take(pa.array(rows)),
                     "distance": pa.array(far.astype(np.int32))})


def _closest(rows: np.ndarray, far: np.ndarray, first: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The choice of ``_nearest`` for one query."""
    if len(rows) > k + 1:
        near = far <= np.partition(far, k)[k]
        rows, far = rows[near], far[near]
    order = np.lexsort((first[rows], far))[:k + 1]
    rows, far = rows[order], far[order]
    before = np.concatenate([[0], np.cumsum(sizes[rows])])
    keep = before[np.searchsorted(far, far)] < k + 1
    return rows[keep], far[keep]


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """Per query the codes that can hold one of its k + 1 nearest ids.

    Those are among the first k + 1 codes by distance and least id, and fewer
    than k + 1 ids are strictly nearer.
    """
    query = Window.partitionBy("query")
    place = F.row_number().over(query.orderBy("distance", F.get("ids", F.lit(0))))
    near = found.withColumn("place", place).filter(F.col("place") <= k + 1)
    strictly = query.orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
    nearer = F.coalesce(F.sum(F.size("ids")).over(strictly), F.lit(0))
    return near.withColumn("nearer", nearer).filter(F.col("nearer") < k + 1).drop("nearer", "place")
