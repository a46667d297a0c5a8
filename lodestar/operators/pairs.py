"""Statistics of member pairs that meet in groups, in sparse long form.

A group is a sorted list of its distinct members. Pairs are counted inside Arrow
batches and leave a task only as (a, b, total) rows, so that no pair of a group
is ever a row of its own. A group of more than ``BLOCK`` members is cut into
lists by hash, which meet list by list, so no list outgrows a task. Statistics of
a group over its pairs look up a pair table that is dealt into blocks of bounded
size, each beside a bounded number of lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestar.functions.columns import n_rows
from lodestar.operators.ordered import null_safe_join
from lodestar.session import cut_lineage, partitions

#: Members of one list.
BLOCK = 1024
#: Pairs that are held at once.
PAIRS = 1 << 21
#: Rows of a pair table, and lists, that one task looks at together.
TABLE_ROWS, LISTS = 2_000_000, 100_000


def member_lists(df: DataFrame, group: Sequence[str], member: str, block: int = BLOCK) -> DataFrame:
    """(group columns, left, right): sorted member lists whose pairs make up the pairs of each group.

    ``right`` is null where the pairs are those inside ``left``. Null members are
    left out; null group values are groups of their own.
    """
    group = list(group)
    members = cut_lineage(df.select(*group, F.col(member).alias("__m")).filter("__m is not null").distinct())
    sizes = members.groupBy(*group).agg(n_rows().alias("__k")).filter(F.col("__k") > block)
    rows = null_safe_join(members, sizes, group).withColumn(
        "__n", F.coalesce(F.ceil(F.col("__k") / block), F.lit(1)).cast("int"))
    rows = rows.withColumn("__p", F.when(F.col("__n") > 1, F.pmod(F.xxhash64("__m"), F.col("__n"))).otherwise(0).cast("int"))
    lists = rows.groupBy(*group, "__n", "__p").agg(F.sort_array(F.collect_list("__m")).alias("left"))
    lists = cut_lineage(lists)
    whole = lists.select(*group, "left", F.lit(None).cast(lists.schema["left"].dataType).alias("right"))
    parts = lists.filter("__n > 1")
    first = parts.withColumn("__q", F.explode(F.sequence(F.col("__p") + 1, F.col("__n")))).filter(F.col("__q") < F.col("__n"))
    second = (parts.select(*group, F.col("left").alias("right"), F.col("__p").alias("__q"),
                           F.explode(F.sequence(F.lit(0), F.col("__p"))).alias("__p")).filter("__p < __q"))
    across = null_safe_join(first.select(*group, "__p", "__q", "left"), second, [*group, "__p", "__q"], "inner")
    return whole.unionByName(across.select(*group, "left", "right"))


def _flat(column) -> tuple[pa.Array, np.ndarray]:
    """Values and offsets of a list column; a null list is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _expanded(left: np.ndarray, left_at: np.ndarray, right: np.ndarray, right_at: np.ndarray,
              alone: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, a, b) for all pairs of all rows, about ``PAIRS`` at a time, a < b.

    Rows that are ``alone`` pair each entry of ``left`` with those behind it, the others with all of ``right``.
    """
    row = np.repeat(np.arange(len(alone)), np.diff(left_at))
    inside = alone[row]
    start = np.where(inside, np.arange(len(left)) + 1, right_at[row])
    count = np.where(inside, left_at[row + 1] - start, right_at[row + 1] - right_at[row])
    partner = np.concatenate([left, right])
    start = np.where(inside, start, start + len(left))
    ends = np.cumsum(count)
    i = 0
    while i < len(left):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        n = count[i:j]
        own = np.repeat(left[i:j], n)
        other = partner[np.arange(n.sum()) + np.repeat(start[i:j] - (ends[i:j] - n - before), n)]
        yield np.repeat(row[i:j], n), np.minimum(own, other), np.maximum(own, other)
        i = j


def _coded(left, right) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct members of two list columns, and their numbers with offsets."""
    (x, x_at), (y, y_at) = _flat(left), _flat(right)
    coded = pa.concat_arrays([x, y]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    numbers = rank[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    return coded.dictionary.take(pa.array(order)), numbers[:len(x)], x_at, numbers[len(x):], y_at


def pair_totals(lists: DataFrame, by: Sequence[str], value: str, how: str = "sum") -> DataFrame:
    """(by, a, b, value): sum or min (``how``) of a whole-number column over the rows in which a and b meet, a < b."""
    by = list(by)
    kind = lists.schema["left"].dataType.elementType
    schema = StructType([*[lists.schema[c] for c in by], StructField("a", kind), StructField("b", kind),
                         StructField("v", LongType())])
    reduce = {"sum": np.add, "min": np.minimum}[how]

    def run(batches):
        for batch in batches:
            names, x, x_at, y, y_at = _coded(batch.column("left"), batch.column("right"))
            alone = batch.column("right").is_null().to_numpy(zero_copy_only=False)
            values = batch.column("v").to_numpy(zero_copy_only=False)
            if by:
                ids = pa.StructArray.from_arrays([batch.column(c) for c in by], names=by)
                seen: dict = {}
                group = np.array([seen.setdefault(tuple(g.values()), len(seen)) for g in ids.to_pylist()], np.int64)
                first = np.array([np.flatnonzero(group == g)[0] for g in range(len(seen))], np.int64)
            else:
                group, first = np.zeros(batch.num_rows, np.int64), np.zeros(0, np.int64)
            m = max(len(names), 1)
            for row, a, b in _expanded(x, x_at, y, y_at, alone):
                key = (group[row] * m + a) * m + b
                order = np.argsort(key, kind="stable")
                key = key[order]
                edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                total = reduce.reduceat(values[row[order]], edges) if len(key) else np.zeros(0, np.int64)
                key = key[edges]
                keys = [batch.column(c).take(pa.array(first[key // (m * m)])) for c in by]
                yield pa.RecordBatch.from_arrays(
                    [*keys, names.take(pa.array(key // m % m)), names.take(pa.array(key % m)), pa.array(total.astype(np.int64))],
                    schema.names)

    merged = {"sum": F.sum, "min": F.min}[how]
    rows = lists.select(*by, "left", "right", F.col(value).cast("long").alias("v"))
    return rows.mapInArrow(run, schema).groupBy(*by, "a", "b").agg(merged("v").alias(value))


def co_occurrence(df: DataFrame, group: Sequence[str], member: str, by: Sequence[str] = (),
                  complete: bool = False) -> DataFrame:
    """(by, a, b, n_a, n_b, n_ab): groups with a, with b and with both, for members a < b that meet.

    ``by`` are columns of the group. With ``complete`` pairs that never meet are
    there too, with n_ab = 0; that is half the square of the members, for tables
    in which every distance is wanted.
    """
    group, by = [*by, *[g for g in group if g not in by]], list(by)
    rows = cut_lineage(df.select(*group, F.col(member).alias("__m")).filter("__m is not null").distinct())
    lists = member_lists(rows, group, "__m").withColumn("n_ab", F.lit(1))
    if complete:
        every = member_lists(rows, by, "__m") if by else member_lists(rows.withColumn("__all", F.lit(1)), ["__all"], "__m")
        lists = lists.select(*by, "left", "right", "n_ab").unionByName(
            every.select(*by, "left", "right", F.lit(0).alias("n_ab")))
    pairs = pair_totals(lists, by, "n_ab")
    single = cut_lineage(rows.groupBy(*by, "__m").agg(n_rows().alias("n")))
    pairs = null_safe_join(pairs, single.withColumnsRenamed({"__m": "a", "n": "n_a"}), [*by, "a"])
    return null_safe_join(pairs, single.withColumnsRenamed({"__m": "b", "n": "n_b"}), [*by, "b"])


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """Both directions of a pair table with columns a, b, n_ab."""
    return pairs.select("a", "b", "n_ab").union(pairs.select("b", "a", "n_ab"))


def set_distance(pairs: DataFrame, kind: str = "jaccard") -> DataFrame:
    """Distance between the sets of groups in which two members occur."""
    both, either = F.col("n_ab"), F.col("n_a") + F.col("n_b") - F.col("n_ab")
    if kind == "jaccard":
        dist = 1 - F.coalesce(F.try_divide(both.cast("double"), either.cast("double")), F.lit(0.0))
    else:
        dist = F.sqrt((F.col("n_a") + F.col("n_b") - 2 * both).cast("double"))
    return pairs.withColumn("distance", dist)


def first_seen_pairs(df: DataFrame, group: Sequence[str], member: str, time: str) -> DataFrame:
    """(a, b, first_time): first whole-number time at which each pair of members meets in a group."""
    lists = member_lists(df, [*group, time], member).withColumn("first_time", F.col(time))
    return pair_totals(lists, [], "first_time", "min")


def over_pairs(lists: DataFrame, table: DataFrame, by: Sequence[str], value: str,
               score: Callable[[np.ndarray, np.ndarray], np.ndarray], at: str | None = None) -> DataFrame:
    """Sum of ``score(value of the pair, at of the list)`` over the pairs of every list row.

    ``table`` (by, a, b, value) holds all pairs of the lists, a < b. It is dealt
    into blocks by (by, a); a list visits the blocks of its members, in turns of
    at most about ``LISTS`` lists a block. Returns the columns of ``lists`` but
    the lists themselves, and ``total``; a list without pairs has none.
    """
    by = list(by)
    table = cut_lineage(table.select(*by, "a", "b", F.col(value).cast("double").alias("__v")))
    n = max(1, -(-table.count() // TABLE_ROWS))  # a list is copied to each block of its members
    block = lambda m: F.pmod(F.xxhash64(*by, m), F.lit(n)).cast("int")
    rows = lists.select("*", (F.col(at) if at else F.lit(0)).cast("double").alias("__t"))
    rows = rows.withColumn("__members", F.concat("left", F.coalesce("right", F.array().cast(lists.schema["left"].dataType))))
    rows = rows.withColumn("__b", F.explode(F.array_distinct(F.transform("__members", block)))).drop("__members")
    rows = cut_lineage(rows)
    each = min(LISTS, max(1, -(-rows.count() // (2 * partitions(lists)))))
    turns = cut_lineage(rows.groupBy(*by, "__b").agg(F.ceil(n_rows() / each).cast("int").alias("__turns")))
    keep = [c for c in lists.columns if c not in ("left", "right")]
    rows = null_safe_join(rows, turns, [*by, "__b"]).withColumn(
        "__s", F.pmod(F.xxhash64(*keep, "left"), F.col("__turns")).cast("int")).drop("__turns")
    sides = null_safe_join(table.withColumn("__b", block(F.col("a"))), turns.withColumnRenamed("__turns", "__last"),
                           [*by, "__b"], "inner").withColumn("__s", F.explode(F.sequence(F.lit(0), F.col("__last") - 1)))
    key = ["__b", "__s"]
    if by:  # one key column, in which null values of ``by`` meet
        tag = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})
        rows, sides, key = rows.withColumn("__by", tag), sides.withColumn("__by", tag), ["__by", *key]
    schema = StructType([*[lists.schema[c] for c in keep], StructField("total", table.schema["__v"].dataType)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        names, x, x_at, y, y_at = _coded(left.column("left"), left.column("right"))
        m = max(len(names), 1)
        a, b = (pc.index_in(right.column(c), value_set=names) for c in "ab")
        both = pc.and_(a.is_valid(), b.is_valid())
        a, b = (pc.filter(c, both).to_numpy().astype(np.int64) for c in (a, b))
        known = a * m + b
        order = np.argsort(known)
        known = known[order]
        values = pc.filter(right.column("__v"), both).to_numpy()[order]
        alone = left.column("right").is_null().to_numpy()
        when, total = left.column("__t").to_numpy(), np.zeros(left.num_rows)
        if len(known):
            for row, a, b in _expanded(x, x_at, y, y_at, alone):
                spot = np.minimum(np.searchsorted(known, a * m + b), len(known) - 1)
                hit = known[spot] == a * m + b
                row, spot = row[hit], spot[hit]
                total += np.bincount(row, score(values[spot], when[row]), minlength=len(total))
        return pa.table([*[left.column(c) for c in keep], pa.array(total)], names=schema.names)

    found = rows.groupBy(*key).cogroup(sides.groupBy(*key)).applyInArrow(run, schema)
    return found.groupBy(*keep).agg(F.sum("total").alias("total"))


def novel_counts(df: DataFrame, group: Sequence[str], member: str, time: str, span: int) -> DataFrame:
    """New members and new member pairs per group: first seen less than ``span`` before."""
    group = [*[g for g in group if g != time], time]
    rows = cut_lineage(df.select(*group, member).filter(F.col(member).isNotNull()).distinct())
    lists = cut_lineage(member_lists(rows, group, member))
    first = rows.groupBy(member).agg(F.min(time).alias("__first"))
    singles = rows.join(first, member).groupBy(*group).agg(
        F.count_if(F.col(time) - F.col("__first") < span).alias("new_members"))
    table = pair_totals(lists.withColumn("first_time", F.col(time)), [], "first_time", "min")
    pairs = over_pairs(lists, table, [], "first_time", lambda first, now: (now - first < span).astype(float), at=time)
    return null_safe_join(singles, pairs, group).withColumn(
        "new_pairs", F.coalesce("total", F.lit(0)).cast("bigint")).drop("total")


def avg_partner_distance(df: DataFrame, group: Sequence[str], member: str, by: Sequence[str], name: str) -> DataFrame:
    """Mean Jaccard distance between the members of each group, distances taken per ``by``; null for a single member."""
    by = list(by)
    group = [*by, *[g for g in group if g not in by]]
    rows = cut_lineage(df.select(*group, F.col(member).alias("__m")).filter("__m is not null").distinct())
    lists = cut_lineage(member_lists(rows, group, "__m"))
    table = set_distance(co_occurrence(rows, group, "__m", by))
    total = over_pairs(lists, table, by, "distance", lambda distance, _: distance)
    sizes = rows.groupBy(*group).agg(n_rows().alias("__k"))
    k = F.col("__k")
    return null_safe_join(sizes, total, group).withColumn(
        name, F.try_divide(F.col("total"), (k * (k - 1) / 2).cast("double"))).drop("total", "__k")
