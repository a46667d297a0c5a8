"""Filters, joins, sorts and set operations."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def match_any(col: Column, patterns: Sequence[str]) -> Column:
    """1 when the text contains one of the patterns, 0 when not, null for a blank."""
    hit = reduce(lambda a, b: a | b, [col.contains(p) for p in patterns])
    return F.when(F.nullif(col, F.lit("")).isNotNull(), hit.cast("int"))


def replace_where(df: DataFrame, cond: Column, col: str, value) -> DataFrame:
    """Set ``col`` to ``value`` in the rows where ``cond`` holds."""
    value = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(col, F.when(cond, value).otherwise(F.col(col)))


def fill_mean(df: DataFrame, col: str, usable: Column) -> DataFrame:
    """Fill nulls with the mean over the rows where ``usable`` holds."""
    mean = df.agg(F.avg(F.when(usable, F.col(col))).alias("m")).scalar()
    return df.withColumn(col, F.coalesce(F.col(col), mean))


def drop_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Complete cases over ``cols`` (all columns by default)."""
    return df.na.drop(subset=list(cols) if cols else None)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in a total order.

    Spark limits each group to one row before the shuffle, so a hot key sends
    one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rank).filter("__rn = 1").drop("__rn")


def rename_regex(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """Rename every column by a regular expression."""
    return df.toDF(*[re.sub(pattern, replacement, c) for c in df.columns])


def semi(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_anti")


def exclusive_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys found in exactly one of two tables, with the side that has them."""
    left = a.select(key, F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
    right = b.select(key, F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    sides = (left.unionAll(right).groupBy(key)
             .agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b")))
    return sides.filter(F.col("in_a") + F.col("in_b") == 1)


def exists_before(df: DataFrame, links: DataFrame, events: DataFrame, entity: str,
                  neighbour: str, key: str, time: str, flag: str) -> DataFrame:
    """Flag rows whose (key) was seen earlier with a linked entity.

    Only the earliest time per (entity, key) can decide, so the time condition
    becomes a minimum: links are joined to minima, reduced again, and compared.
    """
    seen = events.groupBy(F.col(entity).alias(neighbour), key).agg(F.min(time).alias("__t"))
    earliest = (links.join(seen, neighbour).groupBy(entity, key)
                .agg(F.min("__t").alias("__t")))
    return (df.join(earliest, [entity, key], "left")
            .withColumn(flag, F.coalesce((F.col("__t") < F.col(time)).cast("int"), F.lit(0)))
            .drop("__t"))


def asof_next(times: DataFrame, events: DataFrame, by: Sequence[str], time: str,
              event_time: str) -> DataFrame:
    """Map each time to the next event time at or after it, per ``by``.

    Both sides are reduced to distinct times first; the window then holds one
    row per distinct time of a key.
    """
    by = list(by)
    marks = events.select(*by, F.col(event_time).alias(time)).distinct() \
        .withColumn(event_time, F.col(time))
    asked = times.select(*by, time).distinct().withColumn(
        event_time, F.lit(None).cast(marks.schema[event_time].dataType))
    ahead = (Window.partitionBy(*by).orderBy(time)
             .rangeBetween(Window.currentRow, Window.unboundedFollowing))
    both = asked.withColumn("__ask", F.lit(1)).unionByName(marks.withColumn("__ask", F.lit(0)))
    hits = (both.withColumn(event_time, F.min(event_time).over(ahead))
            .filter("__ask = 1").drop("__ask"))
    return times.join(hits, [*by, time], "left")


def interval_flag(df: DataFrame, ranges: DataFrame, key: str, time: str, start: str,
                  end: str, flag: str) -> DataFrame:
    """1 when ``time`` lies in one of the key's intervals. Ranges become distinct times."""
    covered = ranges.select(key, F.explode(F.sequence(start, end)).alias(time)).distinct()
    hit = df.select(key, time).distinct().join(covered, [key, time], "left_semi") \
        .withColumn(flag, F.lit(1))
    return df.join(hit, [key, time], "left").na.fill(0, [flag])


def snapshots(df: DataFrame, time: str, first: Column, last: Column, name: str,
              width: int | None = None) -> DataFrame:
    """Rows seen at each year ``y``: ``time < y``, or ``y - width < time <= y`` with a width.

    Each row is copied straight to its own years, at most the length of the
    spine; aggregate to (key, time) before calling.
    """
    t = F.col(time)
    if width is None:
        start, stop = F.greatest(t + 1, first), last
    else:
        start, stop = F.greatest(t, first), F.least(t + width - 1, last)
    return (df.filter(start <= stop)
            .withColumn(name, F.explode(F.sequence(start, stop))))


def expand_grid(spark: SparkSession, axes: Mapping[str, Sequence], limit: int = 1_000_000) -> DataFrame:
    """All combinations of a few literal axes; the size is checked first."""
    size = reduce(lambda a, b: a * b, [len(v) for v in axes.values()], 1)
    if size > limit:
        raise ValueError(f"grid of {size} points exceeds {limit}")
    grid = spark.range(1).drop("id")
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid


def argmax_per_group(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """All rows that reach the maximum of their group (ties are kept)."""
    top = df.groupBy(*keys).agg(F.max(value).alias(value))
    return df.join(top, [*keys, value], "left_semi")


def neighbour_mean(values: DataFrame, links: DataFrame, entity: str, neighbour: str,
                   time: str, value: str, name: str) -> DataFrame:
    """Average of a value over the linked entities, per entity and time."""
    other = values.select(F.col(entity).alias(neighbour), time, value)
    return (links.join(other, neighbour).groupBy(entity, time)
            .agg(F.avg(value).alias(name)))


def map_values(df: DataFrame, col: str, mapping: Mapping, name: str, default=None) -> DataFrame:
    """Look values up in a small dictionary; unknown values become ``default``."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), F.col(col))
    return df.withColumn(name, F.coalesce(found, F.lit(default)))


def top_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows of a total order."""
    return df.orderBy(*order).limit(n)


def extreme_row(df: DataFrame, value: str, ties: Sequence[str], desc: bool = True) -> DataFrame:
    """The row with the largest (or smallest) value; nulls never win."""
    first = F.col(value).desc_nulls_last() if desc else F.col(value).asc_nulls_last()
    return df.orderBy(first, *ties).limit(1)


def argmin(df: DataFrame, metric: str, key: str) -> DataFrame:
    """Key with the smallest metric; the smallest key wins a tie."""
    best = F.min(F.struct(metric, key))
    return df.agg(best.alias("b")).select(f"b.{key}", f"b.{metric}")


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def union_all(a: DataFrame, b: DataFrame, rename: Mapping[str, str]) -> DataFrame:
    """Append ``b`` after renaming its columns."""
    return a.unionByName(b.withColumnsRenamed(dict(rename)).select(a.columns))


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once."""
    swapped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").union(swapped).distinct()


def outer_match_totals(a: DataFrame, b: DataFrame, code_a: str, code_b: str, name: str) -> DataFrame:
    """Row sums of the match matrix between two +1/-1 coded tables.

    sum over j of (a_i * b_j + 1) / 2 needs only the sum and the count of the
    other side, so no pair is built.
    """
    other = b.agg(F.sum(code_b).alias("s"), F.count(code_b).alias("n"))
    total = (F.col(code_a) * other.select("s").scalar() + other.select("n").scalar()) / 2
    return a.withColumn(name, total.cast("bigint"))
