"""Ordered computations whose partitions stay bounded under hot keys and ties.

A plain window puts all rows of a key into one task. Here rows are ranged by
(keys, whole sort order): cut rows drawn from a sample give every row a range
number, a window runs inside (keys, range), and only keys that a cut row falls
into have more than one range. A table with at most two rows per cut carries
sums or boundary rows of these keys from range to range, so that the rows
themselves are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import cut_lineage, partitions

#: Rows of the sample per range.
SAMPLE = 64
SAMPLE_SEED = 20240229


class desc(str):
    """Name of a sort column in descending order; nulls come last (ascending: first)."""


def _forward(order: Sequence[str]) -> list[Column]:
    return [F.desc(o) if isinstance(o, desc) else F.asc(o) for o in order]


def _backward(order: Sequence[str]) -> list[Column]:
    return [F.asc(o) if isinstance(o, desc) else F.desc(o) for o in order]


def _match(keys: Sequence[str], tag) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(tag(k))) for k in keys])


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "left") -> DataFrame:
    """Equi-join in which null keys match each other; ``right`` keeps only its payload."""
    if not keys:
        raise ValueError("keys must not be empty")
    tag = {k: f"__r_{k}" for k in keys}
    right = right.withColumnsRenamed(tag)
    return left.join(right, _match(keys, tag.get), how).drop(*tag.values())


class Ranges:
    """Ranges of a table by (keys, order): at most ``n``, of about equal numbers of rows.

    The cut rows are the quantiles of a sample of ``SAMPLE * n`` rows in expectation,
    drawn once, so that every use sees the same ones. Rows that are
    equal in all keys and sort columns share a range: give a total order.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int | None = None):
        self.keys, self.order = list(keys), list(order)
        self.n = n or partitions(df)
        columns = [*self.keys, *self.order]
        self.down = [isinstance(c, desc) for c in columns]
        names = [f"c{i}" for i in range(len(columns))]
        rows = df.select(*[F.col(c).alias(n) for c, n in zip(columns, names)])
        share = min(1.0, SAMPLE * self.n / max(rows.count(), 1))
        some = rows if share == 1.0 else rows.sample(share, SAMPLE_SEED)
        # plain windows: the sample's size follows n, not the rows
        sort = [F.desc(c) if d else F.asc(c) for c, d in zip(names, self.down)]
        some = some.withColumns({"place": F.row_number().over(Window.orderBy(*sort)),
                                 "size": F.count(F.lit(1)).over(Window.partitionBy())})
        part = lambda place: F.floor(place * F.lit(self.n) / F.col("size"))
        cuts = (some.filter((part(F.col("place")) > part(F.col("place") - 1)) & (F.col("place") < F.col("size")))
                .groupBy(*names).agg(F.min("place").alias("place"))
                .agg(F.array_sort(F.collect_list(F.struct("place", *names))).alias("cuts")))
        self.cuts = df.sparkSession.createDataFrame(cuts.toArrow(), cuts.schema)  # fewer than n cut rows

    def number(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with the number of each row's range: how many cut rows are not behind it, by bisection."""
        columns = [F.col(c) for c in [*self.keys, *self.order]]

        def behind(cut: Column) -> Column:  # the row comes before the cut row
            out = F.lit(False)
            for i in reversed(range(len(columns))):
                own, other = columns[i], cut[f"c{i}"]
                if self.down[i]:
                    less = F.coalesce(own > other, own.isNotNull() & other.isNull())
                else:
                    less = F.coalesce(own < other, own.isNull() & other.isNotNull())
                out = less | (own.eqNullSafe(other) & out)
            return out

        def step(found: Column, size: Column) -> Column:  # bisection by powers of two
            cut = F.get(F.col("__cuts"), found + size - 1)
            return F.when((found + size <= F.size("__cuts")) & ~behind(cut), found + size).otherwise(found)

        sizes = F.lit([1 << i for i in reversed(range(self.n.bit_length()))])
        return (df.withColumn("__cuts", self.cuts.scalar())
                .withColumn(name, F.aggregate(sizes, F.lit(0), step)).drop("__cuts"))

    def marked(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with a flag at the rows whose keys may have several ranges: those of a cut row."""
        if not self.keys:
            return df.withColumn(name, F.lit(True))
        cut = self.cuts.select(F.explode("cuts").alias("cut")).select(
            *[F.col(f"cut.c{i}").alias(k) for i, k in enumerate(self.keys)]).distinct().withColumn("__s", F.lit(True))
        # at most one row per range, whatever the data
        return null_safe_join(df, F.broadcast(cut), self.keys).withColumn(name, F.coalesce("__s", F.lit(False))).drop("__s")

    def spread(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose keys may have several ranges."""
        return self.marked(df, "__m").filter("__m").drop("__m")


def _ranged(df: DataFrame, keys: list[str], order: Sequence[str], chunk: Column | Ranges | None) -> tuple[DataFrame, DataFrame]:
    """``df`` with its range number ``__c``, and its rows whose keys may have several ranges."""
    if isinstance(chunk, Column):
        base = df.withColumn("__c", chunk)
        return base, base
    ranges = chunk or Ranges(df, keys, order)
    if keys:  # all rows of a key without a cut row share a range, so its number is not needed
        base = ranges.marked(df, "__cut")
        base = ranges.number(base, "__c").withColumn("__c", F.when(F.col("__cut"), F.col("__c")).otherwise(F.lit(0)))
        return base.drop("__cut"), base.filter("__cut").drop("__cut")
    base = ranges.number(df, "__c")
    return base, base


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column],
                 before: bool = False, chunk: Column | Ranges | None = None) -> DataFrame:
    """Running sums per key in sort order; ``before=True`` leaves the own row out.

    ``order`` names sort columns (``desc`` for a descending one). Known ranges may
    be given as ``chunk``: ``Ranges``, or a column that grows with the order.
    Nothing is summed to 0 where all values are null. The input is read three
    times (sample, carried sums, rows): cut its lineage where it is costly.
    """
    keys = list(keys)
    base, spread = _ranged(df, keys, order, chunk)
    values = {f"__v_{n}": v for n, v in sums.items()}
    up_to = Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (spread.withColumns(values).groupBy(*keys, "__c").agg(*[F.sum(v).alias(v) for v in values])
               .select(*keys, "__c", *[F.sum(f"__v_{n}").over(up_to).alias(f"__o_{n}") for n in sums]))
    local = (Window.partitionBy(*keys, "__c").orderBy(*_forward(order))
             .rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    out = base.withColumns(values).withColumns({f"__l_{n}": F.sum(f"__v_{n}").over(local) for n in sums})
    out = null_safe_join(out, _small(offsets, chunk), [*keys, "__c"])
    zero = F.lit(0)
    out = out.withColumns({n: F.coalesce(F.col(f"__l_{n}"), zero) + F.coalesce(F.col(f"__o_{n}"), zero) for n in sums})
    return out.drop("__c", *[f"__{p}_{n}" for n in sums for p in "vlo"])


def _small(carried: DataFrame, chunk: Column | Ranges | None) -> DataFrame:
    """Carried rows; with ranges of a sample they number two per cut at most, and are broadcast."""
    return carried if isinstance(chunk, Column) else F.broadcast(carried)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn",
                chunk: Column | Ranges | None = None) -> DataFrame:
    """1-based position per key in sort order; give a total order."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("bigint")}, chunk=chunk)


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], lags: dict[str, str] | None = None,
               leads: dict[str, str] | None = None) -> DataFrame:
    """Previous (``lags[name] = column``) and next (``leads``) values per key.

    The last and the first row of every (key, range) travel to the neighbouring
    range of the key; give a total order.
    """
    lags, leads, keys = lags or {}, leads or {}, list(keys)
    base, spread = _ranged(df, keys, order, None)
    local = Window.partitionBy(*keys, "__c").orderBy(*_forward(order))
    across = Window.partitionBy(*keys).orderBy("__c")
    out, helpers = base, []
    for side, wanted, shift in (("p", lags, F.lag), ("n", leads, F.lead)):
        if not wanted:
            continue
        out = out.withColumns({f"__{side}e": shift(F.lit(1)).over(local).isNull(),
                               **{f"__{side}l_{n}": shift(c).over(local) for n, c in wanted.items()}})
        ends = Window.partitionBy(*keys, "__c").orderBy(*(_backward(order) if side == "p" else _forward(order)))
        edge = (spread.select(*keys, "__c", *[o for o in order if o not in keys],
                              *[F.col(c).alias(f"__v_{n}") for n, c in wanted.items()])
                .withColumn("__rn", F.row_number().over(ends)).filter("__rn = 1")
                .select(*keys, "__c", *[shift(f"__v_{n}").over(across).alias(f"__{side}o_{n}") for n in wanted]))
        out = null_safe_join(out, F.broadcast(edge), [*keys, "__c"])
        out = out.withColumns({n: F.when(F.col(f"__{side}e"), F.col(f"__{side}o_{n}")).otherwise(F.col(f"__{side}l_{n}"))
                               for n in wanted})
        helpers += [f"__{side}e", *[f"__{side}{x}_{n}" for n in wanted for x in "lo"]]
    return out.drop("__c", *helpers)


def _cumulated(df: DataFrame, col: str, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """Distinct values ``__x`` per ``by`` with their count ``__n``, running count ``__cum`` and ``__total``."""
    size = F.sum(weight) if weight else F.count(F.lit(1))
    counts = cut_lineage(df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("__x")).agg(size.alias("__n")))
    cum = running_sums(counts, by, ["__x"], {"__cum": F.col("__n")})
    total = counts.groupBy(*by).agg(F.sum("__n").alias("__total"))
    return null_safe_join(cum, total, by) if by else cum.withColumn("__total", total.scalar())


def quantiles(df: DataFrame, col: str, probs: dict[str, float],
              by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs``.

    Equal values are counted first, so ties cost one row; positions come from
    running counts, so no group is ever gathered in one buffer.
    """
    by = list(by)
    cum = _cumulated(df, col, by)
    x, hi = F.col("__x").cast("double"), F.col("__cum")
    lo = hi - F.col("__n")
    aggs = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("__total") - 1)
        at = lambda k: F.max(F.when((lo <= k) & (k < hi), x))
        low, high = at(F.floor(pos)), at(F.ceil(pos))
        frac = F.max(pos - F.floor(pos))
        aggs.append((low + (high - low) * frac).alias(name))
    return cum.groupBy(*by).agg(*aggs) if by else cum.agg(*aggs)


def order_statistic(df: DataFrame, col: str, p: float, name: str, by: Sequence[str] = (),
                    weight: str | None = None) -> DataFrame:
    """The value at position ``ceil(p * n)`` in ascending order, per ``by``; ``weight`` counts a row's equals."""
    by = list(by)
    cum = _cumulated(df, col, by, weight)
    k = F.ceil(F.lit(p) * F.col("__total"))
    return cum.filter((F.col("__cum") - F.col("__n") < k) & (k <= F.col("__cum"))).select(
        *by, F.col("__x").alias(name))
