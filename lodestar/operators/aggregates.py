"""Profiles, counts, concentration and reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.columns import n_rows
from lodestar.operators.ordered import null_safe_join, quantiles



def _stack(df: DataFrame, rows: Sequence[tuple[str, Sequence[Column]]], names: Sequence[str],
           label: str = "column") -> DataFrame:
    """Turn a one-row frame into one row per entry of ``rows``."""
    items = F.array(*[F.struct(F.lit(k).alias(label), *[v.alias(n) for n, v in zip(names, vals)])
                      for k, vals in rows])
    return df.select(F.explode(items).alias("s")).select("s.*")


def share_over(df: DataFrame, group: Sequence[str], pred: Column, min_n: int = 0) -> DataFrame:
    """Share of rows meeting ``pred`` per group; groups with fewer than ``min_n`` hits drop out."""
    return (df.groupBy(*group)
            .agg(F.avg(pred.cast("int")).alias("share"), n_rows().alias("n"), F.count_if(pred).alias("__hits"))
            .filter(F.col("__hits") >= min_n).drop("__hits"))


def groups_with_variation(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Groups whose smallest and largest value differ."""
    return (df.groupBy(*keys).agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
            .filter("__lo <> __hi").drop("__lo", "__hi"))


def mean_by_flag(df: DataFrame, entity: str, value: str, pred: Column, flag: str, name: str) -> DataFrame:
    """Flag each entity that has any row with ``pred``; average ``value`` over entities by flag."""
    per = df.groupBy(entity, value).agg(F.max(pred.cast("int")).alias(flag))
    return per.groupBy(flag).agg(F.avg(value).alias(name))


def profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, min, max, mean, sample variance, skewness, excess kurtosis per column; one pass."""
    stats = {"nobs": F.count, "min": F.min, "max": F.max, "mean": F.avg, "variance": F.var_samp,
             "skewness": F.skewness, "kurtosis": F.kurtosis}
    one = df.agg(*[fn(F.col(c).cast("double")).alias(f"{c}__{s}") for c in cols for s, fn in stats.items()])
    return _stack(one, [(c, [F.col(f"{c}__{s}") for s in stats]) for c in cols], list(stats))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sd, min, quartiles and max per column; quartiles are exact."""
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    one = df.agg(*[fn(F.col(c).cast("double")).alias(f"{c}__{s}") for c in cols for s, fn in stats.items()])
    base = _stack(one, [(c, [F.col(f"{c}__{s}") for s in stats]) for c in cols], list(stats))
    long = unpivot(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), [], cols)
    quarts = quantiles(long, "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}, by=["column"])
    return base.join(quarts, "column")


def null_counts(df: DataFrame) -> DataFrame:
    """Null count and any-null flag per column."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _stack(one, [(c, [F.col(c), (F.col(c) > 0).cast("int")]) for c in df.columns],
                  ["nulls", "any_null"])


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Frequency of every value of every named column, long form."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    return unpivot(texts, [], cols).groupBy("column", "value").agg(n_rows().alias("n"))


def crosstab(df: DataFrame, col: str, target: str) -> DataFrame:
    """Counts of a column split by a 0/1 target, with the share of ones."""
    ones = F.count_if(F.col(target) == 1)
    return df.groupBy(col).agg(F.count_if(F.col(target) == 0).alias("n0"), ones.alias("n1"),
                               (ones / n_rows()).alias("share1"))


def corr_matrix(df: DataFrame, cols: Sequence[str], against: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlations over complete cases, long form; ``against`` asks for a block."""
    pairs = [(a, b) for a in cols for b in against] if against else list(combinations(cols, 2))
    used = sorted({c for p in pairs for c in p})
    complete = df.select(*[F.col(c).cast("double").alias(c) for c in used]).na.drop()
    one = complete.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr"))
                      for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(items).alias("s")).select("s.*")


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal-width bins between the overall minimum and maximum."""
    span = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    x = F.col(col).cast("double")
    bin_no = F.least(F.floor(F.try_divide((x - lo) * bins, hi - lo)), F.lit(bins - 1))
    rows = df.filter(F.col(col).isNotNull()).select(
        *by, F.coalesce(bin_no, F.lit(0)).cast("bigint").alias("bin"))
    counts = rows.groupBy(*by, "bin").agg(n_rows().alias("n"))
    return counts.withColumn("left_edge", lo + F.col("bin") * (hi - lo) / bins)


def binned_mean(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Mean of ``y`` by nearest of ``bins`` evenly spaced quantiles of ``x``."""
    probs = {f"p{i}": i / (bins + 1) for i in range(1, bins + 1)}
    centres = list(quantiles(df, x, probs).first())
    nearest = F.array_min(F.array(*[
        F.struct(F.abs(F.col(x) - F.lit(c)).alias("gap"), F.lit(c).alias("centre")) for c in centres]))
    return (df.filter(F.col(x).isNotNull()).groupBy(nearest["centre"].alias("centre"))
            .agg(F.avg(y).alias("mean"), n_rows().alias("n")))


def category_signal(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Per column: how much the target mean varies across its categories."""
    texts = df.select(F.col(target).cast("double").alias("__t"),
                      *[F.col(c).cast("string").alias(c) for c in cols])
    means = (unpivot(texts, ["__t"], cols).groupBy("column", "value").agg(F.avg("__t").alias("m")))
    return means.groupBy("column").agg(n_rows().alias("categories"), F.var_samp("m").alias("signal"))


def category_counts(df: DataFrame, cols: Sequence[str], pct: float) -> DataFrame:
    """Per column: number of categories and number holding at least ``pct`` of the rows."""
    counts = value_counts(df, cols)
    need = F.lit(pct) * df.agg(n_rows().alias("n")).scalar()
    return counts.groupBy("column").agg(n_rows().alias("categories"), F.count_if(F.col("n") >= need).alias("frequent"))


def categories(df: DataFrame, col: str) -> list:
    """The values of a category column, sorted (one small driver list, one entry per column of a wide table)."""
    return [r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col).collect()]


def pivot(df: DataFrame, row: Sequence[str], col: str, values: Sequence | None = None,
          presence: bool = False) -> DataFrame:
    """Long to wide counts over all values of ``col`` (or the given ones); 0/1 with ``presence``."""
    values = categories(df, col) if values is None else values
    cells = [F.count_if(F.col(col) == v) for v in values]
    if presence:
        cells = [F.least(c, F.lit(1)) for c in cells]
    return df.groupBy(*row).agg(*[c.cast("bigint").alias(str(v)) for c, v in zip(cells, values)])


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(values), "column", "value")


def hhi(df: DataFrame, keys: Sequence[str], member: str, weight: Column) -> DataFrame:
    """Concentration: sum of squared percentage shares of the members of a key."""
    parts = df.groupBy(*keys, member).agg(F.sum(weight).alias("w"))
    return parts.groupBy(*keys).agg(
        (F.sum(F.col("w") * F.col("w")) * 10000 / F.pow(F.sum("w"), 2)).alias("hhi"))


def ratio_of_sums(df: DataFrame, keys: Sequence[str], a: Column, b: Column, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.try_divide(F.sum(a), F.sum(b)).alias(name))


def with_group_agg(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Group aggregates next to every row.

    Aggregates first and joins back, so a hot key is summed map-side and the
    join can be split; a window would bring the whole key into one task.
    """
    return null_safe_join(df, df.groupBy(*keys).agg(*aggs), keys)


def top_categories(df: DataFrame, col: str, n: int, flag: str) -> DataFrame:
    """1 for rows in the ``n`` most frequent non-blank values (ties by value)."""
    named = df.filter(F.nullif(F.col(col), F.lit("")).isNotNull())
    top = (named.groupBy(col).agg(n_rows().alias("__n")).orderBy(F.desc("__n"), F.asc(col)).limit(n)
           .select(col, F.lit(1).alias(flag)))
    return df.join(top, col, "left").na.fill(0, [flag])


def diversification(df: DataFrame, keys: Sequence[str], dist: Column, name: str) -> DataFrame:
    """1 - 1 / (1 + mean distance)."""
    return df.groupBy(*keys).agg((1 - 1 / (1 + F.avg(dist))).alias(name))


def mean_of_means(df: DataFrame, outer: Sequence[str], inner: Sequence[str], value: str, name: str) -> DataFrame:
    """Average per (outer, inner), then average of those per outer."""
    return (df.groupBy(*outer, *inner).agg(F.avg(value).alias("__m"))
            .groupBy(*outer).agg(F.avg("__m").alias(name)))


def mean_by_type(df: DataFrame, time: str, kind: str, value: str, kinds: Sequence[str] | None = None) -> DataFrame:
    """One row per time, one column with the mean per type, for all types (or the given ones)."""
    kinds = categories(df, kind) if kinds is None else kinds
    return df.groupBy(time).agg(*[F.avg(F.when(F.col(kind) == k, F.col(value))).alias(k) for k in kinds])
