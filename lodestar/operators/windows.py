"""Time gaps, running values, scores and spans.

Panels (one row per entity and period) use plain windows, whose partitions are
as long as the number of periods. Event-level work uses ``ordered``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.aggregates import with_group_agg
from lodestar.operators.ordered import desc, neighbours, null_safe_join, quantiles, row_numbers, running_sums
from lodestar.session import cut_lineage


def panel_window(entity: Sequence[str], time: str):
    return Window.partitionBy(*entity).orderBy(time)


def panel_lags(panel: DataFrame, entity: Sequence[str], time: str, cols: Sequence[str],
               steps: Sequence[int] = (1,)) -> DataFrame:
    """Lagged copies ``col_lag<k>`` within an entity of a panel."""
    w = panel_window(entity, time)
    return panel.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in cols for k in steps})


def gap_to_next(df: DataFrame, keys: Sequence[str], order: Sequence[str], gap, name: str) -> DataFrame:
    """``gap(next, current)`` of the first sort column, null for the last row of a key."""
    out = neighbours(df, keys, order, leads={"next_time": order[0]})
    return out.withColumn(name, gap(F.col("next_time"), F.col(order[0]))).drop("next_time")


def lead_ratio(panel: DataFrame, entity: Sequence[str], time: str, value: str, name: str) -> DataFrame:
    """Next period's value over the current one."""
    return panel.withColumn(name, F.try_divide(F.lead(value).over(panel_window(entity, time)), F.col(value)))


def rolling_mean(panel: DataFrame, entity: Sequence[str], time: str, value: str, n: int, name: str) -> DataFrame:
    """Mean of the last ``n`` rows, shorter at the start."""
    return panel.withColumn(name, F.avg(value).over(panel_window(entity, time).rowsBetween(1 - n, 0)))


def running_ratio(df: DataFrame, keys: Sequence[str], order: Sequence[str], a: Column, b: Column,
                  name: str) -> DataFrame:
    """Running sum of ``a`` over running sum of ``b``."""
    out = running_sums(df, keys, order, {"run_a": a, "run_b": b})
    return out.withColumn(name, F.try_divide(F.col("run_a").cast("double"), F.col("run_b").cast("double"))
                          ).drop("run_a", "run_b")


def zscore(df: DataFrame, col: str, keys: Sequence[str], name: str) -> DataFrame:
    """Score within a group; the raw value where the deviation is null or zero."""
    out = with_group_agg(df, keys, [F.avg(col).alias("__m"), F.stddev_samp(col).alias("__s")])
    score = F.try_divide(F.col(col) - F.col("__m"), F.col("__s"))
    return out.withColumn(name, F.coalesce(score, F.col(col))).drop("__m", "__s")


def similarity_z(df: DataFrame, distance: str, name: str) -> DataFrame:
    """Distances flipped to 1 - d/max, then standardised over the whole table."""
    sim = df.withColumn("__sim", 1 - F.col(distance) / df.agg(F.max(distance).alias("m")).scalar())
    stats = sim.agg(F.avg("__sim").alias("m"), F.stddev_samp("__sim").alias("s"))
    return sim.withColumn(name, (F.col("__sim") - stats.select("m").scalar()) / stats.select("s").scalar()
                          ).drop("__sim")


def above_group_quantile(df: DataFrame, keys: Sequence[str], col: str, p: float, flag: str,
                         reach: bool = False) -> DataFrame:
    """1 when the value exceeds the group's exact quantile, with ``reach`` also when it equals it."""
    cut = quantiles(df, col, {"__cut": p}, by=keys)
    over = F.col(col) >= F.col("__cut") if reach else F.col(col) > F.col("__cut")
    return null_safe_join(df, cut, keys).withColumn(flag, over.cast("int")).drop("__cut")


def novelty(df: DataFrame, keys: Sequence[str], time: str, span: int, flag: str) -> DataFrame:
    """1 while less than ``span`` after the first appearance of the key."""
    out = with_group_agg(df, keys, [F.min(time).alias("__first")])
    return out.withColumn(flag, (F.col(time) - F.col("__first") < span).cast("int")).drop("__first")


def age(df: DataFrame, keys: Sequence[str], time: str, name: str, first_flag: str | None = None) -> DataFrame:
    """Time since the first observation of the key; optionally a first-time flag."""
    out = with_group_agg(df, keys, [F.min(time).alias("__first")])
    out = out.withColumn(name, F.col(time) - F.col("__first"))
    if first_flag:
        out = out.withColumn(first_flag, (F.col(time) == F.col("__first")).cast("int"))
    return out.drop("__first")


def earliest_valid(df: DataFrame, keys: Sequence[str], time: str, valid: Column, name: str) -> DataFrame:
    """Earliest valid time per key, else the earliest time."""
    first = F.coalesce(F.min(F.when(valid, F.col(time))), F.min(time))
    return with_group_agg(df, keys, [first.alias(name)])


def activity_span(df: DataFrame, key: str, time: str) -> DataFrame:
    """Join and leave period per entity, counted from the first period of all.

    An entity leaves in the period after its last one, unless that lies past the
    last period of all.
    """
    ends = df.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    base, end = ends.select("lo").scalar(), ends.select("hi").scalar()
    return df.groupBy(key).agg(F.min(time).alias("__lo"), F.max(time).alias("__hi")).select(
        key, (F.col("__lo") - base + 1).alias("join"),
        F.least(F.col("__hi") - base + 2, end - base + 1).alias("leave"))


def frequency_rank(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rank of every category of every column, 1 = most frequent, ties by value."""
    from lodestar.operators.aggregates import value_counts
    return row_numbers(cut_lineage(value_counts(df, cols)), ["column"], [desc("n"), "value"], "rank")


def standing_advice(events: DataFrame, time: str, kind: str, low: str, high: str,
                    width: str = "15 minutes") -> DataFrame:
    """Advice per window from the counts of two activities.

    With both present: "yes" when the later kind occurs less often than the
    earlier one. With one present: "yes" only when it is ``low``.
    """
    counts = (events.filter(F.col(kind).isin(low, high))
              .groupBy(F.window(time, width).alias("w"))
              .agg(F.count_if(F.col(kind) == low).alias("n_low"), F.count_if(F.col(kind) == high).alias("n_high")))
    both = (F.col("n_low") > 0) & (F.col("n_high") > 0)
    advice = F.when(both & (F.col("n_high") < F.col("n_low")), "yes").when(
        ~both & (F.col("n_low") > 0), "yes").otherwise("no")
    return counts.select(F.col("w.start").alias("start"), advice.alias("recommend_standing"))


def movement_advice(events: DataFrame, time: str, kind: str, axes: Sequence[str],
                    width: str = "15 minutes") -> DataFrame:
    """"yes" when the distance between the mean positions of consecutive windows shrinks.

    The unpartitioned window runs over one row per time window, after aggregation.
    """
    per_kind = events.groupBy(F.window(time, width).alias("w"), kind).agg(
        *[F.avg(a).alias(a) for a in axes])
    means = per_kind.groupBy(F.col("w.start").alias("start")).agg(*[F.avg(a).alias(a) for a in axes])
    w = Window.orderBy("start")
    square = sum((F.pow(F.col(a) - F.lag(a).over(w), 2) for a in axes), F.lit(0.0))
    moved = means.withColumn("dist", F.sqrt(square)).withColumn("prev", F.lag("dist").over(w))
    return moved.select("start", "dist",
                        F.when(F.col("dist") < F.col("prev"), "yes").otherwise("no").alias("recommend_moving"))
