"""Network construction, projection, decay and similarity.

Two-mode data is never expanded into all member pairs of a group: projections
stay factored (group sums minus the own part), and ``pairs`` has statistics of
member pairs in sparse form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.columns import n_rows
from lodestar.operators.ordered import neighbours, order_statistic
from lodestar.operators.relational import symmetrize
from lodestar.session import cut_lineage


#: Arcs of a node that are kept in one row.
BUNDLE = 4_096


def bundled(arcs: DataFrame, by: Sequence[str], entry: Column, once: bool = False) -> DataFrame:
    """(by, src, arcs): lists of ``entry`` over the arcs of a node, so that a join with nodes moves few rows.

    The arcs of a node with more than ``BUNDLE`` are dealt to several lists;
    ``once`` keeps one of equal entries. Cut the lineage of ``arcs`` before.
    """
    arcs = arcs.filter("src is not null")
    many = cut_lineage(arcs.groupBy(*by, "src").agg(F.ceil(n_rows() / BUNDLE).alias("__n")).filter("__n > 1"))
    part = F.pmod(F.xxhash64("dst"), F.coalesce("__n", F.lit(1)))
    return cut_lineage(arcs.join(many, [*by, "src"], "left").withColumn("__p", part).groupBy(*by, "src", "__p")
                       .agg((F.collect_set if once else F.collect_list)(entry).alias("arcs")).drop("__p"))


def graph(ties: DataFrame, src: str, dst: str, weight: str,
          vertices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices and weighted edges of a tie table; zero ties drop out, isolates stay."""
    edges = (ties.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(weight).cast("double").alias("weight"))
             .filter("weight > 0"))
    if vertices is None:
        vertices = ties.select(F.col(src).alias("id")).union(ties.select(F.col(dst).alias("id"))).distinct()
    return vertices, edges


def transition_edges(df: DataFrame, entity: str, node: str, order: Sequence[str]) -> DataFrame:
    """Directed edges between consecutive nodes of each entity, weighted by how often they occur."""
    nxt = neighbours(df, [entity], order, leads={"dst": node})
    return (nxt.filter(F.col("dst") != F.col(node))
            .groupBy(F.col(node).alias("src"), "dst").agg(n_rows().cast("double").alias("weight")))


def undirected(edges: DataFrame) -> DataFrame:
    """One row per unordered tie, weights of both directions added."""
    return (edges.filter("src <> dst")
            .groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
            .agg(F.sum("weight").alias("weight")))


def projection_strength(df: DataFrame, group: str, member: str, name: str = "strength") -> DataFrame:
    """Number of ties of every member in the one-mode projection, counted with multiplicity.

    A member of a group of n has n - 1 ties there; no pair is written out.
    """
    members = df.select(group, member).distinct()
    sizes = members.groupBy(group).agg((n_rows() - 1).alias("__t"))
    return members.join(sizes, group).groupBy(member).agg(F.sum("__t").alias(name))


def projection_sum(df: DataFrame, group: str, member: str, values: DataFrame, value: str, name: str) -> DataFrame:
    """Sum of a value over all projection ties of each member: group totals minus the own part."""
    members = df.select(group, member).distinct().join(values.select(member, value), member)
    totals = members.groupBy(group).agg(F.sum(value).alias("__s"))
    return (members.join(totals, group).groupBy(member)
            .agg(F.sum(F.col("__s") - F.col(value)).alias(name)))


def projection_ties(df: DataFrame, group: str, member: str) -> DataFrame:
    """Total number of tied pairs over all groups, n * (n - 1) / 2 each."""
    sizes = df.select(group, member).distinct().groupBy(group).agg(n_rows().alias("n"))
    return sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("ties"))


def bipartite_panel(df: DataFrame, sender: str, receiver: str, time: str) -> DataFrame:
    """Distinct ties per period in sparse form; absent combinations are zero."""
    return df.select(F.col(time).alias("period"), F.col(sender).alias("sender"),
                     F.col(receiver).alias("receiver")).distinct().withColumn("tie", F.lit(1))


def bipartite_totals(panel: DataFrame, senders: DataFrame, sender: str) -> DataFrame:
    """Ties per period and sender over the whole vertex set; senders without ties count 0."""
    periods = panel.select("period").distinct()
    span = periods.agg(F.array_sort(F.collect_set("period")).alias("p"))
    cells = senders.select(F.col(sender).alias("sender")).withColumn("period", F.explode(span.scalar()))
    counts = panel.groupBy("period", "sender").agg(F.sum("tie").alias("ties"))
    return cells.join(counts, ["period", "sender"], "left").na.fill(0, ["ties"])


def decay_ties(links: DataFrame, a: str, b: str, time: str, now: Column, share: float = 0.9,
               keep_all_below: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Ties not older than the ``share`` order statistic of the renewal gaps, latest per pair.

    With at most ``keep_all_below`` distinct renewals there is no threshold and
    every tie stays. With ``by`` (e.g. a snapshot year, see ``snapshots``) every
    snapshot has its own threshold, and ``now`` may depend on it.
    """
    by = list(by)
    group = by or ["__all"]
    rows = links if by else links.withColumn("__all", F.lit(0))
    rows = cut_lineage(rows.select(*group, a, b, time))
    gaps = (neighbours(rows, [*group, a, b], [time], leads={"__next": time}).filter(F.col("__next").isNotNull())
            .select(*group, a, b, time, F.datediff("__next", time).alias("gap")))
    # one row per snapshot and number of days
    counts = cut_lineage(gaps.groupBy(*group, "gap").agg(n_rows().alias("__k")))
    # a repeated tie has its next one on the same day, so that only gaps of 0 can be equal rows
    renewals = counts.select(*group, F.when(F.col("gap") == 0, 0).otherwise(F.col("__k")).alias("__n"))
    if counts.filter("gap = 0").limit(1).count():
        renewals = renewals.unionByName(gaps.filter("gap = 0").distinct().select(*group, F.lit(1).cast("bigint").alias("__n")))
    limits = (renewals.groupBy(*group).agg(F.sum("__n").alias("__n"))
              .join(order_statistic(counts, "gap", share, "__limit", group, weight="__k"), group))
    # one row per snapshot: a shuffled join would deal all ties by so few keys
    aged = rows.join(F.broadcast(cut_lineage(limits)), group, "left").withColumn("age", F.datediff(now, F.col(time)))
    few = F.coalesce("__n", F.lit(0)) <= keep_all_below
    all_ties = aged.filter(few).select(*group, a, b, time, "age")
    trimmed = (aged.filter(~few & (F.col("age") <= F.col("__limit"))).groupBy(*group, a, b)
               .agg(F.max(time).alias(time), F.min("age").alias("age")))
    return all_ties.unionByName(trimmed).drop("__all")


def decay_fixed(links: DataFrame, keys: Sequence[str], order: Sequence[str], width: int) -> DataFrame:
    """Ties renewed within ``width`` periods, and the last tie of every pair."""
    out = neighbours(links, keys, order, leads={"__next": order[0]})
    return out.filter(F.col("__next").isNull() | (F.col("__next") - F.col(order[0]) <= width)).drop("__next")


def label_strength(edges: DataFrame) -> DataFrame:
    """Strong when the weight is above the mean weight, else Weak."""
    mean = edges.agg(F.avg("weight").alias("m")).scalar()
    return edges.withColumn("strength", F.when(F.col("weight") > mean, "Strong").otherwise("Weak"))


def recency_weight(size: Column, age: Column, floor: float = 1e-7) -> Column:
    """Size * 100 / age, never below ``floor``."""
    w = F.try_divide(size * 100, age.cast("double"))
    return F.when(w > 0, w).otherwise(F.lit(floor))


def stc_violations(strong: DataFrame) -> DataFrame:
    """Strong ties that break strong triadic closure.

    A tie i-a breaks closure when i has another strong tie to b without a strong
    tie a-b, or the same seen from a. So it holds exactly when i and a have the
    same closed neighbourhood, which is compared as a set fingerprint (size,
    smallest, largest and two 64-bit hashes): no open triad is written out.
    """
    ties = strong.filter("src <> dst").select(F.least("src", "dst").alias("src"),
                                              F.greatest("src", "dst").alias("dst")).distinct()
    arcs = symmetrize(ties)
    closed = arcs.union(arcs.select("src", F.col("src").alias("dst")).distinct())
    marks = closed.groupBy(F.col("src").alias("node")).agg(F.struct(
        n_rows().alias("n"), F.min("dst").alias("lo"), F.max("dst").alias("hi"),
        F.bit_xor(F.xxhash64("dst")).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit("b"), "dst")).alias("h2")).alias("f"))
    left = marks.select(F.col("node").alias("src"), F.col("f").alias("fa"))
    right = marks.select(F.col("node").alias("dst"), F.col("f").alias("fb"))
    return ties.join(left, "src").join(right, "dst").filter("fa <> fb").select("src", "dst")


def collab_type(df: DataFrame, group: str, central: Column) -> DataFrame:
    """Solo or joint group, made by central, peripheral or both kinds of members."""
    g = df.groupBy(group).agg(n_rows().alias("members"), F.count_if(central).alias("n_central"))
    solo, c, m = F.col("members") == 1, F.col("n_central"), F.col("members")
    kind = (F.when(solo & (c == 1), "solo_central").when(solo, "solo_peripheral")
            .when(c == m, "joint_central").when(c == 0, "joint_peripheral").otherwise("joint_hybrid"))
    return g.withColumn("kind", kind)


def components(edges: DataFrame, vertices: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """Connected component (smallest node) of every node: neighbour minimum, then a pointer jump.

    Only nodes whose label changed send it, and only to neighbours behind it in order.
    """
    ties = cut_lineage(edges.select("src", "dst"))
    arcs = ties.union(ties.select("dst", "src"))
    out = bundled(arcs, [], F.col("dst"), once=True)
    nodes = arcs.select(F.col("src").alias("node")).distinct() if vertices is None else \
        vertices.select(F.col(vertices.columns[0]).alias("node")).distinct()
    labels = cut_lineage(nodes.select("node", F.col("node").alias("comp"), F.lit(True).alias("fresh")))
    for _ in range(max_rounds):
        seen = (out.join(labels.filter("fresh").select(F.col("node").alias("src"), "comp"), "src")
                .select(F.explode("arcs").alias("node"), "comp").filter("comp < node"))
        low = cut_lineage(labels.select("node", "comp", F.col("comp").alias("old"))
                          .unionByName(seen.withColumn("old", F.lit(None).cast(labels.schema["comp"].dataType)))
                          .groupBy("node").agg(F.min("comp").alias("comp"), F.max("old").alias("old"))
                          .filter("old is not null"))
        jump = low.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        low = low.join(jump, "comp").withColumn("comp", F.least("comp", "root"))
        labels = cut_lineage(low.select("node", "comp", (F.col("comp") < F.col("old")).alias("fresh")))
        if not labels.filter("fresh").limit(1).count():
            return labels.drop("fresh")
    raise RuntimeError("components did not settle; raise max_rounds")


def unreachable_pairs(labels: DataFrame) -> DataFrame:
    """Ordered pairs of nodes without a path, from component sizes."""
    sizes = labels.groupBy("comp").agg(n_rows().alias("n"))
    return sizes.agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).cast("bigint").alias("unreachable"))
