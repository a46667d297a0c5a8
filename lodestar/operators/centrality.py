"""Node and edge measures. Edges are (src, dst, weight), with optional extra ``by`` keys.

Every loop is a join and a sum over the edge table; state goes through the
reliable checkpoint between rounds, and only scalars reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestar.functions.columns import n_rows
from lodestar.operators.networks import bundled, undirected
from lodestar.operators.ordered import desc, running_sums
from lodestar.session import cut_lineage, discard

EPS = 1e-9


def both_ways(edges: DataFrame) -> DataFrame:
    """Arcs in both directions of undirected edges."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).union(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def nodes_of(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    ends = edges.select(*by, F.col("src").alias("node")).union(edges.select(*by, F.col("dst").alias("node")))
    return ends.distinct()


def degree(edges: DataFrame, vertices: DataFrame, mode: str = "all", normalized: bool = True) -> DataFrame:
    """In, out or total degree, divided by n - 1; isolates get 0."""
    ends = {"out": ["src"], "in": ["dst"], "all": ["src", "dst"]}[mode]
    tall = reduce(DataFrame.union, [edges.select(F.col(e).alias("node")) for e in ends])
    counts = tall.groupBy("node").agg(n_rows().alias("degree"))
    return _per_vertex(counts, vertices, "degree", normalized)


def strength(edges: DataFrame, vertices: DataFrame, mode: str = "out", normalized: bool = True) -> DataFrame:
    """Sum of weights over n - 1."""
    ends = {"out": ["src"], "in": ["dst"], "all": ["src", "dst"]}[mode]
    tall = reduce(DataFrame.union, [edges.select(F.col(e).alias("node"), "weight") for e in ends])
    sums = tall.groupBy("node").agg(F.sum("weight").alias("strength"))
    return _per_vertex(sums, vertices, "strength", normalized)


def _per_vertex(values: DataFrame, vertices: DataFrame, name: str, normalized: bool) -> DataFrame:
    nodes = vertices.select(F.col(vertices.columns[0]).alias("node")).distinct()
    out = nodes.join(values, "node", "left").na.fill(0, [name])
    if normalized:
        out = out.withColumn(name, F.col(name) / (nodes.agg(n_rows().alias("n")).scalar() - 1))
    return out


def distances(edges: DataFrame, sources: DataFrame, by: Sequence[str] = (), max_rounds: int = 10_000) -> DataFrame:
    """Shortest distances from each source along arcs; weights are lengths.

    One row per (source, reached node); pass the sources in batches on a large
    graph. Each round extends only the nodes improved in the round before.
    """
    by = list(by)
    arcs = edges.select(*by, F.col("src").alias("node"), "dst", "weight")
    state = cut_lineage(sources.select(*by, "source", F.col("source").alias("node"), F.lit(0.0).alias("dist"),
                                       F.lit(True).alias("fresh")))
    for _ in range(max_rounds):
        reach = (state.filter("fresh").join(arcs, [*by, "node"])
                 .select(*by, "source", F.col("dst").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"))
                 .groupBy(*by, "source", "node").agg(F.min("dist").alias("dist")))
        old = state.select(*by, "source", "node", "dist", F.col("dist").alias("before"))
        merged = (old.unionByName(reach.withColumn("before", F.lit(None).cast("double")))
                  .groupBy(*by, "source", "node").agg(F.min("dist").alias("dist"), F.min("before").alias("before")))
        state = cut_lineage(merged.select(
            *by, "source", "node", "dist",
            (F.col("before").isNull() | (F.col("dist") < F.col("before"))).alias("fresh")))
        if not state.filter("fresh").limit(1).count():
            return state.drop("fresh")
    raise RuntimeError("distances did not settle; raise max_rounds")


def closeness(dist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """1 / sum of the distances to reachable nodes."""
    return (dist.groupBy(*by, F.col("source").alias("node"))
            .agg(F.try_divide(F.lit(1.0), F.sum("dist")).alias("closeness")))


def _shortest_paths(edges: DataFrame, sources: DataFrame):
    """Tight arcs per source, path counts per (source, node) and their back sums."""
    dist = distances(edges, sources)
    head = dist.select("source", F.col("node").alias("src"), F.col("dist").alias("ds"))
    tail = dist.select("source", F.col("node").alias("dst"), F.col("dist").alias("dd"))
    tight = cut_lineage(
        edges.join(head, "src").join(tail, ["source", "dst"])
        .filter(F.abs(F.col("ds") + F.col("weight") - F.col("dd")) <= EPS * (1 + F.col("dd")))
        .select("source", "src", "dst"))
    start = sources.select("source", F.col("source").alias("node"), F.lit(1.0).alias("v"))
    sigma = _walk_sums(start, tight, "src", "dst").withColumnRenamed("v", "sigma")
    sigma = cut_lineage(sigma)
    seed = sigma.filter("source <> node").select("source", "node", (1 / F.col("sigma")).alias("v"))
    total = _walk_sums(seed, tight, "dst", "src").withColumnRenamed("v", "back")
    return tight, sigma, cut_lineage(total)


def _walk_sums(start: DataFrame, tight: DataFrame, at: str, to: str) -> DataFrame:
    """Sum over all walk lengths of ``start`` pushed along the (acyclic) tight arcs."""
    step, acc = start, start
    while True:
        step = cut_lineage(step.withColumnRenamed("node", at).join(tight, ["source", at])
                           .groupBy("source", F.col(to).alias("node")).agg(F.sum("v").alias("v")))
        if not step.limit(1).count():
            return acc.groupBy("source", "node").agg(F.sum("v").alias("v"))
        acc = acc.unionByName(step)


def betweenness(edges: DataFrame, sources: DataFrame | None = None, is_directed: bool = False,
                normalized: bool = True) -> DataFrame:
    """Node betweenness by dependency sums; ``edges`` are undirected ties unless ``is_directed``.

    dependency(s, u) = paths(s, u) * sum over later nodes v on paths through u of 1 / paths(s, v).
    """
    arcs = edges if is_directed else both_ways(edges)
    nodes = nodes_of(arcs)
    sources = sources if sources is not None else nodes.select(F.col("node").alias("source"))
    _, sigma, back = _shortest_paths(arcs.select("src", "dst", "weight"), sources)
    dep = (sigma.join(back, ["source", "node"]).filter("source <> node")
           .groupBy("node").agg(F.sum(F.col("sigma") * F.col("back") - 1).alias("b")))
    n = nodes.agg(n_rows().alias("n")).scalar()
    pairs = (n - 1) * (n - 2) if normalized else F.lit(1)
    scale = pairs if is_directed or normalized else F.lit(2)
    return nodes.join(dep, "node", "left").select(
        "node", F.coalesce(F.try_divide(F.col("b"), scale.cast("double")), F.lit(0.0)).alias("betweenness"))


def edge_betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Shortest paths over each directed arc, shared among equal paths."""
    sources = sources if sources is not None else nodes_of(edges).select(F.col("node").alias("source"))
    tight, sigma, back = _shortest_paths(edges.select("src", "dst", "weight"), sources)
    used = (tight.join(sigma.withColumnRenamed("node", "src"), ["source", "src"])
            .join(back.withColumnRenamed("node", "dst"), ["source", "dst"])
            .groupBy("src", "dst").agg(F.sum(F.col("sigma") * F.col("back")).alias("b")))
    return edges.select("src", "dst").join(used, ["src", "dst"], "left").select(
        "src", "dst", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


def pagerank(edges: DataFrame, damping: float = 0.85, is_directed: bool = True, tol: float = 1e-9,
             max_iter: int = 300, unroll: int = 5) -> DataFrame:
    """PageRank that sums to 1; weights split the rank, dangling mass is spread evenly.

    Ranks are compared after every ``unroll`` rounds; no rank may have moved by
    more than ``tol`` of the mean rank in the last of them. Raises where that is not reached.
    """
    arcs = edges if is_directed else both_ways(edges)
    out = arcs.groupBy("src").agg(F.sum("weight").alias("__out"))
    share = cut_lineage(arcs.join(out, "src").select("src", "dst", (F.col("weight") / F.col("__out")).alias("p")))
    nodes = cut_lineage(nodes_of(arcs).join(out.select(F.col("src").alias("node"), F.lit(0).alias("dangling")),
                                            "node", "left").na.fill(1, ["dangling"]))
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    has_dangling = nodes.filter("dangling = 1").limit(1).count() > 0
    for _ in range(0, max_iter, unroll):
        for i in range(unroll):
            loose = ranks.agg(F.sum(F.col("rank") * F.col("dangling")).alias("d")).scalar() if has_dangling else F.lit(0.0)
            old = [F.col("rank").alias("old")] if i == unroll - 1 else []
            arrived = (share.join(ranks.select(F.col("node").alias("src"), "rank"), "src")
                       .groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("got")))
            kept = ranks.select("node", "dangling", *old) if old else nodes
            ranks = kept.join(arrived, "node", "left").select(
                "node", "dangling", *[c for c in kept.columns if c == "old"],
                ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + loose / n)).alias("rank"))
            if has_dangling or old:
                ranks = cut_lineage(ranks)
        moved = ranks.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = ranks.drop("old")
        if moved is None or moved * n <= tol:
            return ranks.select("node", "rank")
    raise RuntimeError("ranks did not settle; raise max_iter")


def pagerank_simple(edges: DataFrame, start: DataFrame, dampings: Sequence[float], iters: Sequence[int]) -> DataFrame:
    """r = d * sum(r / out) + 1 - d from given start ranks, several d and round counts side by side.

    A node without in-links leaves after the first round, and its mass with it.
    All dampings share one pass per round; a round count is a stop on the way.
    """
    out = edges.groupBy("src").agg(n_rows().alias("__out"))
    share = cut_lineage(edges.select("src", "dst").join(out, "src"))
    cols = [f"r{i}" for i in range(len(dampings))]
    ranks = start.select("node", *[F.col("rank").alias(c) for c in cols])
    result = None
    for k in range(1, max(iters) + 1):
        ranks = (share.join(ranks.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node"))
                 .agg(*[(d * F.sum(F.col(c) / F.col("__out")) + (1 - d)).alias(c) for c, d in zip(cols, dampings)]))
        if k in iters or k % 5 == 0:
            ranks = cut_lineage(ranks)
        if k in iters:
            named = ranks.select("node", *[F.col(c).alias(f"rank_d{round(d * 100)}_i{k}") for c, d in zip(cols, dampings)])
            result = named if result is None else result.join(named, "node")
    return result


def eigen_centrality(edges: DataFrame, is_directed: bool = False, tol: float = 1e-10, max_iter: int = 500,
                     unroll: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """Leading eigenvector with maximum 1, by power steps on A + I along in-arcs; one of each graph with ``by``.

    Several steps run as one plan, for all graphs at once; the shift keeps two-mode
    graphs from oscillating. On an acyclic directed graph the scores tend to zero.
    """
    by = list(by)
    edges = edges.select("src", "dst", "weight", *by)
    arcs = edges if is_directed else both_ways(edges)
    nodes = cut_lineage(nodes_of(arcs, by))
    out = bundled(cut_lineage(arcs.union(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"),
                                                      F.lit(1.0).alias("weight"), *by))), by, F.struct("dst", "weight"))
    x = nodes.withColumn("x", F.lit(1.0))
    for _ in range(0, max_iter, unroll):
        y = x.withColumn("x0", F.col("x"))
        for _ in range(unroll):
            y = (out.join(y.withColumnRenamed("node", "src"), [*by, "src"])
                 .select(*by, "src", "x", "x0", F.explode("arcs").alias("arc")).groupBy(*by, F.col("arc.dst").alias("node"))
                 .agg(F.sum(F.col("arc.weight") * F.col("x")).alias("x"),
                      F.max(F.when(F.col("src") == F.col("arc.dst"), F.col("x0"))).alias("x0")))
        y = cut_lineage(y)
        if by:
            y = y.join(y.groupBy(*by).agg(F.max("x").alias("top")), by).withColumn("x", F.col("x") / F.col("top"))
        else:
            top = y.agg(F.max("x")).first()[0]
            y = y.withColumn("x", F.col("x") / F.lit(top))
        change = y.agg(F.max(F.abs(F.col("x") - F.col("x0")))).first()[0]
        x = y.select(*by, "node", "x")
        if change < tol:
            return x.withColumnRenamed("x", "eigen")
    raise RuntimeError("eigenvector scores did not settle; raise max_iter")


#: Most numbers (scores and keys of nodes) that are broadcast in a step: 32 MB.
SENT_SCORES = 4_000_000


def growing_eigen_centrality(edges: DataFrame, at: str, period: str, tol: float = 1e-10, max_iter: int = 500,
                             unroll: int = 4) -> DataFrame:
    """``eigen_centrality`` of undirected ties (src, dst, weight) seen up to each period: (period, node, eigen).

    A tie counts from its period ``at`` (an integer) on, from the first where that
    is null. It is kept once, not once for each later period: a node holds its
    scores of all periods in one row.
    Bundles of ties go round with few scores broadcast to them, or join them by node.
    """
    ties = edges.filter("src <> dst")
    lo, hi = edges.agg(F.min(at), F.max(at)).first()
    if lo is None:
        return ties.filter(F.lit(False)).select(F.col(at).alias(period), F.col("src").alias("node"), F.lit(1.0).alias("eigen"))
    periods = list(range(lo, hi + 1))
    x, old = [f"x{i}" for i in range(len(periods))], [f"o{i}" for i in range(len(periods))]
    arcs = both_ways(ties.select("src", "dst", "weight", F.coalesce(at, F.lit(lo)).alias("at")))
    nodes = cut_lineage(arcs.groupBy(F.col("src").alias("node")).agg(F.min("at").alias("since")))
    own = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("weight"), F.col("since").alias("at"))
    out = bundled(arcs.unionByName(own), [], F.struct("dst", "weight", "at"))
    sent = nodes.count() * (len(periods) + 1) <= SENT_SCORES
    scores = cut_lineage(nodes.select("node", *[(F.col("since") <= t).cast("double").alias(c) for c, t in zip(x, periods)]))

    def step(y: DataFrame) -> DataFrame:
        """A + I times the scores of every period."""
        if sent:  # a node asks its neighbours
            far = y.withColumnRenamed("node", "far")
            pairs = (out.select(F.col("src").alias("node"), F.explode("arcs").alias("arc"))
                     .join(F.broadcast(far), F.col("arc.dst") == F.col("far")))
        else:  # a node tells its neighbours
            pairs = (out.join(y.withColumnRenamed("node", "src"), "src").withColumn("arc", F.explode("arcs"))
                     .withColumn("node", F.col("arc.dst")))
        part = [F.sum(F.when(F.col("arc.at") <= t, F.col("arc.weight") * F.col(c)).otherwise(0.0)).alias(c)
                for c, t in zip(x, periods)]
        return pairs.groupBy("node").agg(*part)

    for _ in range(0, max_iter, unroll):
        y = scores
        for _ in range(unroll):
            y = step(y)
        y = cut_lineage(y)
        top = y.agg(*[F.max(c) for c in x]).first()
        before = scores.select("node", *[F.col(c).alias(o) for c, o in zip(x, old)])
        fresh = cut_lineage(y.select("node", *[(F.col(c) / F.lit(t or 1.0)).alias(c) for c, t in zip(x, top)]).join(before, "node"))
        change = max(fresh.agg(*[F.max(F.abs(F.col(c) - F.col(o))) for c, o in zip(x, old)]).first())
        discard(y, scores)
        scores = fresh
        if change < tol:
            own = F.explode(F.array(*[F.struct(F.lit(t).cast(edges.schema[at].dataType).alias(period), F.col(c).alias("eigen"))
                                      for t, c in zip(periods, x)])).alias("own")
            since = nodes.withColumnRenamed("node", "__node")
            return (scores.join(since, F.col("node") == F.col("__node")).select("node", "since", own)
                    .filter(F.col(f"own.{period}") >= F.col("since")).select(f"own.{period}", "node", "own.eigen"))
    raise RuntimeError("eigenvector scores did not settle; raise max_iter")


def coreness(edges: DataFrame, by: Sequence[str] = (), max_rounds: int = 1000) -> DataFrame:
    """Core number of every node: repeated h-index of the neighbours' numbers.

    A node holds how many neighbours have each number, all from its own number
    on as one, so a hub costs one row per distinct value. After the first round
    only nodes whose number fell tell their neighbours.
    """
    by = list(by)
    arcs = cut_lineage(both_ways(edges.filter("src <> dst").select(
        *by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        .select("src", "dst", *by)))
    out = bundled(arcs, by, F.col("dst"))
    core = cut_lineage(arcs.groupBy(*by, F.col("src").alias("node")).agg(n_rows().alias("core")))
    down = Window.partitionBy(*by, "node").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)

    def told(fell: DataFrame, *values: str) -> DataFrame:
        """How many neighbours of a node went through the given numbers."""
        return (out.join(fell.withColumnRenamed("node", "src"), [*by, "src"])
                .select(*by, F.explode("arcs").alias("node"), *values).groupBy(*by, "node", *values).agg(n_rows().alias("k")))

    own = F.least("value", "core").alias("value")
    held = (told(core.withColumnRenamed("core", "value"), "value").join(core, [*by, "node"])
            .groupBy(*by, "node", "core", own).agg(F.sum("k").alias("k")))
    for _ in range(max_rounds):
        # (by, node, core, value, k) with the node's next number
        held = held.withColumn("at_least", F.sum("k").over(down))
        h = F.max(F.least("value", "at_least")).over(Window.partitionBy(*by, "node"))
        held = cut_lineage(held.withColumn("next", F.least("core", h)).drop("at_least"))
        fell = held.filter("next < core")
        if not fell.limit(1).count():
            return held.select(*by, "node", F.col("next").alias("core")).distinct()
        fell = cut_lineage(fell.select(*by, "node", F.col("core").alias("before"), F.col("next").alias("after")).distinct())
        moved = told(fell, "before", "after")
        held = held.select(*by, "node", F.col("next").alias("core"), "value", "k")
        numbers = held.select(*by, "node", "core").distinct()
        step = F.explode(F.array(F.struct(F.col("before").alias("value"), (-F.col("k")).alias("k")),
                                 F.struct(F.col("after").alias("value"), F.col("k").alias("k")))).alias("s")
        moved = (moved.join(numbers, [*by, "node"]).filter("after < core").select(*by, "node", "core", step)
                 .select(*by, "node", "core", "s.value", "s.k"))
        held = held.unionByName(moved).groupBy(*by, "node", "core", own).agg(F.sum("k").alias("k")).filter("k > 0")
    raise RuntimeError("coreness did not settle; raise max_rounds")


def power_centrality(edges: DataFrame, beta: float, tol: float = 1e-10, max_iter: int = 500) -> tuple[DataFrame, float]:
    """Bonacich power of an undirected graph and the relative residual of its equations.

    Solves (I - beta A) x = A 1 by conjugate residuals, which also work where
    the power series diverges; scaled so that the squares sum to n.
    """
    arcs = cut_lineage(both_ways(undirected(edges.select("src", "dst", F.lit(1.0).alias("weight")))).select("src", "dst"))

    def push(df: DataFrame, col: str) -> DataFrame:
        return (arcs.join(df.select(F.col("node").alias("src"), F.col(col).alias("__v")), "src")
                .groupBy(F.col("dst").alias("node")).agg(F.sum("__v").alias("__av")))

    def with_product(df: DataFrame) -> DataFrame:
        m = F.col("r") - beta * F.coalesce(F.col("__av"), F.lit(0.0))
        return df.join(push(df, "r"), "node", "left").withColumn("mr", m).drop("__av")

    state = with_product(arcs.groupBy(F.col("src").alias("node")).agg(n_rows().cast("double").alias("r")))
    state = cut_lineage(state.select("node", F.lit(0.0).alias("x"), "r", F.col("r").alias("p"), "mr",
                                     F.col("mr").alias("mp")))
    def dots(df: DataFrame):
        r, mr, mp = F.col("r"), F.col("mr"), F.col("mp")
        return df.agg(F.sum(r * mr), F.sum(r * r), F.sum(mr * mr), F.sum(mr * mp), F.sum(mp * mp)).first()

    rmr, norm0, _, _, mpmp = dots(state)
    norm = norm0
    done = lambda: norm <= tol * tol * norm0 or mpmp == 0 or rmr == 0
    for _ in range(max_iter):
        if done():
            break
        alpha = rmr / mpmp
        moved = state.select("node", (F.col("x") + alpha * F.col("p")).alias("x"),
                             (F.col("r") - alpha * F.col("mp")).alias("r"), "p", "mp")
        moved = cut_lineage(with_product(moved))
        after, norm, mrmr, mrmp, old = dots(moved)
        ratio = after / rmr
        state = moved.select("node", "x", "r", (F.col("r") + ratio * F.col("p")).alias("p"), "mr",
                             (F.col("mr") + ratio * F.col("mp")).alias("mp"))
        rmr, mpmp = after, mrmr + 2 * ratio * mrmp + ratio * ratio * old
    if not done():
        raise RuntimeError("power scores did not settle; raise max_iter")
    state = cut_lineage(state)
    scale = state.agg(F.sqrt(F.sum(F.col("x") * F.col("x")) / n_rows()).alias("s")).scalar()
    return state.select("node", (F.col("x") / scale).alias("power")), (norm / norm0) ** 0.5


def centralization(scores: DataFrame, col: str, kind: str) -> DataFrame:
    """Sum of differences to the maximum over its largest possible value (star graph).

    ``degree``: undirected counts without loops; ``closeness``: normalised by
    n - 1; ``betweenness``: normalised by (n - 1)(n - 2) / 2.
    """
    n = n_rows().cast("double")
    most = {"degree": (n - 1) * (n - 2), "closeness": (n - 1) * (n - 2) / (2 * n - 3), "betweenness": n - 1}[kind]
    return scores.agg((F.max(col) * n - F.sum(col)).alias("gap"), most.alias("most")).select(
        F.try_divide("gap", "most").alias("centralization"))


def core_curve(scores: DataFrame, col: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of the sorted scores with a step of p ones on top, for every p; one curve of each group with ``by``.

    Running sums give all p at once: cov = (top_p - p * mean) / n. Equal scores have no correlation.
    """
    by = list(by)
    out = running_sums(scores, by, [desc(col), tie], {"p": F.lit(1).cast("bigint"), "__top": F.col(col)})
    if by:
        own = scores.groupBy(*by).agg(F.avg(col).alias("__m"), F.stddev_pop(col).alias("__s"), n_rows().cast("double").alias("__n"))
        share = F.col("p") / F.col("__n")
        corr = F.try_divide((F.col("__top") - F.col("p") * F.col("__m")) / F.col("__n"), F.col("__s") * F.sqrt(share * (1 - share)))
        return out.join(own, by).filter(F.col("p") < F.col("__n")).select(*by, "p", corr.alias("corr"))
    stats = scores.agg(F.avg(col).alias("m"), F.stddev_pop(col).alias("s"), n_rows().cast("double").alias("n"))
    mean, sd, n = (stats.select(c).scalar() for c in ("m", "s", "n"))
    share = F.col("p") / n
    corr = F.try_divide((F.col("__top") - F.col("p") * mean) / n, sd * F.sqrt(share * (1 - share)))
    return out.filter(F.col("p") < n).select("p", corr.alias("corr"))


#: Landmarks that span the axes; with as many nodes or fewer every node is one, and the scaling is the classical one.
MARKS = 256


def landmarks(nodes: DataFrame, n: int = MARKS) -> DataFrame:
    """(mark): ``n`` nodes, or all where they are fewer, by a hash that does not depend on partitioning."""
    return nodes.select(F.col("node").alias("mark")).distinct().orderBy(F.xxhash64("mark"), "mark").limit(n)


def landmark_mds(to_marks: DataFrame, dims: int = 2, default: float | None = None) -> DataFrame:
    """Scaling to a few axes from distances (node, mark, distance) of all nodes to some of them.

    The axes come from the squared distances among the marks, double-centred;
    only this matrix, at most ``MARKS`` rows, reaches the driver. Every node is
    then placed by its distances to the marks, which for a mark gives its own
    classical place. Pairs that the table leaves out have the distance
    ``default``; without it the table must be complete, and a node without any
    distance has no place. Of each axis the end with
    the larger distance from 0 is positive. Axes that the distances do not span are 0.
    """
    table = cut_lineage(to_marks.select("node", "mark", (F.col("distance").cast("double") ** 2).alias("d")))
    spark = table.sparkSession
    names = sorted(r[0] for r in table.select("mark").distinct().collect())
    if not names:
        kind = table.schema["node"].dataType
        return spark.createDataFrame([], StructType([StructField("node", kind), *[
            StructField(f"dim{k + 1}", DoubleType()) for k in range(dims)]]))
    at = {name: i for i, name in enumerate(names)}
    square = np.full((len(names), len(names)), np.nan if default is None else float(default) ** 2)
    np.fill_diagonal(square, 0.0)
    marks = table.select(F.col("mark").alias("node")).distinct()
    for r in table.join(F.broadcast(marks), "node", "left_semi").collect():  # marks beside marks
        square[at[r.node], at[r.mark]] = r.d
    if np.isnan(square).any():
        raise ValueError("distances between landmarks are missing; give a default")
    mean = square.mean(axis=0)
    centred = -0.5 * (square - mean[:, None] - mean[None, :] + mean.mean())
    values, axes = np.linalg.eigh((centred + centred.T) / 2)
    top = np.argsort(-values, kind="stable")[:dims]
    scale = [1 / np.sqrt(values[k]) if values[k] > 1e-12 * max(abs(values[-1]), 1e-300) else 0.0 for k in top]
    weights = np.zeros((len(names), dims))
    weights[:, :len(top)] = -0.5 * axes[:, top] * scale
    rows = [(name, float(mean[i]), *map(float, weights[i])) for i, name in enumerate(names)]
    far = 0.0 if default is None else float(default) ** 2
    own = StructType([StructField("mark", table.schema["mark"].dataType), StructField("__m", DoubleType()),
                      *[StructField(f"__w{k}", DoubleType()) for k in range(dims)]])
    known = table.filter(F.col("node") != F.col("mark")).unionByName(
        marks.select("node", F.col("node").alias("mark"), F.lit(0.0).alias("d")))
    base = [float(((far - mean) * weights[:, k]).sum()) for k in range(dims)]
    # what is left out counts as ``far``: the known distances add their difference to it
    placed = cut_lineage(known.join(F.broadcast(spark.createDataFrame(rows, own)), "mark").groupBy("node").agg(
        *[(F.sum((F.col("d") - far) * F.col(f"__w{k}")) + base[k]).alias(f"dim{k + 1}") for k in range(dims)]))
    ends = placed.agg(*[F.max_by(f"dim{k + 1}", F.struct(F.round(F.abs(f"dim{k + 1}"), 9), "node")).alias(f"e{k}")
                        for k in range(dims)]).first()
    return placed.select("node", *[(F.col(f"dim{k + 1}") * (1.0 if (ends[k] or 0.0) >= 0 else -1.0)).alias(f"dim{k + 1}")
                                   for k in range(dims)])


def mds(dist: DataFrame, dims: int = 2, marks: int = MARKS) -> DataFrame:
    """Scaling of a distance table (a, b, distance), a < b, that is complete between the nodes and ``marks`` landmarks."""
    both = full_distances(dist).select(F.col("i").alias("node"), F.col("j").alias("mark"), F.col("d").alias("distance"))
    both = cut_lineage(both)
    chosen = cut_lineage(landmarks(both.select("node"), marks))
    return landmark_mds(both.join(F.broadcast(chosen), "mark", "left_semi"), dims)


def full_distances(dist: DataFrame) -> DataFrame:
    """Both directions and the zero diagonal of a table (a, b, distance), a < b."""
    half = dist.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("distance").alias("d"))
    ids = half.select("i").union(half.select(F.col("j").alias("i"))).distinct()
    return half.union(half.select("j", "i", "d")).union(ids.select("i", F.col("i").alias("j"), F.lit(0.0).alias("d")))


def kmedoids(full: DataFrame, k: int, max_swaps: int = 100) -> tuple[list, DataFrame]:
    """Medoids and labels over a complete distance table (i, j, d): greedy build, then best swaps.

    Costs of all (medoid, candidate) swaps come from one aggregate per round.
    """
    full = cut_lineage(full)

    def nearest(medoids):
        return (full.filter(F.col("j").isin(medoids)).groupBy("i").agg(
            F.min(F.struct("d", "j")).alias("first"),
            F.min_by("d", F.struct("d", "j")).alias("d1"),
            F.try_element_at(F.array_sort(F.collect_list(F.struct("d", "j"))), F.lit(2))["d"].alias("d2"))
            .select("i", F.col("first.j").alias("m"), "d1", F.coalesce("d2", F.lit(float("inf"))).alias("d2")))

    first = full.groupBy("j").agg(F.sum("d").alias("c")).orderBy(F.round("c", 9), "j").first()
    medoids = [first["j"]]
    while len(medoids) < k:
        gain = (full.filter(~F.col("j").isin(medoids)).join(nearest(medoids), "i")
                .groupBy("j").agg(F.sum(F.greatest(F.col("d1") - F.col("d"), F.lit(0.0))).alias("g"))
                .orderBy(F.desc(F.round("g", 9)), "j").first())
        medoids.append(gain["j"])
    for _ in range(max_swaps):
        near = nearest(medoids)
        cost = near.agg(F.sum("d1")).first()[0]
        parts = (full.filter(~F.col("j").isin(medoids)).join(near, "i").groupBy("j", "m").agg(
            F.sum(F.least("d", "d1")).alias("base"), F.sum(F.least("d", "d2")).alias("lost")))
        totals = parts.groupBy("j").agg(F.sum("base").alias("all"))
        best = (parts.join(totals, "j").select("j", "m", (F.col("all") - F.col("base") + F.col("lost")).alias("c"))
                .orderBy(F.round("c", 9), "j", "m").first()) if len(medoids) else None
        if best is None or best["c"] >= cost - 1e-9:
            break
        medoids[medoids.index(best["m"])] = best["j"]
    else:
        raise RuntimeError("medoids did not settle; raise max_swaps")
    return medoids, nearest(medoids).select(F.col("i").alias("node"), F.col("m").alias("label"))


def silhouette(full: DataFrame, labels: DataFrame) -> DataFrame:
    """Silhouette width per node from a complete distance table (i, j, d); 0 for a lone member."""
    sizes = labels.groupBy("label").agg(n_rows().alias("size"))
    own = labels.select(F.col("node").alias("i"), F.col("label").alias("own"))
    other = labels.select(F.col("node").alias("j"), "label")
    means = full.join(own, "i").join(other, "j").groupBy("i", "own", "label").agg(F.sum("d").alias("s"))
    means = means.join(sizes, "label")
    mine = F.col("label") == F.col("own")
    per = means.groupBy("i", "own").agg(
        F.max(F.when(mine, F.try_divide(F.col("s"), (F.col("size") - 1).cast("double")))).alias("a"),
        F.min(F.when(~mine, F.col("s") / F.col("size"))).alias("b"))
    width = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0)).otherwise(
        F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return per.select(F.col("i").alias("node"), F.col("own").alias("label"), width.alias("width"))
