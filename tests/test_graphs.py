"""Graph measures on small graphs with known or brute-force answers."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.operators import centrality as cen
from lodestar.operators import networks as net


def frame(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src long, dst long, weight double")


def star(n):
    return [(0, i, 1) for i in range(1, n)]


def clique(n):
    return [(i, j, 1) for i, j in itertools.combinations(range(n), 2)]


def random_graph(n, m, seed, weights=(1,)):
    rng = np.random.default_rng(seed)
    pairs = list(itertools.combinations(range(n), 2))
    return [(*pairs[i], int(rng.choice(weights))) for i in rng.choice(len(pairs), m, replace=False)]


def brute_distances(n, arcs):
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for a, b, w in arcs:
        d[a, b] = min(d[a, b], w)
    for k in range(n):
        d = np.minimum(d, d[:, k:k + 1] + d[k:k + 1, :])
    return d


def path_counts(n, arcs, d):
    sigma = np.eye(n)
    for s in range(n):
        for v in sorted(range(n), key=lambda v: d[s, v]):
            if v != s and np.isfinite(d[s, v]):
                sigma[s, v] = sum(sigma[s, a] for a, b, w in arcs if b == v and d[s, a] + w == d[s, v])
    return sigma


@pytest.fixture(scope="module")
def graph():
    return random_graph(9, 14, 3, (1, 2))


def both(arcs):
    return arcs + [(b, a, w) for a, b, w in arcs]


def test_distances_and_unreachable(spark):
    arcs = [(0, 1, 2), (1, 2, 2), (0, 2, 5), (3, 4, 1)]
    e = frame(spark, arcs)
    sources = cen.nodes_of(e).select(F.col("node").alias("source"))
    got = {(r.source, r.node): r.dist for r in cen.distances(e, sources).collect()}
    d = brute_distances(5, arcs)
    assert got == {(i, j): d[i, j] for i in range(5) for j in range(5) if np.isfinite(d[i, j])}
    labels = net.components(e)
    assert {r.node: r.comp for r in labels.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    assert net.unreachable_pairs(labels).first()[0] == 12


def test_betweenness_with_tied_paths(spark, graph):
    arcs, n = both(graph), 9
    d = brute_distances(n, arcs)
    sigma = path_counts(n, arcs, d)
    want = {v: sum(sigma[s, v] * sigma[v, t] / sigma[s, t] for s in range(n) for t in range(n)
                   if len({s, v, t}) == 3 and d[s, v] + d[v, t] == d[s, t]) / ((n - 1) * (n - 2)) for v in range(n)}
    got = {r.node: r.betweenness for r in cen.betweenness(frame(spark, graph)).collect()}
    assert got == pytest.approx(want)


def test_edge_betweenness_directed(spark, graph):
    n = 9
    d = brute_distances(n, graph)
    sigma = path_counts(n, graph, d)
    want = {(a, b): sum(sigma[s, a] * sigma[b, t] / sigma[s, t] for s in range(n) for t in range(n)
                        if s != t and np.isfinite(d[s, t]) and d[s, a] + w + d[b, t] == d[s, t]) for a, b, w in graph}
    got = {(r.src, r.dst): r.betweenness for r in cen.edge_betweenness(frame(spark, graph)).collect()}
    assert got == pytest.approx(want)


def test_closeness_of_a_star(spark):
    e = cen.both_ways(frame(spark, star(5)))
    sources = cen.nodes_of(e).select(F.col("node").alias("source"))
    got = {r.node: r.closeness for r in cen.closeness(cen.distances(e, sources)).collect()}
    assert got == pytest.approx({0: 1 / 4, **{i: 1 / 7 for i in range(1, 5)}})


def test_centralization_star_and_clique(spark):
    for rows, want in ((star(5), 1.0), (clique(5), 0.0)):
        e = frame(spark, rows)
        deg = cen.degree(e, cen.nodes_of(e), "all", normalized=False)
        assert cen.centralization(deg, "degree", "degree").first()[0] == pytest.approx(want)
        bet = cen.betweenness(e)
        assert cen.centralization(bet, "betweenness", "betweenness").first()[0] == pytest.approx(want)


def test_pagerank_with_a_dangling_node(spark):
    arcs = [(0, 1, 1), (0, 2, 3), (1, 2, 1), (2, 0, 1), (2, 3, 1)]
    p = np.zeros((4, 4))
    for a, b, w in arcs:
        p[a, b] = w
    out = p.sum(1)
    r = np.full(4, 0.25)
    for _ in range(300):
        r = 0.15 / 4 + 0.85 * (sum(r[i] * p[i] / out[i] for i in range(4) if out[i]) + r[out == 0].sum() / 4)
    got = {x.node: x.rank for x in cen.pagerank(frame(spark, arcs), 0.85).collect()}
    assert got == pytest.approx(dict(enumerate(r)), abs=1e-9)
    with pytest.raises(RuntimeError, match="settle"):
        cen.pagerank(frame(spark, arcs), 0.85, tol=0.0, max_iter=10)


def test_simple_pagerank_drops_nodes_without_in_links(spark):
    e = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C"), ("C", "B"), ("D", "A")], "src string, dst string")
    start = spark.createDataFrame([("A", 1.7), ("B", 0.9), ("C", 1.3), ("D", 0.2)], "node string, rank double")
    got = {r.node: r for r in cen.pagerank_simple(e, start, (0.15, 0.85), (1, 20)).collect()}
    assert set(got) == {"B", "C"}
    assert got["B"].rank_d85_i1 == pytest.approx(0.85 * (1.7 / 2 + 1.3) + 0.15)


def test_eigenvector(spark, graph):
    a = np.zeros((9, 9))
    for i, j, w in graph:
        a[i, j] = a[j, i] = w
    v = np.abs(np.linalg.eigh(a)[1][:, -1])
    got = {r.node: r.eigen for r in cen.eigen_centrality(frame(spark, graph)).collect()}
    assert got == pytest.approx({i: x for i, x in enumerate(v / v.max()) if a[i].any()}, abs=1e-6)


def test_coreness_of_triangle_with_tail(spark):
    e = frame(spark, [(0, 1, 1), (1, 2, 1), (0, 2, 1), (2, 3, 1)])
    assert {r.node: r.core for r in cen.coreness(e).collect()} == {0: 2, 1: 2, 2: 2, 3: 1}


def test_power_centrality(spark, graph):
    a = np.zeros((9, 9))
    for i, j, _ in graph:
        a[i, j] = a[j, i] = 1
    keep = a.any(1)
    a = a[keep][:, keep]
    x = np.linalg.solve(np.eye(len(a)) - 0.75 * a, a.sum(1))
    x /= np.sqrt((x ** 2).sum() / len(x))
    power, residual = cen.power_centrality(frame(spark, graph), 0.75)
    got = {r.node: r.power for r in power.collect()}
    assert residual < 1e-8
    assert got == pytest.approx(dict(zip(np.arange(9)[keep], x)), abs=1e-6)


def test_closure_violations(spark):
    e = frame(spark, [(0, 1, 1), (1, 2, 1), (0, 2, 1), (2, 3, 1)])
    assert {tuple(r) for r in net.stc_violations(e).collect()} == {(2, 3), (0, 2), (1, 2)}
    assert net.stc_violations(frame(spark, clique(5))).count() == 0


def test_scaling_recovers_a_plane(spark):
    pts = np.array([[0, 0], [4, 0], [0, 2], [3, 1], [5, 5]], dtype=float)
    rows = [(i, j, float(np.linalg.norm(pts[i] - pts[j]))) for i, j in itertools.combinations(range(5), 2)]
    out = {r.node: (r.dim1, r.dim2) for r in cen.mds(spark.createDataFrame(rows, "a int, b int, distance double")).collect()}
    for i, j, d in rows:
        assert np.linalg.norm(np.subtract(out[i], out[j])) == pytest.approx(d)


def test_landmarks_place_three_thousand_nodes(spark):
    """Distances in a plane are recovered from 20 landmarks; left-out pairs take the default."""
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(3000, 2)) * [5, 1]
    marks = [r.mark for r in cen.landmarks(spark.range(3000).withColumnRenamed("id", "node"), 20).collect()]
    assert len(set(marks)) == 20
    rows = pd.DataFrame([(i, m, float(np.linalg.norm(pts[i] - pts[m]))) for i in range(3000) for m in marks],
                        columns=["node", "mark", "distance"])
    out = cen.landmark_mds(spark.createDataFrame(rows)).toPandas().sort_values("node")
    placed = out[["dim1", "dim2"]].to_numpy()
    for i, j in rng.integers(0, 3000, (200, 2)):
        assert np.linalg.norm(placed[i] - placed[j]) == pytest.approx(np.linalg.norm(pts[i] - pts[j]), abs=1e-6)
    some = spark.createDataFrame(rows[rows.distance < 6])
    filled = rows.assign(distance=rows.distance.where(rows.distance < 6, 9.0))
    got = cen.landmark_mds(some, default=9.0).toPandas().set_index("node")
    want = cen.landmark_mds(spark.createDataFrame(filled)).toPandas().set_index("node")
    assert set(got.index) == set(rows[rows.distance < 6].node)  # a node without any distance has no place
    assert np.allclose(got.sort_index(), want.loc[sorted(got.index)])
    with pytest.raises(ValueError, match="default"):
        cen.landmark_mds(some)
    assert cen.landmark_mds(some.limit(0)).count() == 0


def test_medoids_and_silhouette(spark):
    rng = np.random.default_rng(1)
    pts = np.concatenate([rng.normal(c, 0.5, (5, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    d = np.linalg.norm(pts[:, None] - pts[None], axis=-1)
    full = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(15) for j in range(15)], "i int, j int, d double")
    medoids, labels = cen.kmedoids(full, 3)
    best = min(itertools.combinations(range(15), 3), key=lambda m: d[:, m].min(1).sum())
    assert sorted(medoids) == sorted(best)
    lab = {r.node: r.label for r in labels.collect()}
    for r in cen.silhouette(full, labels).collect():
        own = [j for j in lab if lab[j] == lab[r.node] and j != r.node]
        b = min(np.mean([d[r.node, j] for j in lab if lab[j] == m]) for m in medoids if m != lab[r.node])
        a = d[r.node, own].mean()
        assert r.width == pytest.approx((b - a) / max(a, b))


def test_core_curve(spark):
    v = np.array([5.0, 1.0, 3.0, 3.0, 9.0, 2.0])
    got = {r.p: r["corr"] for r in cen.core_curve(
        spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "k int, v double"), "v", "k").collect()}
    c = np.sort(v)
    want = {p: np.corrcoef(c, np.r_[np.zeros(6 - p), np.ones(p)])[0, 1] for p in range(1, 6)}
    assert got == pytest.approx(want)


def test_projection_equals_all_pairs(spark):
    groups = {"a": [1, 2, 3], "b": [2, 3], "c": [4]}
    df = spark.createDataFrame([(g, m) for g, ms in groups.items() for m in ms + ms[:1]], "g string, m int")
    got = {r.m: r.strength for r in net.projection_strength(df, "g", "m").collect()}
    assert got == {1: 2, 2: 3, 3: 3, 4: 0}
    assert net.projection_ties(df, "g", "m").first()[0] == 4
    values = spark.createDataFrame([(i, 10.0 ** i) for i in range(1, 5)], "m int, v double")
    sums = {r.m: r.s for r in net.projection_sum(df, "g", "m", values, "v", "s").collect()}
    assert sums == {1: 1100.0, 2: 2010.0, 3: 210.0, 4: 0.0}


def test_unsettled_scores_are_an_error(spark):
    path = spark.createDataFrame([(i, i + 1, 1.0) for i in range(60)], "src long, dst long, weight double")
    with pytest.raises(RuntimeError):
        cen.eigen_centrality(path, max_iter=8)
    with pytest.raises(RuntimeError):
        cen.power_centrality(path, 0.4, max_iter=2)


def test_scores_and_curves_of_several_graphs(spark):
    rng = np.random.default_rng(3)
    rows = [(g, int(a), int(b), float(w)) for g in (1, 2, 3)
            for a, b, w in zip(rng.integers(0, 8, 30), rng.integers(8, 14, 30), rng.integers(1, 5, 30))]
    edges = spark.createDataFrame(rows, "g int, src long, dst long, weight double")
    scores = cen.eigen_centrality(edges, by=["g"]).cache()
    curves = {(r.g, r.p): r["corr"] for r in cen.core_curve(scores, "eigen", "node", by=["g"]).collect()}
    seen = 0
    for g in (1, 2, 3):
        got = {r.node: r.eigen for r in scores.filter(F.col("g") == g).collect()}
        names = sorted({x for r in rows if r[0] == g for x in r[1:3]})
        a = np.zeros((len(names), len(names)))
        for _, s, d, w in (r for r in rows if r[0] == g):
            a[names.index(s), names.index(d)] += w
            a[names.index(d), names.index(s)] += w
        v = np.abs(np.linalg.eigh(a)[1][:, -1])
        assert got == pytest.approx(dict(zip(names, v / v.max())), abs=1e-6)
        c, n = np.sort(list(got.values())), len(names)
        for p in range(1, n):
            assert curves[g, p] == pytest.approx(np.corrcoef(c, np.r_[np.zeros(n - p), np.ones(p)])[0, 1], abs=1e-9)
        seen += n - 1
    assert len(curves) == seen
    empty = cen.core_curve(scores.filter("g = 9"), "eigen", "node", by=["g"])
    assert empty.count() == 0
