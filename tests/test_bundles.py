"""Steps over large networks: bundles of arcs, thresholds of renewals, ranges, blocks of pair tables."""

import datetime as dt
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import centrality as cen
from lodestar.operators import networks as net
from lodestar.operators import ordered
from lodestar.operators import pairs as pr


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(net, "BUNDLE", 3)


def ties(n, m, seed):
    rng = np.random.default_rng(seed)
    return sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, n, (m, 2)) if a != b} | {(0, i) for i in range(1, n // 2)})


def test_bundles_hold_every_arc_in_bounded_lists(spark, small):
    rows = [(1, i, 1.0) for i in range(60)] + [(2, 1, 1.0), (2, 1, 1.0), (None, 1, 1.0)]
    df = spark.createDataFrame(rows, "src int, dst int, weight double")
    got = net.bundled(df, [], F.col("dst")).collect()
    assert sorted((r.src, d) for r in got for d in r.arcs) == sorted(r[:2] for r in rows if r[0])
    assert max(len(r.arcs) for r in got) <= 12
    once = net.bundled(df, [], F.col("dst"), once=True).filter("src = 2").collect()
    assert [r.arcs for r in once] == [[1]]


def test_scores_through_bundles(spark, small):
    graphs = {g: ties(14, 30, g) for g in (1, 2)}
    df = spark.createDataFrame([(g, a, b, float(a + b + 1)) for g, e in graphs.items() for a, b in e],
                               "g int, src int, dst int, weight double")
    got = {(r.g, r.node): r.eigen for r in cen.eigen_centrality(df, by=["g"]).collect()}
    for g, e in graphs.items():
        A = np.zeros((14, 14))
        for a, b in e:
            A[a, b] = A[b, a] = a + b + 1
        v = np.abs(np.linalg.eigh(A)[1][:, -1])
        for node in range(14):
            if (g, node) in got:
                assert got[g, node] == pytest.approx(v[node] / v.max(), abs=1e-6)


def test_cores_through_bundles(spark, small):
    graphs = {g: ties(24, 70, g) for g in (1, 2, 3)}
    df = spark.createDataFrame([(g, a, b) for g, e in graphs.items() for a, b in e], "g int, src int, dst int")
    got = {(r.g, r.node): r.core for r in cen.coreness(df, by=["g"]).collect()}
    want = {}
    for g, e in graphs.items():
        near = {}
        for a, b in e:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        left, k = set(near), 0
        while left:
            out = {v for v in left if len(near[v] & left) <= k}
            want |= {(g, v): k for v in out}
            left -= out
            k += not out
    assert got == want


def test_components_through_bundles(spark, small):
    path = [(i, i + 1) for i in range(100, 140)]
    rows = [*[(b, a) for a, b in path], (1, 50), (1, 50), (60, 50), (None, 60), (60, None), (7, 7)]
    df = spark.createDataFrame(rows, "src int, dst int")
    got = {r.node: r.comp for r in net.components(df).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 1: 1, 50: 1, 60: 1, 7: 7}
    some = spark.createDataFrame([(1,), (50,), (9,)], "v int")
    assert {r.node: r.comp for r in net.components(df, some).collect()} == {1: 1, 50: 1, 9: 9}


@pytest.mark.parametrize("pairs", [1, 2, 40])
def test_decay_of_repeated_ties(spark, request, pairs):
    """Equal rows count once towards the few renewals, each time towards the threshold."""
    rng = np.random.default_rng(pairs)
    day = dt.date(2000, 1, 1)
    rows = [(i, -i, day + dt.timedelta(int(d))) for i in range(pairs) for d in rng.integers(0, 900, 3)]
    rows += rows[::2] + rows[::4]
    df = spark.createDataFrame(rows, "a int, b int, d date")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    now = day + dt.timedelta(1000)
    out = net.decay_ties(df, "a", "b", "d", F.lit(now))
    gaps = []
    for i in range(pairs):
        own = sorted(r for r in rows if r[0] == i)
        gaps += [(*x, (y[2] - x[2]).days) for x, y in zip(own, own[1:])]
    if len(set(gaps)) <= 3:
        want = [(*r, (now - r[2]).days) for r in rows]
    else:
        limit = sorted(g[3] for g in gaps)[math.ceil(0.9 * len(gaps)) - 1]
        last = {r[0]: max(x for x in rows if x[0] == r[0]) for r in rows}
        want = [(*r, (now - r[2]).days) for r in last.values() if (now - r[2]).days <= limit]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert not re.search(r"hashpartitioning\(__all#\d+, \d+\)", out._jdf.queryExecution().toString())


def test_only_keys_of_a_cut_row_are_numbered(spark):
    df = spark.createDataFrame([(k if k else None, i) for k in range(200) for i in range(3)], "k int, t int")
    ranges = ordered.Ranges(df, ["k"], ["t"], 8)
    base, spread = ordered._ranged(df, ["k"], ["t"], ranges)
    keys = {r.k for r in ranges.spread(df).collect()}
    assert {r.k for r in spread.collect()} == keys and 0 < len(keys) <= 8
    plain = {(r.k, r.t): r.c for r in ranges.number(df, "c").collect()}
    assert {(r.k, r.t): r["__c"] for r in base.collect()} == {x: c if x[0] in keys else 0 for x, c in plain.items()}


def test_lists_visit_a_small_pair_table_once(spark, monkeypatch):
    sent, cut = [], pr.cut_lineage
    monkeypatch.setattr(pr, "cut_lineage", lambda df: sent.append(cut(df)) or sent[-1])
    df = spark.createDataFrame([(g, m, g % 5) for g in range(300) for m in range(g % 7)], "g int, m int, t int")
    out = {r.g: (r.new_members, r.new_pairs) for r in pr.novel_counts(df, ["g"], "m", "t", 9).collect()}
    assert out == {g: (g % 7, (g % 7) * (g % 7 - 1) // 2) for g in range(300) if g % 7}
    dealt = [s.count() for s in sent if "__b" in s.columns and "left" in s.columns]
    assert dealt == [len(out)]


@pytest.mark.parametrize("sent", [0, 10_000])
def test_scores_of_a_growing_network_without_a_copy_a_period(spark, small, monkeypatch, sent):
    """Every tie is written once whatever the number of periods; the scores are those of a network each."""
    monkeypatch.setattr(cen, "SENT_SCORES", sent)
    kept, bundle = [], cen.bundled
    monkeypatch.setattr(cen, "bundled", lambda *a, **b: kept.append(bundle(*a, **b)) or kept[-1])
    rows = [(0, b, 1.0, 2000) for b in range(1, 6)] + [(1, 2, 3.0, 2001), (2, 6, 2.0, 2001), (3, 4, 1.0, None), (5, 5, 9.0, 2000)]
    df = spark.createDataFrame(rows, "src int, dst int, weight double, t long")
    got = {(r.yr, r.node): r.eigen for r in cen.growing_eigen_centrality(df, "t", "yr", tol=1e-7).collect()}
    assert sum(len(r.arcs) for b in kept for r in b.collect()) == 2 * 8 + 7  # and one of each node to itself
    for yr, n in ((2000, 6), (2001, 7)):
        A = np.zeros((n, n))
        for a, b, w, t in rows[:-1]:
            if (t or 2000) <= yr:
                A[a, b] = A[b, a] = w
        v = np.abs(np.linalg.eigh(A)[1][:, -1])
        assert [got.pop((yr, i)) for i in range(n)] == pytest.approx(list(v / v.max()), abs=1e-5)
    assert not got
    none = cen.growing_eigen_centrality(df.filter("t is null"), "t", "yr")
    assert none.columns == ["yr", "node", "eigen"] and none.count() == 0
