"""The networks of all order lines against union-find and peeling in plain Python."""

from collections import Counter, defaultdict

import pytest
from compare import duck

from lodestar.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines():
    return duck(SF).execute("select year(o_orderdate)::int, 'c' || o_custkey, 'p' || l_partkey, 's' || l_suppkey "
                            "from orders join lineitem on o_orderkey = l_orderkey").fetchall()


def labels(ties):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in ties:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in list(root)}


def cores(ties):
    near = defaultdict(set)
    for a, b in ties:
        near[a].add(b)
        near[b].add(a)
    out, k = {}, 0
    while near:
        low = min(near, key=lambda x: len(near[x]))
        k = max(k, len(near[low]))
        out[low] = k
        for x in near.pop(low):
            near[x].discard(low)
    return out


def test_components_of_all_lines(spark, lines):
    want = labels({(c, p) for _, c, p, _ in lines})
    assert {r.node: r.comp for r in catalog.QUERIES["connected_components"](spark, SF).collect()} == want
    pairs = len(want) ** 2 - sum(n * n for n in Counter(want.values()).values())
    assert [tuple(r) for r in catalog.QUERIES["unreachable_pair_count"](spark, SF).collect()] == [(pairs,)]


def test_yearly_cores_of_all_lines(spark, lines):
    got = {r.yr: (r.nodes, r.top, r["mean"]) for r in catalog.QUERIES["yearly_mean_coreness"](spark, SF).collect()}
    assert got.keys() == {yr for yr, *_ in lines}
    for yr, (nodes, top, mean) in got.items():
        want = cores({(c, s) for y, c, _, s in lines if y == yr})
        assert (nodes, top) == (len(want), max(want.values()))
        assert mean == pytest.approx(sum(want.values()) / len(want), abs=1e-6)
