"""Member pairs in sparse form against plain Python, with hot groups, nulls and wide vocabularies."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import pairs as pr


def rows_of(seed, groups=60, members=40, hot=True):
    rng = np.random.default_rng(seed)
    out = [(int(y), int(g), f"m{m:02d}") for y, g, m in zip(rng.integers(0, 2, 400), rng.integers(0, groups, 400), rng.integers(0, members, 400))]
    if hot:
        out += [(1, 999, f"m{m:02d}") for m in range(members)] * 3
    return out + [(0, 5, None), (None, 7, "m01"), (None, 7, "m02"), (None, None, "m01"), (None, None, "m03"), (1, 77, "alone")]


def groups_of(rows):
    out = defaultdict(set)
    for y, g, m in rows:
        if m is not None:
            out[y, g].add(m)
    return out


@pytest.fixture(params=[(1024, 1 << 21, 2_000_000, 100_000), (7, 16, 50, 3)], ids=["wide", "narrow"])
def limits(request, monkeypatch):
    for name, value in zip(("BLOCK", "PAIRS", "TABLE_ROWS", "LISTS"), request.param):
        monkeypatch.setattr(pr, name, value)
    monkeypatch.setattr(pr.member_lists, "__defaults__", (request.param[0],))


@pytest.mark.parametrize("by", [[], ["y"]])
def test_co_occurrence(spark, limits, by):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "y int, g int, m string").repartition(3)
    single, both, years = defaultdict(int), defaultdict(int), defaultdict(set)
    for (y, _), own in groups_of(rows).items():
        key = (y,) if by else ()
        years[key] |= own
        for m in own:
            single[(*key, m)] += 1
        for a, b in combinations(sorted(own), 2):
            both[(*key, a, b)] += 1
    want = {k: (single[k[:-1]], single[(*k[:-2], k[-1])], n) for k, n in both.items()}
    got = pr.co_occurrence(df, ["y", "g"], "m", by).collect()
    assert {(*(r[c] for c in by), r.a, r.b): (r.n_a, r.n_b, r.n_ab) for r in got} == want and len(got) == len(want)
    every = pr.co_occurrence(df, ["y", "g"], "m", by, complete=True).collect()
    assert {(*(r[c] for c in by), r.a, r.b): r.n_ab for r in every} == {
        (*key, a, b): both[(*key, a, b)] for key, own in years.items() for a, b in combinations(sorted(own), 2)}


def test_first_times_and_novelty(spark, limits):
    rows = [(t, g, m) for t, g, m in rows_of(2) if t is not None]
    rng = np.random.default_rng(0)
    month = {g: int(rng.integers(0, 12)) for _, g, _ in rows}
    df = spark.createDataFrame([(g, month[g], m) for _, g, m in rows], "g int, mon int, m string")
    own, first, first_pair = defaultdict(set), {}, {}
    for _, g, m in rows:
        if m:
            own[g].add(m)
    for g in sorted(own, key=month.get):
        for m in own[g]:
            first.setdefault(m, month[g])
        for p in combinations(sorted(own[g]), 2):
            first_pair.setdefault(p, month[g])
    got = pr.first_seen_pairs(df, ["g"], "m", "mon").collect()
    assert {(r.a, r.b): r.first_time for r in got} == first_pair and len(got) == len(first_pair)
    got = {r.g: (r.mon, r.new_members, r.new_pairs) for r in pr.novel_counts(df, ["g"], "m", "mon", 3).collect()}
    assert got == {g: (month[g], sum(month[g] < first[m] + 3 for m in ms),
                       sum(month[g] < first_pair[p] + 3 for p in combinations(sorted(ms), 2))) for g, ms in own.items()}


def test_partner_distance(spark, limits):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, "y int, g int, m string")
    groups = groups_of(rows)
    inside = defaultdict(set)
    for (y, g), own in groups.items():
        for m in own:
            inside[y, m].add(g)

    def distance(y, a, b):
        p, q = inside[y, a], inside[y, b]
        return 1 - len(p & q) / len(p | q)

    got = {(r.y, r.g): r.d for r in pr.avg_partner_distance(df, ["y", "g"], "m", ["y"], "d").collect()}
    assert set(got) == set(groups)
    for (y, g), own in groups.items():
        mean = [distance(y, a, b) for a, b in combinations(sorted(own), 2)]
        assert got[y, g] == (pytest.approx(np.mean(mean)) if mean else None)


def test_five_thousand_members(spark):
    """One group holds every member of a wide vocabulary, a third of all rows; whole numbers as members."""
    n = 5000
    rng = np.random.default_rng(6)
    rest = [(int(g), int(m)) for g, m in zip(rng.integers(1, 3000, 2 * n), rng.integers(0, n, 2 * n))]
    df = spark.createDataFrame([(0, m) for m in range(n)] + rest, "g int, m int")
    lists = pr.member_lists(df, ["g"], "m")
    assert lists.agg(F.max(F.greatest(F.size("left"), F.size("right")))).first()[0] < 1.3 * pr.BLOCK
    out = pr.co_occurrence(df, ["g"], "m").agg(F.count(F.lit(1)), F.sum("n_ab"), F.max("n_ab"), F.sum("n_a")).first()
    groups = defaultdict(set)
    for g, m in [(0, m) for m in range(n)] + rest:
        groups[g].add(m)
    size = np.bincount([m for own in groups.values() for m in own])
    assert out[0] == n * (n - 1) // 2
    assert out[1] == sum(len(own) * (len(own) - 1) // 2 for own in groups.values())
    assert out[3] == sum(int(s) * (n - 1 - i) for i, s in enumerate(size))


def test_empty(spark):
    df = spark.createDataFrame([], "y int, g int, m string")
    assert pr.co_occurrence(df, ["g"], "m", ["y"]).collect() == []
    assert pr.novel_counts(df, ["g"], "m", "y", 3).collect() == []
    assert pr.avg_partner_distance(df, ["y", "g"], "m", ["y"], "d").collect() == []
