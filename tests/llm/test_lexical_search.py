import math
import re
from collections import Counter

import numpy as np
import pytest
from compare import compare, duck
from llm_helpers import AWKWARD, OTHER, PROSE, UPPER, tuples

from lodestar.llm import lexical_search as ls
from lodestar.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k):
    known = [(key, terms(text)) for key, text in docs if terms(text)]
    n_docs, n_terms = len(known), sum(len(t) for _, t in known)
    df = Counter(t for _, own in known for t in set(own))
    out = []
    for item, text in items:
        scored = []
        for key, own in known:
            m, tf = 25 + 75 * len(own) * n_docs // n_terms, Counter(own)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms(text))
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, PROSE), (2, OTHER + " " + OTHER), (3, None), (4, ""), (5, "!! --"), (6, "no such term zzz"),
         (7, "one ONE two, end"), (None, "fox"), (7, "one ONE two, end"), (8, "Übergrößen 日本語 " * 40)]


@pytest.mark.parametrize("limits", [(8192, 16384, 32), (3, 4, 1), (5, 7, 2)])
def test_awkward_rows(spark, awkward, empty, monkeypatch, limits):
    for name, value in zip(("TREE_TERMS", "TREE_DOCS", "LEAF"), limits):
        monkeypatch.setattr(ls, name, value)
    monkeypatch.setattr(ls, "SLICE", 64 if limits[0] < 10 else 1 << 20)
    items = spark.createDataFrame([(*i, 1.0, "x") for i in ITEMS], "item_id long, text string, score double, rank string")
    got = ls.lexical_search(awkward, items, k=4)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = sorted([tuple(r) for r in got.collect()], key=str)
    assert rows == brute([r[:2] for r in AWKWARD], ITEMS, 4)
    assert tuples(ls.lexical_search(empty, items)) == []
    assert tuples(ls.lexical_search(awkward, items.limit(0))) == []


def test_many_blocks_of_items(spark, awkward, monkeypatch):
    monkeypatch.setattr(ls, "ITEM_BYTES", 300)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = sorted([tuple(r) for r in ls.lexical_search(awkward, items, k=10).collect()], key=str)
    assert rows == brute([r[:2] for r in AWKWARD], ITEMS, 10)


@pytest.mark.parametrize("seed", range(6))
def test_trees_pass_over_no_answer(seed):
    """Bounds over random vectors with many copies and ties; most nodes are never opened."""
    rng = np.random.default_rng(seed)
    n, v, k = 1500, 40, 5
    lists = [sorted(rng.choice(v, rng.integers(1, 12), replace=False).tolist()) for _ in range(n)]
    lists += [lists[0]] * 300
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    flat = np.array([t for x in lists for t in x])
    tfs = rng.integers(1, 4, len(flat)).astype(np.int32)
    tfs[bounds[n]:] = np.tile(tfs[:bounds[1]], 300)
    m = rng.integers(25, 27, len(lists))
    rows = ls.Rows(bounds, flat, tfs, m, [[int(x)] for x in rng.permutation(len(lists))])
    weights = rng.integers(0, 9000, v)
    some = rows.restricted(np.arange(v), k)
    for leaf in (1, 32):
        tree = ls.Tree(some, v, leaf)
        for _ in range(10):
            asked = rng.choice(v, 6, replace=False)
            best = ls.Best(k)
            tree.search(asked, weights[asked], best)
            scores = np.zeros(len(lists), np.int64)
            hit = np.isin(flat, asked)
            np.add.at(scores, rows.owners()[hit], ls._gain(weights[flat[hit]], tfs[hit].astype(np.int64), m[rows.owners()[hit]]))
            want = sorted((-int(s), rows.ids[i][0]) for i, s in enumerate(scores.tolist()) if s > 0)[:k]
            assert [(x[0], x[3]) for x in best.found] == want


@pytest.mark.parametrize("name", ["op12_lexical_search"])
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, duck(sf), sf, QUERIES[name], ORACLES[name]) is None
