from itertools import combinations

import numpy as np
import pytest
from llm_helpers import UPPER, blank_words, tuples

from lodestar.llm.components import components
from lodestar.llm.ngram_join import _prefix, ngram_join


def shingles(text, width=5):
    words = blank_words((text or "").translate(UPPER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def expected(rows, width=5, percent=80):
    """(id, set size, least id reachable) of each row, by all pairs."""
    sets = [shingles(text, width) for _, text in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            root[find(j)] = find(i)
    least = {}
    for i, (name, _) in enumerate(rows):
        known = least.get(find(i))
        least[find(i)] = name if known is None else known if name is None else min(known, name)
    return sorted(((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))),
                  key=lambda r: [(v is None, str(v)) for v in r])


def test_awkward_rows(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = tuples(ngram_join(awkward), "doc_id", "n_shingles", "component_id")
    assert got == expected(rows)


@pytest.mark.parametrize("seed,percent", [(1, 80), (2, 80), (3, 50), (4, 95), (5, 100)])
def test_random_near_copies(spark, seed, percent):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(12):  # families of a text and its edited copies, edits of edits among them
        base = list(rng.choice(vocabulary, rng.integers(4, 90)))
        for _ in range(int(rng.integers(1, 14))):
            rows.append((len(rows) * 7 % 101 + 1000 * len(rows), " ".join(base)))
            for _ in range(int(rng.integers(0, 3))):
                base[int(rng.integers(0, len(base)))] = str(rng.choice(vocabulary))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert tuples(ngram_join(docs, percent=percent), "doc_id", "n_shingles", "component_id") == expected(
        rows, percent=percent)


def test_group_of_near_copies_with_a_common_text(spark):
    """Copies with one or more edits each: most are near the text they come from and few near each other."""
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(150):
        text = list(base)
        for at in rng.choice(80, int(rng.integers(0, 5)), replace=False):
            text[at] = f"x{i}y{at}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert tuples(ngram_join(docs), "doc_id", "n_shingles", "component_id") == expected(rows)


def test_class_is_the_least_id_with_the_same_words(spark):
    docs = spark.createDataFrame([(5, "A b"), (3, "a  B\n"), (4, "a b c")], "doc_id int, text string")
    assert tuples(ngram_join(docs), "doc_id", "class_id") == [(3, 3), (4, 4), (5, 3)]


def test_prefix_keeps_the_promised_matches():
    """Two sets with enough overlap share as many prefix shingles as the smaller number asked for."""
    rng = np.random.default_rng(0)
    levels = rng.integers(0, 6, 1 << 21).astype(np.uint8)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n + 4).astype(np.uint64) * np.uint64(2))
        x = np.sort(rng.choice(pool, n, replace=False))
        drop = int(rng.integers(0, n // 5 + 1))
        rest = np.setdiff1d(pool, x)
        y = np.unique(np.concatenate([x[drop:], rng.choice(rest, min(drop, len(rest)), replace=False)]))
        common = len(np.intersect1d(x, y))
        if 100 * common >= 80 * (len(x) + len(y) - common):
            (p, need_p), (q, need_q) = _prefix(x, levels, 80), _prefix(y, levels, 80)
            assert len(np.intersect1d(p, q)) >= min(need_p, need_q)


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (203, 201), (201, 203)]
    got = dict(tuples(components(spark.createDataFrame(links, "a long, b long"))))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 201: 201, 203: 201}
    assert tuples(components(spark.createDataFrame([], "a long, b long"))) == []


def test_empty_table(empty):
    assert tuples(ngram_join(empty)) == []
