import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import AWKWARD, blank_words, tuples
from pyspark.sql import functions as F

from lodestar.llm import mixing


def frame_of(spark, cells):
    return spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")


def wanted_of(cells, at, power, budget):
    """Tokens wanted per value of a margin: the largest scale, found by bisection."""
    own = defaultdict(float)
    for c in cells:
        own[c[at]] += c[3]
    total, low, high = sum(own.values()), 0.0, 1e9
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(v, middle * v ** power) for v in own.values()) < budget * total else (low, middle)
    return {k: min(v, low * v ** power) for k, v in own.items()}


@pytest.mark.parametrize("budget", [0.3, 0.8])
def test_raking_meets_reachable_targets_below_one(spark, budget):
    rng = np.random.default_rng(1)
    cells = [(f"s{i}", f"l{j}", f"t{k}", int(rng.integers(1, 1000) * (30 if k else 1)))
             for i in range(4) for j in range(3) for k in range(2)] + [("s0", "l0", "t9", 0), ("rare", "l0", "t0", 7)]
    frame = frame_of(spark, cells)
    wanted = mixing.reachable(frame, {m: mixing.tempered(frame, m, 0.5) for m in mixing.MARGINS}, budget)
    for at, margin in enumerate(mixing.MARGINS):
        got = {r.value: r.wanted for r in wanted.filter(F.col("margin") == margin).collect()}
        want = wanted_of(cells, at, 0.5, budget)
        assert got == pytest.approx(want)
    rows = mixing.rake(frame, wanted).collect()
    total = sum(c[3] for c in cells)
    assert len(rows) == len(cells) and all(0 <= r.rate <= 1 for r in rows)
    for at, margin in enumerate(mixing.MARGINS):
        kept = defaultdict(float)
        for r in rows:
            kept[r[margin]] += r.rate * r.tokens
        for value, tokens in wanted_of(cells, at, 0.5, budget).items():
            assert abs(kept[value] - tokens) < 2e-4 * total


def test_contradictory_targets_give_way_to_own_shares(spark):
    cells = frame_of(spark, [("a", "x", "p", 100), ("b", "y", "p", 900)])
    targets = {"source": spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, target double"),
               "lang": spark.createDataFrame([("x", 1.0), ("y", 1.0)], "lang string, target double"),
               "topic": spark.createDataFrame([("p", 1.0)], "topic string, target double")}
    wanted = mixing.reachable(cells, targets, 0.5)
    assert {(r.margin, r.value): r.wanted for r in wanted.collect()} == {
        ("source", "a"): 100, ("source", "b"): 400, ("lang", "x"): 100, ("lang", "y"): 400, ("topic", "p"): 500}
    rows = cells.withColumnRenamed("tokens", "n_tokens")
    rated, _ = mixing._rated(rows, targets, 0.5)
    assert {r.source: r.rate for r in rated.collect()} == {"a": 1.0, "b": pytest.approx(400 / 900, abs=1e-4)}
    targets["lang"] = spark.createDataFrame([("x", 3.0), ("y", 1.0)], "lang string, target double")
    rated, wanted = mixing._rated(rows, targets, 0.15)  # one source, one language: only own shares agree
    assert {r.source: r.rate for r in rated.collect()} == {"a": 0.15, "b": 0.15}
    assert {r.value: (r.target, r.wanted) for r in wanted.filter("margin = 'lang'").collect()} == {
        "x": (0.75, pytest.approx(15)), "y": (0.25, pytest.approx(135))}


def test_sampled_shares_reach_the_targets(spark):
    """Over a larger table the drawn tokens lie within half a point of the reachable targets."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    shares = {(r.margin, r.value): r for r in mixing.shares(docs).collect()}
    rows = mixing.mix(docs).filter("kept").select(*mixing.MARGINS, "n_tokens").collect()
    total = sum(r.n_tokens for r in rows)
    drawn = Counter()
    for r in rows:
        for m in mixing.MARGINS:
            drawn[m, r[m]] += r.n_tokens
    for key, r in shares.items():
        assert abs(r.reachable - r.reached) < 1e-4 and abs(drawn[key] / total - r.reachable) < 0.005


def test_superseded_tables_are_deleted(spark):
    from pathlib import Path

    from lodestar.llm.tables import written
    from lodestar.session import discard, shared_dir
    df = spark.range(3)
    one, two = written(df), written(df)
    before = len(list(Path(shared_dir(spark), "lodestar").iterdir()))
    discard(one, df)
    assert len(list(Path(shared_dir(spark), "lodestar").iterdir())) == before - 1
    assert two.count() == 3


def test_awkward_rows(awkward, empty):
    rows = mixing.mix(awkward).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in AWKWARD)
    words = {r[0]: len(blank_words(r[1])) for r in AWKWARD if r[0] is not None}
    for r in rows:
        draw = int(hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:8], 16) / 2 ** 32
        assert 0 <= r.rate <= 1 and r.kept == (draw < r.rate)
        assert r.doc_id is None or r.n_tokens == words[r.doc_id]
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[7].source, by_id[7].lang, by_id[7].topic) == ("unknown", "unknown", "prose")
    kept = mixing.sample(awkward)
    assert kept.columns == awkward.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)
    assert tuples(mixing.mix(empty)) == tuples(mixing.sample(empty)) == []
