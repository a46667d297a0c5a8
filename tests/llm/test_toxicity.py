import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import AWKWARD, tuples

from lodestar.llm import toxicity as tx

RUDE = ["grubface", "mudlump", "snotwit", "grubfaced", "mudlumps"]


def corpus(n, seed, rude=0.3):
    rng = np.random.default_rng(seed)
    common = ["river", "table", "walks", "green", "house", "letter", "you", "they", "market", "window"]
    rows = []
    for i in range(n):
        words = list(rng.choice(common, 40))
        toxic = rng.random() < rude
        if toxic:
            for at in rng.integers(0, 40, 5):
                words[at] = str(rng.choice(RUDE))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = corpus(400, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(5000, 1), (None, 1), (3, None)],
                                   "doc_id long, toxic int")
    return tx.fit(docs, labels)


def test_unseen_texts(spark, model):
    rows = corpus(200, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    score = {r.doc_id: r.score for r in model.score(docs).collect()}
    assert np.mean([(score[i] >= 0.7) == bool(label) for i, _, label in rows]) > 0.97


def test_awkward_rows(model, awkward, empty):
    got = model.score(awkward, keep=["text", "score"], name="s").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(r[0]), str(r[1])) for r in AWKWARD)
    assert all(0 <= r.s < 0.5 and r.score == 1.5 for r in got)
    assert tuples(model.score(empty)) == []


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1)]])
def test_labels_of_one_class(spark, awkward, labels):
    model = tx.fit(awkward, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.score for r in model.score(awkward).collect()}
    assert got == {float(bool(labels) and labels[0][1])}


def test_features_by_hand():
    rude = tx.Lexicon(*(lambda h: (np.sort(h), np.ones(1)))(tx.words.cut(pa.array(["mudlump"])).hashes()))
    names = {n: i for i, n in enumerate(tx.FEATURES)}
    rows = tx.features(pa.array(["you MUDLUMP mudlump !!", None, "mudlum* a*b 4 5", "mud1ump mudlump", "aaab bbb ccc"]), rude)
    first = rows[0]
    assert first[names["hits"]] == np.log1p(2) and first[names["kinds"]] == 1 and first[names["density"]] == pytest.approx(200 / 3)
    assert first[names["near_second_person"]] == pytest.approx(200 / 3) and first[names["shouted"]] == pytest.approx(100 / 3)
    assert not rows[1].any()
    assert rows[2][names["masked"]] > 0 and rows[4][names["stretched"]] > 0
    assert rows[3][names["hits"]] == np.log1p(1)


def test_sample_is_bounded(spark):
    labels = spark.range(20_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    rows = tx.sample(labels, "toxic", toxic=300, clean=1000).groupBy("label").count().collect()
    n = {r.label: r["count"] for r in rows}
    assert 200 < n[1] < 400 and 850 < n[0] < 1150
