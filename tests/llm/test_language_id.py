import numpy as np
from llm_helpers import AWKWARD, tuples

from lodestar.llm import language_id as li

ENGLISH = "the weather in the north was cold and the people of the town stayed at home with their books"
GERMAN = "das wetter im norden war kalt und die leute der stadt blieben mit ihren büchern zu hause"


def test_profile_is_the_bundle_of_bound_letters():
    text = "Ab-c"
    code = lambda c: li._letter_vectors(np.array([ord(c)]))[0].astype(int)
    want = np.zeros(li.DIMENSIONS, int)
    for word in ("ab", "c"):
        padded = f" {word} "
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            want += np.roll(code(a), 2) * np.roll(code(b), 1) * code(c)
    assert (li.profiles([text])[0] == want).all()
    whole = li.profiles([None, text, "", "12 !", ENGLISH])
    assert (whole[1] == want).all() and not whole[[0, 2, 3]].any()


def test_blocks_of_grams_change_nothing(monkeypatch):
    texts = [ENGLISH, GERMAN, None, "日本語 " + ENGLISH]
    whole = li.profiles(texts)
    monkeypatch.setattr(li, "GRAMS", 7)
    assert (li.profiles(texts) == whole).all()


def test_learns_and_predicts(spark, awkward, empty):
    rows = [(i, " ".join(np.random.default_rng(i).permutation(t.split())), lang)
            for i, (t, lang) in enumerate([(ENGLISH, "en"), (GERMAN, "de")] * 20)]
    known = li.prototypes(spark.createDataFrame(rows[:30] + [(99, None, "xx"), (98, "text", None)],
                                                "doc_id int, text string, lang string"))
    assert sorted(known) == ["de", "en"]
    rest = spark.createDataFrame(rows[30:], "doc_id int, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in li.language_id(rest, known).collect()} == {r[0]: r[2] for r in rows[30:]}
    got = li.language_id(awkward, known).collect()
    assert len(got) == len(AWKWARD)
    letterless = [r for r in got if r.doc_id in (6, 7, 8)]
    assert [(r.lang_pred, r.score) for r in letterless] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got)
    assert tuples(li.language_id(empty, known)) == []
    assert {r.lang_pred for r in li.language_id(awkward, li.prototypes(empty)).collect()} == {"und"}
