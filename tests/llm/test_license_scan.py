import re

from llm_helpers import AWKWARD, UPPER, tuples

from lodestar.llm.license_scan import PHRASES, TEMPLATES, license_scan

WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    words = WORDS.findall((text or "").translate(UPPER))
    found = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        found += [(i, i + len(parts), label) for i in range(len(words) - len(parts) + 1) if words[i:i + len(parts)] == parts]
    return len(words), sorted(found)


def test_phrases_in_awkward_texts(spark, empty):
    texts = [r[1] for r in AWKWARD] + [
        "Licensed under the APACHE   License! apache-license", "CC BY cc by-nc ccby cc_by", "gnu general public license license",
        "mit", "license mit license", "MİT license mıt license", "the mit licensé mit\x7flicense"]
    rows = [(i, t, "a", 1.0) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, matches string, n_words double")
    got = {r.doc_id: (r.n_words, [(m.start, m.end, m.label) for m in r.matches if m.base])
           for r in license_scan(frame).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}
    assert tuples(license_scan(empty)) == []


def test_notices_are_found_in_place_and_only_with_their_key_phrases(spark):
    rows = []
    for label, text, keys in TEMPLATES:
        words = text.split()
        rows.append((label, f"some code before // {text} and after", True))
        rows.append((label, " ".join(w for i, w in enumerate(words) if i != len(words) // 2 or any(
            WORDS.findall(w.lower())[0] in k for k in keys if WORDS.findall(w.lower()))), True))
        rows.append((label, " ".join(reversed(words)), False))
        rows.append((label, " ".join(words[len(words) // 2:] + ["filler"] * 5), False))
    filler = [(f"f{i}", "plain words of a story without any notice", False) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(rows + filler)], "doc_id int, text string")
    got = {r.doc_id: {m.label for m in r.matches if not m.base} for r in license_scan(docs).collect()}
    for i, (label, _, there) in enumerate(rows):
        if i % 4 == 0:
            assert label in got[i], (label, got[i])
        if i % 4 == 2:
            assert label not in got[i], label
    assert all(not got[len(rows) + i] for i in range(len(filler)))


def test_score_and_place(spark):
    text = TEMPLATES[0][1]
    docs = spark.createDataFrame([(1, "x y " + text)] + [(i, "common words here") for i in range(2, 60)], "doc_id int, text string")
    match = next(m for r in license_scan(docs).collect() if r.doc_id == 1 for m in r.matches if not m.base)
    assert (match.label, match.start, match.end) == ("mit", 2, 2 + len(WORDS.findall(text.lower()))) and match.score > 0.999
