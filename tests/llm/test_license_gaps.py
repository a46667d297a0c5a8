"""Notices with words put in or left out in the middle."""

from lodestar.llm.license_scan import TEMPLATES, license_scan
from test_license_scan import WORDS

BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
       "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
       "of conditions and the following disclaimer.")


def labels(spark, texts):
    filler = ["plain words of a story without any notice"] * 300
    docs = spark.createDataFrame(list(enumerate([*texts, *filler])), "doc_id int, text string")
    got = {r.doc_id: [(m.label, m.start, m.end) for m in r.matches if not m.base] for r in license_scan(docs).collect()}
    assert not any(got[i] for i in range(len(texts), len(got)))
    return [got[i] for i in range(len(texts))]


def test_numbered_notice(spark):
    (found,) = labels(spark, ["x y " + BSD])
    assert found == [("bsd", 2, 2 + len(WORDS.findall(BSD.lower())))]


def test_one_middle_word_missing_or_several_put_in(spark):
    texts, want = [], []
    for label, text, keys in TEMPLATES:
        words = text.split()
        held = {w for k in keys for w in k.split()}
        middle = [i for i, w in enumerate(words) if i >= len(words) // 2 and not held & set(WORDS.findall(w.lower()))]
        if not middle:
            continue
        i = middle[0]
        texts += [" ".join(words[:i] + words[i + 1:]), " ".join(words[:i] + ["regents", "of", "somewhere", "7"] + words[i:]),
                  " ".join(reversed(words))]
        want += [label, label, None]
    for text, label, found in zip(texts, want, labels(spark, texts)):
        assert (label in {name for name, *_ in found}) if label else not found, (text, found)


def test_words_out_of_order_or_far_apart_do_not_add_up(spark):
    words = BSD.split()
    far = words[:21] + ["other"] * 40 + words[21:]
    swapped = words[21:] + words[:21]
    assert labels(spark, [" ".join(far), " ".join(swapped)]) == [[], []]
