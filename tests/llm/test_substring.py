from collections import Counter

import pytest
from llm_helpers import blank_words, tuples

from lodestar.llm.substring import substring_dedup


def expected(texts, width):
    docs = [blank_words(t) for t in texts]
    seen = Counter(tuple(d[i:i + width]) for d in docs for i in range(len(d) - width + 1))
    out = []
    for d in docs:
        gone = [False] * len(d)
        for i in range(len(d) - width + 1):
            if seen[tuple(d[i:i + width])] > 1:
                gone[i:i + width] = [True] * width
        out.append((len(d), sum(gone), " ".join(w for w, g in zip(d, gone) if not g)))
    return out


@pytest.mark.parametrize("width", [1, 3, 10, 35])
def test_awkward_rows(awkward, width):
    rows = awkward.collect()
    want = sorted(zip([str(r.doc_id) for r in rows], *zip(*expected([r.text for r in rows], width))))
    got = sorted((str(r.doc_id), r.n_words, sum(s.end - s.start for s in r.removed), r.kept_text)
                 for r in substring_dedup(awkward, width).collect())
    assert got == want


def test_spans_are_maximal(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "x b c d e y f g h")], "doc_id int, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.removed] for r in substring_dedup(docs, 3).collect()}
    assert got == {1: [(1, 8)], 2: [(1, 5), (6, 9)]}


def test_empty_table(empty):
    assert tuples(substring_dedup(empty)) == []
