from collections import Counter

import numpy as np
import pyarrow as pa
from llm_helpers import AWKWARD, blank_words, tuples

from lodestar.llm.quality import COUNTS, RULES, estimate, measures, quality


def counts(text):
    text = text or ""
    words = blank_words(text)
    seen = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = [False] * len(words)
    for i in range(len(words) - 2):
        if seen[tuple(words[i:i + 3])] > 1:
            covered[i:i + 3] = [True] * 3
    lines = [line for line in text.split("\n") if blank_words(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            sum(covered))


def test_counts_of_awkward_rows():
    texts = [r[1] for r in AWKWARD] + ["a|b <c> #*$%& a a a a a", "x y z x y z w\nx y z x y z w\n \n \n"]
    got = measures(pa.array(texts))
    assert list(zip(*[got[c].tolist() for c in COUNTS[:5]])) == [counts(t) for t in texts]


def test_rows_and_posterior(awkward, empty):
    rows = quality(awkward).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in AWKWARD)
    assert all(0 <= r.posterior <= 1 and set(r.votes) == {name for name, _, _ in RULES} for r in rows)
    assert tuples(quality(empty)) == []


def test_estimation_finds_accuracies_without_labels():
    """Votes drawn from known accuracies: the posterior tells the classes apart better than any rule."""
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.85, 0.75, 0.6])
    right = rng.random((len(good), 5)) < accuracy
    votes = np.where(rng.random(right.shape) < 0.2, 0, np.where(right == good[:, None], 1, -1))
    patterns, which, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    shares, share, posterior = estimate(patterns, n.astype(float))
    hit = ((posterior[which.ravel()] >= 0.5) == good).mean()
    assert hit > 0.95 and abs(share - 0.8) < 0.03
    found = shares[0, 2] / (shares[0, 2] + shares[0, 0])
    assert np.abs(found - accuracy).max() < 0.06


def test_junk_loses_and_prose_stays(spark):
    prose = [(i, " ".join(f"Word{i}a{j} is here." for j in range(60))) for i in range(300)]
    junk = [(1000 + i, " ".join(f"w{j}###" for j in range(120))) for i in range(40)]
    docs = spark.createDataFrame(prose + junk, "doc_id long, text string")
    got = {r.doc_id: r.posterior for r in quality(docs).collect()}
    assert min(got[i] for i, _ in prose) > 0.5 > max(got[i] for i, _ in junk)
