import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import compare, duck
from llm_helpers import AWKWARD, UPPER, tuples

from lodestar.llm import spelling
from lodestar.llm.queries import ORACLES, QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def vocabulary(docs, least, modulus):
    out = Counter()
    for key, text in docs:
        for word in RUN.findall(text or ""):
            word = word.translate(UPPER)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if modulus and h % modulus == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            out[word] += len(word) >= least
    return {w: n for w, n in out.items() if n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(vocab, ratio):
    near = {w: [v for v in vocab if one_edit(w, v)] for w in vocab}
    forms = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-vocab[v], v), default=None)
        forms[w] = best if best and vocab[best] >= ratio * vocab[w] else None
    out = []
    for w in vocab:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, vocab[w], len(near[w]), vocab.get(forms[w])))
    return sorted(out)


def made_up(seed):
    """Words over few letters with many near words, hot beginnings and ends, copies and rare misspellings."""
    rng = np.random.default_rng(seed)
    letters = list("abéß" if seed % 2 else "ab")
    words = ["".join(rng.choice(letters, rng.integers(3, 9))) for _ in range(150)]
    words += ["commonstart" + w for w in words[:60]] + [w + "gemeinsam" for w in words[:60]]
    words += ["aaaaaaaa"[:i] for i in range(9)] + ["abababab"[:i] for i in range(9)]
    return [(int(i), " ".join(rng.choice(words, 400, p=None if i % 2 else None))) for i in range(6)] + [
        (90, ("Correctly " * 300 + "corectly corectly " * 2 + "corecctly " * 2) * 2)]


@pytest.mark.parametrize("seed,most", [(0, 20_000), (1, 3), (2, 1), (3, 7)])
def test_equals_brute_force(spark, seed, most):
    docs = made_up(seed)
    df = spark.createDataFrame([(*d, 1, "w") for d in docs], "doc_id long, text string, n long, word string")
    got = spelling.spelling_variants(df, least=2, ratio=3, modulus=7, most=most)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in got.collect()) == brute(vocabulary(docs, 2, 7), 3)


@pytest.mark.parametrize("least,run", [(7, 4 << 20), (1, 50)])
def test_awkward_rows(awkward, empty, monkeypatch, least, run):
    monkeypatch.setattr(spelling, "SLICE", run)
    got = spelling.spelling_variants(awkward, least=least, ratio=2)
    assert sorted(tuple(r) for r in got.collect()) == brute(vocabulary([r[:2] for r in AWKWARD], least, 31), 2)
    assert tuples(spelling.spelling_variants(empty)) == []


def test_very_long_words(spark):
    long = "xy" * 40_000
    texts = [long, long + "z", long[:30_000] + "q" + long[30_000:], long[:50_000] + "w" + long[50_001:], "x" * 70_000]
    df = spark.createDataFrame([(i, f"{t} {t}") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.word: r.n_near for r in spelling.spelling_variants(df, modulus=0).collect()}
    assert [got[t] for t in texts] == [3, 1, 1, 1, 0]


def test_equal_ends_share_states():
    acceptor = spelling.Acceptor()
    words = sorted(a + b + "ing" for a in "klmn" for b in ("end", "est", "old"))
    start = acceptor.initial(words)
    assert len(acceptor.steps) < 16  # the trie has 53
    assert sorted(acceptor.common(start, start)) == words
    pairs = {frozenset(p) for p in acceptor.composed(start, start)}
    assert pairs == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
    longer = acceptor.initial(sorted({w[:i] + c + w[i:] for w in words[:3] for c in "ae" for i in range(len(w) + 1)}))
    found = list(acceptor.composed(start, longer))
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in words for b in acceptor.common(longer, longer) if one_edit(a, b)}


def test_crc_of_stretches():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 2900, 200))
    ends = starts + rng.integers(1, 100, 200)
    before = rng.integers(0, 1 << 32, 200, dtype=np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(s)) for a, b, s in zip(starts, ends, before)]
    assert spelling.crc32(data, starts, ends, before).tolist() == want


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    name = "op11_spelling_variants"
    assert compare(spark, duck(sf), sf, QUERIES[name], ORACLES[name]) is None
