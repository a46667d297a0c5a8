import re

import numpy as np
import pyarrow as pa

from lodestar.llm import words
from lodestar.llm.repeats import at_most_twice, members


def test_words_as_the_patterns_say():
    texts = ["a b", None, "", "  x\ty\n", "ä\xa0ö ü", "no-break\x1chere", "Z9 _z! É", "a"]
    array = pa.array(["skipped", *texts]).slice(1)
    for table, pattern, fold in ((words.BLANKS, "[^\x20\x09-\x0D]+", False),
                                 (words.PLAIN, "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        cut = words.cut(array, table, fold)
        raw = cut.data.tobytes()
        got = [[raw[s:e].decode() for s, e in zip(cut.starts[a:b], cut.ends[a:b])]
               for a, b in zip(cut.bounds, cut.bounds[1:])]
        lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}) if fold else {}
        want = [re.findall(pattern, (t or "").translate(lower)) for t in texts]
        assert [[w.translate(lower) for w in g] for g in got] == want


def test_hashes_tell_words_and_windows_apart(monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 3, rng.integers(1, 5))) for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 40))) for _ in range(50)]
    cut = words.cut(pa.array(texts))
    flat = [w for t in texts for w in t.split()]
    whole = cut.hashes()
    assert len(set(whole.tolist())) == len(set(flat)) == len(set(zip(whole.tolist(), flat)))
    first = words.windows(whole, 3)
    inside = words.window_starts(cut.bounds, 3)
    want = [tuple(t.split()[i:i + 3]) for t in texts for i in range(len(t.split()) - 2)]
    got = first[inside].tolist()
    assert len(got) == len(want) and len(set(got)) == len(set(want)) == len(set(zip(got, want)))
    monkeypatch.setattr(words, "SEGMENT", 16)
    assert (words.cut(pa.array(texts)).hashes() == whole).all()
    assert (words.windows(whole, 3) == first).all()


def test_slices_cover_every_row_once():
    table = pa.table({"text": ["x" * n for n in (5, 0, 300, 2, 2, 2, 90)]})
    parts = [p.column("text").to_pylist() for p in words.slices(table, "text", 100)]
    assert sum(parts, []) == table.column("text").to_pylist()
    assert all(len(p) == 1 or sum(map(len, p)) <= 100 for p in parts)
    assert list(words.slices(table.slice(0, 0), "text")) == []


def test_no_texts_at_all():
    cut = words.cut(pa.array([], pa.string()))
    assert len(cut.hashes()) == 0 and len(cut.counts()) == 0 and len(words.windows(cut.hashes(), 5)) == 0


def test_pre_aggregation_keeps_two():
    values = np.array([5, 1, 5, 5, 2, 2], np.uint64)
    assert at_most_twice(values).tolist() == [1, 2, 2, 5, 5]
    assert members(values, np.array([2, 5], np.uint64)).tolist() == [True, False, True, True, True, True]
