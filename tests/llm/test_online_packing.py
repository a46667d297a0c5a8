import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import AWKWARD, PROSE, tuples
from tokenizers import Tokenizer

from lodestar.llm import online_packing, token_ids
from lodestar.llm.online_packing import Levels, Piece, close, pack_online
from lodestar.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out.encode_special_tokens = True
    return out


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, wanted, window):
    """Every id in exactly one piece, gapless sequences, no padding; returns the ids of each document."""
    left = defaultdict(list)
    for key, ids in wanted:
        left[key].append(np.array(ids, "<u4"))
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(docs) == set(left)
    for key, own in left.items():
        pieces = {(r.start, r.length, r.ids_crc32, r.doc_tokens): r for r in docs[key]}
        covered = 0
        for ids in own:
            for (start, length, crc, tokens) in pieces:
                if tokens == len(ids):
                    covered += zlib.crc32(ids[start:start + length].tobytes()) == crc and len(ids) >= start + length
        assert covered >= len(pieces)
        assert sum(r.length for r in docs[key]) == sum(map(len, own))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == window or at & (at - 1) == 0


@pytest.mark.parametrize("window,open_windows", [(16, 4), (64, 8192), (2048, 8192)])
def test_awkward_rows(awkward, empty, tokenizer, window, open_windows):
    rows = pack_online(awkward, window=window, open_windows=open_windows).collect()
    check(rows, [(r[0], ids_of(tokenizer, r[1])) for r in AWKWARD], window)
    assert tuples(pack_online(empty)) == []


def test_query_on_whole_documents(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    out = QUERIES["op13_online_packing"](spark, sf)
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check(out.collect(), [(d.doc_id, ids_of(tokenizer, d.text)) for d in docs], 2048)


@pytest.mark.parametrize("run", [40, 1 << 22])
def test_ids_equal_the_whole_text(monkeypatch, tokenizer, run):
    """Cutting a text into runs and chunks changes no id."""
    import pyarrow as pa
    monkeypatch.setattr(token_ids, "SLICE", run)
    texts = [r[1] for r in AWKWARD] + [
        "a  b\n c \n\n d\t e", "don't  we'll 'S x's 12 3a4  ", " lead", "é ñ ü ×  ÷     x 　y", "日本 語 テスト " * 30,
        "<|endoftext|> in a text <|endoftext|>", "1 2 3 " * 50 + PROSE, " " * 500, "  \u0085 x", "z" * 3000 + " end"]
    got = defaultdict(list)
    for i, ids, _ in token_ids.token_parts(pa.array(texts), "byte_bpe_50k"):
        got[i] += ids.tolist()
    for i, text in enumerate(texts):
        assert got[i] + [1] == ids_of(tokenizer, text), text


def test_place_minimises_the_sum_of_squares():
    rng = np.random.default_rng(3)
    levels = Levels(32)
    for size in rng.integers(1, 32, 500).tolist():
        n = levels.counts.copy()

        def squares(level):
            now = n.copy()
            if level:
                now[level] -= 1
            if level + size < 32:
                now[level + size] += 1
            return int((now[1:32] ** 2).sum())

        options = [0] + [h for h in range(1, 33 - size) if n[h]]
        best = min(map(squares, options))
        level = levels.place(size)
        assert level in options and squares(level) == best
        assert level == max(h for h in options if squares(h) == best)
        levels.put(Piece(None, 0, np.zeros(size, np.uint32)))
        assert levels.counts[0] == levels.counts[32] == 0 and levels.open == levels.counts.sum()


def test_perfectly_packable_sizes_leave_few_windows_open():
    rng = np.random.default_rng(5)
    levels = Levels(64)
    for size in rng.choice([16, 24, 40, 48], 4000).tolist():
        levels.put(Piece(None, 0, np.zeros(size, np.uint32)))
    assert levels.open < 2 * 4000 ** 0.5


@pytest.mark.parametrize("seed", range(5))
def test_close_fills_all_windows(seed):
    rng = np.random.default_rng(seed)
    levels, total = Levels(64), 0
    for size in rng.integers(1, 64, seed * 7).tolist():
        done = levels.put(Piece(None, 0, np.arange(size, dtype=np.uint32)))
        total += 0 if done else size
        total -= sum(len(p.ids) for p in done[:-1]) if done else 0
    sizes = [sum(len(p.ids) for p in own) for own in close(levels.drain(), 64)]
    assert sum(sizes) == total and sizes[:total // 64] == [64] * (total // 64)
    assert sizes[total // 64:] == [1 << i for i in range(6, -1, -1) if total % 64 >> i & 1]


def test_window_must_be_a_power_of_two(awkward):
    with pytest.raises(ValueError):
        pack_online(awkward, window=1000)
    assert online_packing.WINDOW == 2048
