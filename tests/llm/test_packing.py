from collections import defaultdict

import numpy as np
import pytest
from llm_helpers import AWKWARD, blank_words, tuples

from lodestar.llm.packing import best_fit, cost, pack


def check(lengths, capacities):
    bins, offsets, sizes = pack(lengths, capacities)
    inside = defaultdict(list)
    for length, b, offset in zip(lengths, bins, offsets):
        inside[b].append((offset, length))
    assert sorted(inside) == list(range(len(sizes)))
    for b, parts in inside.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= sizes[b] and all(c < end for c in capacities if c < sizes[b])
    return sizes


@pytest.mark.parametrize("seed", range(6))
def test_bins_hold_their_pieces(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, rng.integers(0, 400)).tolist()
    capacities = [8, 16, 64] if seed % 2 else [64]
    sizes = check(lengths, capacities)
    assert sum(sizes) >= sum(lengths)
    if len(lengths) > 50:
        assert sum(sizes) < 1.15 * sum(lengths)
        assert sum(map(cost, sizes)) <= sum(map(cost, pack(lengths, [64])[2])) * 1.001


def test_exact_small_case():
    assert sorted(check([4, 4, 5, 3, 8], [8])) == [8, 8, 8]
    assert sorted(check([3, 2], [4, 16])) == [4, 4] or sorted(check([3, 2], [4, 16])) == [16]


@pytest.mark.parametrize("group", [3, 50_000])
def test_documents_are_packed_whole(awkward, empty, group):
    rows = best_fit(awkward, (8, 32, 128), group=group).collect()
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.doc_id] += r.length
        assert (r.bin is None) == (r.length == 0) and r.start == 128 * r.piece
    want = defaultdict(int)
    for r in AWKWARD:
        want[r[0]] += len(blank_words(r[1])) + bool(blank_words(r[1]))
    assert tokens == want
    bins = defaultdict(list)
    for r in rows:
        if r.length:
            bins[r.bin].append((r.offset, r.length, r.capacity))
    for parts in bins.values():
        parts.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[0][0] == 0
        assert parts[-1][0] + parts[-1][1] <= parts[0][2]
    assert tuples(best_fit(empty)) == []
