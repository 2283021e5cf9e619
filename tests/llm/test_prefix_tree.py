"""The prefix tree finds exactly the pairs over the threshold."""

import numpy as np
import pytest

from kiln.llm import prefix_tree
from kiln.llm.prefix_tree import PrefixTree


def some_sets():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(-2**62, 2**62, n)) for n in (1, 2, 5, 30, 130, 400) for _ in range(3)]
    out = {}
    for _ in range(400):
        b = base[rng.integers(len(base))]
        k = max(1, int(len(b) * (1 - rng.choice([0, .02, .05, .2]))))
        s = np.unique(np.append(rng.choice(b, k, replace=False), rng.integers(-2**62, 2**62, rng.integers(0, len(b) // 20 + 2))))
        out[s.tobytes()] = s
    return list(out.values())


@pytest.mark.parametrize("percent", [80, 90, 100])
@pytest.mark.parametrize("lookups", [8_000_000, 1000])
def test_all_pairs(percent, lookups, monkeypatch):
    monkeypatch.setattr(prefix_tree, "LOOKUPS", lookups)
    sets = some_sets()
    plain = [frozenset(s.tolist()) for s in sets]
    want = {(i, j) for i, a in enumerate(plain) for j, b in enumerate(plain)
            if i != j and 100 * len(a & b) >= percent * len(a | b)}
    for component in (list(range(len(sets))), [i % 3 for i in range(len(sets))], [7] * len(sets)):
        got = list(PrefixTree(sets, component).links(sets, component, percent))
        assert sorted(got) == sorted((i, j) for i, j in want if component[i] != component[j])


def test_one_set():
    s = np.arange(5)
    assert list(PrefixTree([s], [1]).links([s, s[:4], np.arange(50, 60)], [1, 2, 3], 80)) == [(1, 0)]
