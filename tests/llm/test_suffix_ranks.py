"""op1: suffixes of names whose place is settled are not sorted again."""

import numpy as np
import pytest

from graphloom.llm import suffix_array as sa


@pytest.mark.parametrize("seed", range(8))
def test_order_of_names(seed):
    r = np.random.default_rng(seed)
    part = r.integers(0, 1 + seed, 40)
    names = np.concatenate([part, r.integers(0, 3, 20), part, part[:7], np.zeros(seed, np.int64)])
    got = sa.doubled(names).tolist()
    assert got == sorted(range(len(names)), key=lambda i: names[i:].tolist())


def test_settled_names_stay(monkeypatch):
    sort, sizes = np.argsort, []
    part = np.arange(100, 164)
    names = np.concatenate([part, np.arange(1000, 5000), part, [0]])
    monkeypatch.setattr(sa.np, "argsort", lambda x, **k: (sizes.append(len(x)), sort(x, **k))[1])
    assert sa.doubled(names).tolist() == sorted(range(len(names)), key=lambda i: names[i : i + 70].tolist())
    assert sum(sizes) < 2 * len(names)
