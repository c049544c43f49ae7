"""op6: members of long lists and their leaders, of which few that are no link come to full sets."""

import random

import numpy as np
import pandas as pd

from graphloom.llm import minhash

from . import brute


def test_possible_pairs_hold_every_link(spark):
    r = np.random.default_rng(3)
    sets = []
    for n in (1, 2, 5, 31, 32, 33, 65, 147):
        base = r.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[: n - lost], base[n : n + more]])) for lost in range(n // 8 + 1) for more in {0, n // 9, n // 5, n // 4}]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))]
    want = {(i, j) for i, j in pairs if minhash.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    bits = spark.createDataFrame(pd.DataFrame({"id": range(len(sets)), "n": [len(v) for v in sets], "bits": [minhash.parity(v) for v in sets]}))
    left = minhash.possible(spark.createDataFrame([(i, j, 0.5) for i, j in pairs], "a long, b long, est double"), bits)
    found = {(x.a, x.b) for x in left.collect()}
    assert left.columns == ["a", "b", "est"] and want <= found
    assert len(found - want) < (len(pairs) - len(want)) / 2


def test_group_of_half_alike_texts(spark, monkeypatch):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(100)], []
    for i in range(150):
        w = list(base)
        for at in r.sample(range(100), i % 5 + 1):
            w[at] = word()
        rows.append((i, " ".join(w)))
    checked, real = [], minhash.verify
    monkeypatch.setattr(minhash, "verify", lambda pairs, sets: (checked.append(pairs.count()), real(pairs, sets))[1])
    out = minhash.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(tuple(x) for x in out.collect()) == brute.near(rows)
    assert sum(checked) < 3 * len(rows)
