"""op6: the exact blocks of long lists lose no link, and do not send whole sets to every block of every list."""

import random

import numpy as np
import pandas as pd

from graphloom.llm import minhash

from . import brute


def frame(values, first):
    return pd.DataFrame({"rep": range(first, first + len(values)), "n": [len(v) for v in values], "component": range(first, first + len(values)), "bits": [minhash.parity(v) for v in values]})


def test_bits_rule_out_no_link():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 10, 31, 32, 33, 64, 147, 500, 513):
        base = r.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        sets = [np.unique(np.concatenate([base[: n - lost], base[n : n + more]])) for lost in range(n // 4 + 1) for more in {0, n // 9, n // 5, n // 4}]
        want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j and minhash.linked(len(np.intersect1d(x, y)), len(x), len(y))}
        left = frame(sets, 0)
        found = minhash.maybe_linked(left, left.copy())
        assert want <= set(zip(found.a, found.b, strict=True))


def test_lists_of_unlike_classes(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(150)]
    docs = [(i, [*passage, *(word() for _ in range(150))]) for i in range(380)]
    docs += [(380 + i, [*docs[i][1][: 300 - 4 * i], *(word() for _ in range(4 * i))]) for i in range(20)]
    rows = [(i, " ".join(w)) for i, w in docs]
    hot = spark.createDataFrame([(v, i, 297, v) for v in range(20) for i, _ in rows], "v long, rep long, n long, rank int")
    label = spark.createDataFrame([], "node long, component long")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = written()
    links = {tuple(sorted(x)) for x in minhash.minor_links(hot, label, spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    sent = written() - before
    sets = {i: brute.shingle_set(t, 4) for i, t in rows}
    want = {(i, j) for i in sets for j in sets if i < j and minhash.linked(len(sets[i] & sets[j]), len(sets[i]), len(sets[j]))}
    assert links == want and len(want) > 5
    assert 0 < sent < 20e6
