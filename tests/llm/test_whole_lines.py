"""op5 on lines that the first version left out, against a plain version without floors on near lines."""

import random
import re
from collections import defaultdict

import pytest

from graphloom.llm import line_dedup
from graphloom.llm import queries as registered

from ..conftest import DATA
from . import brute


def lines(docs, form, words, candidate):
    """What brute.lines() returns, with near lines of every length."""
    first = {}
    for i, t in sorted(docs):
        for k, x in enumerate((t or "").split("\n")):
            if candidate(f := form(x)):
                first.setdefault(f, (i, k))
    gone, by = set(), defaultdict(list)
    for f in sorted(first, key=first.get):
        w = words(f)
        if len(w) < 5:
            continue
        met = [(len(w), i, *w[:i], None, *w[i + 1 :]) for i in range(len(w))] + [(len(w) + 1, i, *w[:i], None, *w[i:]) for i in range(len(w) + 1)]
        if any(brute.one_edit(w, v) for m in met for v in by[m]):
            gone.add(f)
        for m in met:
            by[m].append(w)
    out = []
    for i, t in docs:
        all_lines = t.split("\n") if t is not None else []
        stay = [x for k, x in enumerate(all_lines) if not candidate(f := form(x)) or (first[f] == (i, k) and f not in gone)]
        out.append((i, len(all_lines), len(all_lines) - len(stay), "\n".join(stay) if t is not None else None))
    return out


def by_spaces(f):
    return re.split(" +", f)


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "_lines", "_removed", "text").collect())


@pytest.mark.parametrize("least", [5, 6, 7, 8, 10, 11, 12, 13, 14])
def test_near_lines_of_every_length(spark, least):
    r = random.Random(least)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(3, 7)))
    rows = []
    for i in range(60):
        w = [word() for _ in range(least)]
        k = r.randrange(least)
        made = [w, [*w[:k], word(), *w[k + 1 :]], [*w[:k], word(), *w[k:]], [*w[:k], *w[k + 1 :]], [*w[:k], word(), *w[k:-1], word()]]
        rows += [(5 * i + j, " ".join(x)) for j, x in enumerate(r.sample(made, 4))]
    r.shuffle(rows)
    want = lines(rows, brute.line_form, by_spaces, lambda f: len(by_spaces(f)) >= 5)
    assert sum(x[2] for x in want) > 60
    assert got(line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == sorted(want)


def test_near_lines_of_the_query(spark):
    sf = f"{DATA}/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = sorted(tuple(r) for r in registered.op5_line_dedup(spark, sf).collect())
    assert out == sorted(lines(rows, brute.line_form, by_spaces, lambda f: len(by_spaces(f)) >= 5))


def test_lines_without_spaces(spark):
    chinese, thai = "机器学习模型需要大量的训练数据", "ภาษาไทยเขียนโดยไม่เว้นวรรค"
    japanese = "データを集めて学習する。"
    tabs, url, code = "id\tname\tprice\tcolour\tsize", "https://example.org/" + "a/b" * 30, "for(i=0;i<n;i++){a[i]=b[i]*c[i];d+=a[i];}"
    long_lines = [chinese, thai, japanese, tabs, url, code, "one\u3000two\u3000three\u3000four\u3000five"]
    short_lines = ["}", "all rights reserved.", "第一章 绪论", "x\ty", "", "\t \r"]
    both = "\n".join(long_lines + short_lines)
    edges = "\n".join([f"\t{x}\u3000\r" for x in long_lines] + short_lines)
    changed = "\n".join([chinese[:-1] + "书", "id\tname\tprice\tcolour\tweight", url + "/c"])
    rows = [(1, both), (2, both), (3, edges), (4, changed)]
    out = got(line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    left = "\n".join(short_lines)
    assert out[:3] == [(1, 13, 0, both), (2, 13, 7, left), (3, 13, 7, left)]
    assert out[3] == (4, 3, 1, "\n".join([chinese[:-1] + "书", url + "/c"]))
