"""Exact tests, bootstrap intervals and run comparisons (ST1-ST10)."""

from __future__ import annotations

import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import let


def log_factorial(n: Column) -> Column:
    """ln n!, as a sum of logarithms."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of the discordant counts; 1 if there are none. Terms are kept relative to the last, which is the
    largest, so no count is too big."""
    n, m = (b + c).cast("int"), F.least(b, c).cast("int")
    # From C(n, m) downwards: C(n, i - 1) / C(n, i) = i / (n - i + 1).
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a: Column, j: Column) -> Column:
        i = m - j + 1
        term = a["term"] * i / (n - i + 1)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    total = F.aggregate(F.when(m < 1, F.expr("cast(array() as array<int>)")).otherwise(F.sequence(F.lit(1), F.greatest(m, F.lit(1)))), start, step)["sum"]
    p = 2 * F.exp(log_choose(n, m) - n * F.log(F.lit(2.0))) * total
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), p))


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided exact p of a 2 x 2 table: all tables of its margins that are as unlikely or more. 1 for an empty table.

    Terms are kept relative to the largest, from which they are worked out both ways, each from the one before; their sum
    stands for 1. So the work is in proportion to the counts, twice: for the sum, and for what is as unlikely."""
    a, b, c, d = (x.cast("long") for x in (a, b, c, d))
    row, one, two, n = a + b, a + c, b + d, a + b + c + d
    top = F.floor((row + 1).cast("double") * (one + 1) / (n + 2)).cast("long")
    low, high = F.greatest(F.lit(0), row - two), F.least(row, one)
    margins = F.struct(a.alias("a"), *(x.cast("double").alias(k) for k, x in (("row", row), ("one", one), ("rest", two - row))), low.alias("low"), high.alias("high"), F.least(F.greatest(top, low), high).alias("top"))
    none = F.expr("cast(array() as array<bigint>)")

    def walk(m: Column, start: Column, add: Callable[[Column, Column, Column], Column]) -> Column:
        """Goes over the terms above the largest and then over those below it: add(sums, x, term) at each."""
        begun = lambda sums: F.struct(F.lit(1.0).alias("term"), sums.alias("sums"))

        def go(acc: Column, x: Column, ratio: Column) -> Column:
            return let(acc["term"] * ratio, lambda term: F.struct(term.alias("term"), add(acc["sums"], x, term).alias("sums")))

        up = lambda acc, x: go(acc, x, (m["one"] - x + 1) * (m["row"] - x + 1) / (x * (m["rest"] + x)))
        down = lambda acc, x: go(acc, x, (x + 1) * (m["rest"] + x + 1) / ((m["one"] - x) * (m["row"] - x)))
        above = F.when(m["top"] < m["high"], F.sequence(m["top"] + 1, m["high"])).otherwise(none)
        below = F.when(m["top"] > m["low"], F.sequence(m["top"] - 1, m["low"], F.lit(-1).cast("long"))).otherwise(none)
        return F.aggregate(below, begun(F.aggregate(above, begun(start), up)["sums"]), down)["sums"]

    def as_unlikely(m: Column) -> Column:
        two_sums = lambda total, seen: F.struct(total.alias("total"), seen.alias("seen"))
        every = walk(m, two_sums(F.lit(1.0), F.when(m["a"] == m["top"], 1.0).otherwise(0.0)), lambda s, x, term: two_sums(s["total"] + term, F.when(x == m["a"], term).otherwise(s["seen"])))

        def share(s: Column) -> Column:
            most = s["seen"] / s["total"] + 1e-12
            part = lambda term: let(term / s["total"], lambda q: F.when(q <= most, q).otherwise(0.0))
            return walk(m, part(F.lit(1.0)), lambda t, x, term: t + part(term))

        return let(every, share)

    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), let(margins, as_unlikely)))


def fisher_table(tables: DataFrame) -> DataFrame:
    """Adds p to rows with a, b, c, d."""
    return tables.withColumn("p", fisher(*map(F.col, "abcd")))


def bootstrap(groups: DataFrame, by: str, value: str, order: str, n: int = 10_000, seed: int = 12345) -> DataFrame:
    """Mean with its 95 % percentile interval, for each group of run results (small by nature), reproducibly."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, r = pdf.sort_values(order)[value].tolist(), random.Random(seed)
        means = sorted(sum(r.choice(x) for _ in x) / len(x) for _ in range(n))
        return pd.DataFrame([(pdf[by].iloc[0], sum(x) / len(x), means[int(0.025 * n)], means[min(n - 1, int(0.975 * n))])], columns=[by, "mean", "low", "high"])

    return groups.groupBy(by).applyInPandas(one, f"{by} string, mean double, low double, high double")


def bootstrap_difference(a: list[float], b: list[float], n: int = 10_000, seed: int = 999) -> tuple[float, float, float]:
    r = random.Random(seed)
    mean = lambda x: sum(x) / len(x)
    d = sorted(mean([r.choice(a) for _ in a]) - mean([r.choice(b) for _ in b]) for _ in range(n))
    return mean(a) - mean(b), d[int(0.025 * n)], d[min(n - 1, int(0.975 * n))]


def paired_table(items: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Both, only a, only b, neither."""
    x, y = F.coalesce(F.col(a), F.lit(False)), F.coalesce(F.col(b), F.lit(False))
    return items.groupBy(*by).agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))


def pair_differences(arms: DataFrame, key: str, value: str) -> DataFrame:
    """Differences of all pairs of arms (arms are few: one row each)."""
    l, r = arms.select(F.col(key).alias("a"), F.col(value).alias("_x")), arms.select(F.col(key).alias("b"), F.col(value).alias("_y"))
    return l.join(r, F.col("a") < F.col("b")).select("a", "b", (F.col("_x") - F.col("_y")).alias("difference"))


def pooling_curve(found: DataFrame, run: str, item: str) -> DataFrame:
    """Distinct items of the first k runs: each item counts from its first run on."""
    from pyspark.sql import Window

    first = found.groupBy(item).agg(F.min(run).alias("k"))
    runs = found.select(F.col(run).alias("k")).distinct()
    new = runs.join(first.groupBy("k").agg(F.count("*").alias("new")), "k", "left").withColumn("new", F.coalesce("new", F.lit(0)))
    return new.select("k", "new", F.sum("new").over(Window.orderBy("k")).alias("pooled"))


def positional(items: DataFrame, line: str, total: str, caught: str) -> DataFrame:
    return items.groupBy(caught).agg(F.count("*").alias("n"), F.avg(F.col(line) / F.col(total)).alias("depth_ratio"))


def distribution(runs: DataFrame, by: str, value: str) -> DataFrame:
    return runs.groupBy(by).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.array_sort(F.collect_list(value)).alias("points"))
