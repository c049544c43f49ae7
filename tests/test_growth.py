"""Work that grows with the input and no faster."""

import itertools
import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom import spec
from graphloom.operators import authorship, stats, traverse
from graphloom.plans import catalogue, lineage


def rows_made(spark, df):
    """Rows that the steps of a plan put out, by kind of step, once it has run."""
    out, todo = Counter(), [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        rows = node.metrics().get("numOutputRows")
        if rows.isDefined():
            out[node.nodeName()] = max(out[node.nodeName()], rows.get().value())
    return out


@pytest.fixture
def plainly(spark):
    """Plans as they are, whose steps can be counted."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_file_detection_makes_no_pairs(plainly, tmp_path):
    plainly.range(600).select(F.col("id").alias("s_suppkey"), F.lit(3).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    plainly.range(600).select(F.lit(3).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    df = catalogue.queries()["q_file_detection"](plainly, str(tmp_path))
    assert df.collect()[0].asDict() == {"n_files": 600, "n_detected": 600, "recall": 1.0, "missed": None}
    assert max(rows_made(plainly, df).values()) == 600


def test_fisher_takes_time_in_proportion_to_the_counts(spark):
    counts = (18_000, 15_000, 15_000, 12_300)
    one_p = lambda t: stats.fisher_table(spark.createDataFrame([t], "a int, b int, c int, d int")).first().p
    one_p((3, 1, 2, 4))
    began = time.perf_counter()
    got = one_p(counts)
    assert time.perf_counter() - began < 30
    a, b, c, d = counts
    one, two, row, n = a + c, b + d, a + b, sum(counts)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = lambda x: math.exp(choose(one, x) + choose(two, row - x) - choose(n, row))
    want = sum(q for x in range(max(0, row - two), min(row, one) + 1) if (q := p(x)) <= p(a) + 1e-12)
    assert 0 < want < 1 and math.isclose(got, want, rel_tol=1e-6)


def test_fisher_of_every_small_table(spark):
    tables = list(itertools.product(range(5), repeat=4))
    for r in stats.fisher_table(spark.createDataFrame(tables, "a int, b int, c int, d int")).collect():
        one, two, row, n = r.a + r.c, r.b + r.d, r.a + r.b, r.a + r.b + r.c + r.d
        p = lambda x: math.comb(one, x) * math.comb(two, row - x) / math.comb(n, row)  # noqa: B023, E731
        want = min(1.0, sum(p(x) for x in range(max(0, row - two), min(row, one) + 1) if p(x) <= p(r.a) + 1e-12)) if n else 1.0
        assert math.isclose(r.p, want, rel_tol=1e-9)


def test_uniform_style_takes_time_in_proportion_to_the_lines(spark):
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6000)), lambda i: F.concat(F.repeat(F.lit(" "), (4 * (i % 2)).cast("int")), F.lit("x"))), "\n")
    df = spark.range(8).repartition(1).select(authorship.uniform_style(F.concat(text, F.col("id").cast("string"))).alias("score"))
    began = time.perf_counter()
    assert {r.score for r in df.collect()} == {0.7}
    assert time.perf_counter() - began < 20


def test_every_pattern_is_counted_once_a_text(spark):
    df = spark.createDataFrame([("+def f(x):\n+    return x",)], "diff string")
    plan = authorship.analyze(df).select("confidence", "likely_ai")._jdf.queryExecution().optimizedPlan().toString()
    for p in [*spec.DEFENSIVE_PATTERNS, *spec.RISKY_PATTERNS, *spec.COMMENT_PATTERNS]:
        assert plan.count(f"{authorship.INSENSITIVE}{p}, 0)") == 1, p
    assert plan.count(f"(?m){spec.FUNCTION_START}, 0)") == 1


def kept_rows(monkeypatch):
    """Collects how many rows each cut of lineage writes."""
    kept = []

    def noted(df):
        out = lineage.cut(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(traverse, "cut", noted)
    return kept


def test_neighborhood_keeps_no_copy_of_the_edges(spark, monkeypatch):
    far = spark.range(3000).select(F.concat(F.lit("a"), "id").alias("src"), F.concat(F.lit("b"), "id").alias("dst"))
    edges = far.union(spark.createDataFrame([("t", "u"), ("v", "t"), ("u", "w")], "src string, dst string")).distinct()
    kept = kept_rows(monkeypatch)
    got = traverse.neighborhood(edges, "t", 2, 1 << 30).collect()
    assert [tuple(r) for r in got] == [("t", 0), ("u", 1), ("v", 1), ("w", 2)]
    assert max(kept) <= 4


def test_capped_neighborhood_stops_where_it_has_enough(spark, monkeypatch):
    edges = spark.createDataFrame([(f"v{i}", "t") for i in range(5)] + [(f"w{i}", "v0") for i in range(40)], "src string, dst string")
    kept = kept_rows(monkeypatch)
    got = traverse.neighborhood(edges, "t", 2, 4).collect()
    assert [tuple(r) for r in got] == [("t", 0), ("v0", 1), ("v1", 1), ("v2", 1)]
    assert sum(kept) < 150  # of the walk upstream and all around; not of the distances of the 40


@pytest.mark.parametrize(("depth", "cap", "with_files", "sent"), [(1, 6, False, 1 << 18), (2, 9, False, 0), (3, 1000, False, 1 << 18), (2, 1000, True, 1 << 18), (1, 7, True, 0)])
def test_neighborhood_as_walked_by_hand(spark, monkeypatch, depth, cap, with_files, sent):
    monkeypatch.setattr(traverse, "SENT", sent)
    draw = random.Random(depth * 100 + cap)
    pairs = {(f"n{draw.randrange(30)}", f"n{draw.randrange(30)}") for _ in range(34)} | {("n3", "t"), ("t", "n4"), ("n4", "t")}
    files = [(f"n{i}", f"f{i % 4}") for i in range(30)] + [("t", "f1")]
    pairs |= {("f1", "n4"), ("f2", "n9")}

    def walk(edges, seen, steps):
        """Nodes by distance from t, not through those seen."""
        out, front = {}, {"t"}
        for d in range(1, steps + 1):
            front = {b for a, b in edges if a in front} - seen - set(out)
            out |= dict.fromkeys(front, d)
        return out

    up = {"t"} | set(walk({(b, a) for a, b in pairs}, {"t"}, depth))
    some = up | set(walk(pairs, up, depth))
    some |= {f for n, f in files if n in some} if with_files else set()
    near = {"t": 0} | walk({x for a, b in pairs if {a, b} <= some for x in ((a, b), (b, a))}, {"t"}, 2 * depth + 2)
    want = sorted((near.get(n, 999), n) for n in some)[:cap]
    edges = spark.createDataFrame(sorted(pairs), "src string, dst string")
    got = traverse.neighborhood(edges, "t", depth, cap, spark.createDataFrame(files, "node string, file string") if with_files else None).collect()
    assert [(r.dist, r.node) for r in got] == want
