"""Statistics, running sums and authorship signals against plain Python."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from graphloom import spec
from graphloom.operators import authorship, diffs, stats
from graphloom.plans.lineage import running


def test_running_sums(spark):
    r = random.Random(3)
    rows = [(r.randint(0, 40), i, r.randint(-5, 5)) for i in range(500)]
    got = running(spark.createDataFrame(rows, "a int, b int, v int").repartition(7), ["a", "b"], F.col("v"), "before").collect()
    at, want = 0, {}
    for a, b, v in sorted(rows):
        want[a, b], at = at, at + v
    assert {(x.a, x.b): x.before for x in got} == want
    assert running(spark.createDataFrame([], "a int, v int"), ["a"], F.col("v"), "before").count() == 0


def test_bootstrap_repeats_the_seeded_draws(spark):
    rows = [("x", i, v) for i, v in enumerate([0.5, 0.75, 1.0, 0.25])] + [("y", 0, 2.0)]
    out = {r.arm: r for r in stats.bootstrap(spark.createDataFrame(rows, "arm string, i int, v double"), "arm", "v", "i", 500).collect()}
    for arm in ("x", "y"):
        values, rng = [v for a, _, v in rows if a == arm], random.Random(12345)
        means = sorted(sum(values[rng.randrange(len(values))] for _ in values) / len(values) for _ in range(500))
        assert (out[arm].low, out[arm].high) == (means[12], means[487])
    a, b, rng = [1.0, 0.5], [0.25, 0.75, 0.5], random.Random(999)
    mean = lambda x: sum(x) / len(x)
    d = sorted(mean([a[rng.randrange(2)] for _ in a]) - mean([b[rng.randrange(3)] for _ in b]) for _ in range(400))
    assert stats.bootstrap_difference(a, b, 400) == (mean(a) - mean(b), d[10], d[390])


def test_exact_tests(spark):
    tables = [(0, 0, 0, 0), (3, 1, 2, 4), (10, 0, 0, 10), (40, 2, 30, 9), (500, 20, 400, 60)]
    out = stats.fisher_table(spark.createDataFrame(tables, "a int, b int, c int, d int")).collect()
    for r in out:
        one, two, row, n = r.a + r.c, r.b + r.d, r.a + r.b, r.a + r.b + r.c + r.d
        p = lambda x: math.comb(one, x) * math.comb(two, row - x) / math.comb(n, row)  # noqa: B023, E731
        want = min(1.0, sum(p(x) for x in range(max(0, row - two), min(row, one) + 1) if p(x) <= p(r.a) + 1e-12)) if n else 1.0
        assert math.isclose(r.p, want, rel_tol=1e-6, abs_tol=1e-10)
    pairs = [(0, 0), (1, 0), (5, 9), (600, 900), (1000, 1000)]
    for r in spark.createDataFrame(pairs, "b int, c int").select("b", "c", stats.mcnemar(F.col("b"), F.col("c")).alias("p")).collect():
        n = r.b + r.c
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(r.b, r.c) + 1)) / 2**n) if n else 1.0
        assert math.isclose(r.p, want, rel_tol=1e-8)


def plain_boilerplate(code):
    rows, doc, other, blank, inside = code.strip().split("\n"), 0, 0, 0, False
    if len(rows) < 5:
        return 0.0
    for x in map(str.strip, rows):
        quotes = '"""' in x or "'''" in x
        if quotes or inside:
            doc += 1
            inside ^= quotes
        elif x.startswith(("#", "//")) or x in spec.BOILERPLATE_LINES:
            other += 1
        else:
            blank += not x
    share = (doc + other) / max(len(rows) - blank, 1)
    return next((s for least, s in ((0.4, 0.9), (0.3, 0.6), (0.2, 0.3)) if share > least), 0.0)


def plain_style(code):
    rows = [x for x in code.split("\n") if x.strip()]
    if len(rows) < 10:
        return 0.0
    spread = lambda v: statistics.stdev(v) if len(v) > 1 else 0
    deep = [n for n in (len(x) - len(x.lstrip()) for x in rows) if n]
    return (0.4 if spread(deep) < 2 and all(n % 4 == 0 for n in deep) else 0) + (0.3 if spread([len(x) for x in rows]) < 15 else 0)


@pytest.fixture(scope="module")
def codes():
    r = random.Random(9)
    pieces = ["def f(a):", "    return a", "", "   ", "# note", "// note", '"""', "'''", '  """doc"""', "try:", "  finally:", "raise", "raise X", "pass ", "    x = [i]", "\tif x is None:", "é = open(p)", "　wide", "a\x0b"]
    return ["", "\n\n", *("\n".join(r.choice(pieces) for _ in range(r.randint(1, 40))) for _ in range(80))]


def test_signals_of_odd_code(spark, codes):
    rows = spark.createDataFrame(list(enumerate(codes)), "i int, code string")
    out = rows.select("i", authorship.boilerplate_density(F.col("code")).alias("b"), authorship.uniform_style(F.col("code")).alias("s")).collect()
    for r in out:
        assert r.b == plain_boilerplate(codes[r.i]), codes[r.i]
        assert math.isclose(r.s, plain_style(codes[r.i]), abs_tol=1e-9), codes[r.i]


def test_verdict_on_files_of_a_change(spark):
    plain = "+    if user is None:\n+        return None\n+    name = user.get('name')\n+    return name.strip()\n"
    bulk = "\n".join(["+# " + "-" * 20, *(f'+def handler_{i}(payload):\n+    """Handle {i}.\n+\n+    Args:\n+        payload: it.\n+    """\n+    data = payload["data"]\n+    return process(data)\n' for i in range(8))])
    rows = [("a", plain, ""), ("b", bulk, ""), ("c", plain, "Add name\n\nCo-Authored-By: Cursor"), ("d", "", None)]
    out = {r.f: r for r in authorship.analyze(spark.createDataFrame(rows, "f string, diff string, message string"), "diff", "message").collect()}
    assert not out["a"].likely_ai and out["b"].confidence > out["a"].confidence
    assert out["c"].likely_ai and out["c"].confidence < 0.5 and not out["d"].likely_ai
    assert {len(out[k].signals) for k in "abd"} == {6} and len(out["c"].signals) == 7
    assert out["a"].summary.startswith(f"{int(out['a'].confidence * 100)}% AI-generated confidence (")


def test_boundary_search_stops_where_it_should(spark):
    made = {
        "file ends": '-"""\ndiff --git a/x b/x\n run(a)',
        "index ends": '-"""\nindex 1..2\n run(a)',
        "removed lines do not count": '-"""\n-run(a)\n """',
        "blank diff lines do not count": '-/*\n\n call(a)\n */',
        "closer in mid-line goes on": '-"""\n x = """a"""\n run(a)\n """',
        "no prefix is no code": '-"""\nrun(a)\n """',
        "sink wins over earlier code": "-'''\n x = 1\n os.popen(c)\n '''",
        "end of text": "-=begin\n eval(x)",
    }
    rows = spark.createDataFrame(list(made.items()), "diff_id string, diff string")
    got = {r.diff_id: r.trigger for r in diffs.boundary_deletions(diffs.diff_lines(rows)).collect()}
    code, sink = "revealed code contains executable definitions/statements", "revealed code calls sink `{}(...)`".format
    assert got == {"blank diff lines do not count": sink("call"), "closer in mid-line goes on": sink("run"), "sink wins over earlier code": sink("popen"), "end of text": sink("eval")}
    assert code not in got.values()
