"""Sources and sinks that the registered queries do not reach, and odd cases of what they read."""

import hashlib
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from graphloom import functions as fx
from graphloom import sources, spec
from graphloom.functions import python_source, script_source
from graphloom.operators import graph
from graphloom.plans import fixture, scan
from graphloom.sources import git, reports, tree


@pytest.fixture(scope="module")
def known(spark):
    sources.register(spark)
    return spark


def test_tree_cap_counts_supported_files_only(known, tmp_path):
    for name in ("a.txt", "b.py", "c.md", "d.js", "e.py"):
        (tmp_path / name).write_bytes(b"x = '\xff'\r\n")
    rows = known.read.format("source_tree").options(maxfiles="2").load(str(tmp_path)).orderBy("file_ord").collect()
    assert [(r.rel, r.lines, r.source) for r in rows] == [("b.py", 2, "x = '�'\n"), ("d.js", 2, "x = '�'\n")]
    assert known.read.format("source_tree").load(str(tmp_path / "none_such")).count() == 0 if (tmp_path / "none_such").mkdir() is None else False


def test_folders_above_the_root(known, tmp_path):
    inside = tmp_path / "venv" / "app"
    inside.mkdir(parents=True)
    (inside / "m.py").write_text("x = 1\n")
    load = lambda **o: known.read.format("source_tree").options(**o).load(str(inside)).count()
    assert (load(), load(absolute="true")) == (1, 0)


def test_fingerprint_follows_names_and_times(known, tmp_path):
    (tmp_path / "m.py").write_text("x = 1\n")
    (tmp_path / "note.txt").write_text("no code\n")
    os.utime(tmp_path / "m.py", ns=(5, 5))
    first = tree.fingerprint(known, str(tmp_path))
    assert first == hashlib.sha256(b"m.py:5").hexdigest()
    (tmp_path / "note.txt").write_text("other\n")
    assert tree.fingerprint(known, str(tmp_path)) == first
    os.utime(tmp_path / "m.py", ns=(6, 6))
    assert tree.fingerprint(known, str(tmp_path)) != first


def test_git_first_commit_detached_head_and_no_repository(known, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@example.org", *a], check=True, capture_output=True)
    with pytest.raises(RuntimeError):
        git.parent_of(str(tmp_path))
    run("init", "-q", "-b", "main")
    (tmp_path / "ä b.py").write_text("x = 1\n")
    run("add", "-A")
    run("commit", "-q", "-m", "one")
    assert git.parent_of(str(tmp_path)) == spec.EMPTY_TREE
    first = git.read_diff(known, str(tmp_path)).collect()
    assert {r.file for r in first} == {"ä b.py"} and [r.raw for r in first][-1] == "+x = 1"
    (tmp_path / "ä b.py").write_text("x = 2\n")
    run("commit", "-q", "-a", "-m", "two")
    assert git.parent_of(str(tmp_path)) == "HEAD~1"
    run("checkout", "-q", "--detach")
    assert git.parent_of(str(tmp_path)) == spec.EMPTY_TREE
    commits = known.read.format("git_commits").load(str(tmp_path)).orderBy("ord").collect()
    assert [(c.n_parents, c.message) for c in commits] == [(1, "two\n"), (0, "one\n")]
    assert known.read.format("git_snapshot").load(str(tmp_path)).first().source == "x = 2\n"


def test_sinks(known, tmp_path):
    rows = known.createDataFrame([("a", 1.5), ("b", None)], "name string, v double")
    reports.write_csv(rows, f"file://{tmp_path}/csv")
    reports.write_json(rows, f"file://{tmp_path}/json")
    assert known.read.option("header", "true").csv(f"file://{tmp_path}/csv").count() == 2
    assert {r.name: r.v for r in known.read.json(f"file://{tmp_path}/json").collect()} == {"a": 1.5, "b": None}
    page = graph.to_html(*graph.of_files(fixture.frame(known, {"a.py": "def f():\n    g()\n\n\ndef g():\n    pass\n"})), "func:a.py::f")
    assert page.count("func:a.py::g") >= 2 and "</script>" in page


def test_bad_reports_give_no_rows(known):
    d = known.createDataFrame([("r", "not json"), ("s", "{}"), ("t", None)], "run string, text string")
    assert reports.sarif(d).count() == reports.semgrep(d).count() == reports.bandit(d).count() == reports.truth(d).count() == 0


def test_language_suffix_and_lines(spark):
    paths = ["a.py", "A.PY", "b.jsx", "c.tsx", "x/.py", "noext", "d.pyc", "e.ts"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", fx.language("p").alias("l")).collect()
    assert {r.p: r.l for r in rows} == {"a.py": "python", "A.PY": "python", "b.jsx": "javascript", "c.tsx": "tsx", "x/.py": None, "noext": None, "d.pyc": None, "e.ts": "typescript"}
    texts = ["", "a", "a\n", "a\r\nb\n\n", "\n", "x\x0cy z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fx.split_lines("t").alias("l")).collect()
    assert all(r.l == r.t.splitlines() for r in rows)
    odd = ["　 a b  ", "\x1c\x85x\n", "​z​"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select("t", fx.strip("t").alias("s")).collect()
    assert all(r.s == r.t.strip() for r in rows)


def test_python_facts_of_odd_texts():
    for text in ("", "\n", "def (", "\x00", "x = 'é" * 3, "# only\n", "a" * 10, "(" * 400):
        assert set(python_source.facts(text)) == {"imports", "functions", "classes", "calls"}
    deep = "f(" * 60 + ")" * 60
    assert len(python_source.facts(deep)["calls"]) == 60
    got = python_source.facts("é = f(ü(1))\nif (check()): pass\n(run())\na(), b()\n")["calls"]
    assert [(c["name"], c["bare"]) for c in got] == [("f", False), ("ü", False), ("check", False), ("run", False), ("a", True), ("b", True)]


def test_script_facts_of_odd_texts():
    for text in ("", "`", "'", "${", "((((", "}}}", "/* open", "function", "class", "import", "const x =", "a?.b?.(c)", "<T>(x)", "`${`${a(`b`)}`}`"):
        assert set(script_source.facts(text)) == {"imports", "functions", "classes", "calls"}
    names = lambda t: [c["name"] for c in script_source.facts(t)["calls"]]
    assert names("if (a) b(); while(c) { d(e) } return (f)(g); new X(y); new X(y).z(); `${q(1)}`; x = /r(\\/)/;") == ["b", "d", "(f)", "new X(y).z", "q"]
    assert names("function f(a) { return g(a) }\nclass A { m(x) { this.m(x) } get v() { return w() } }") == ["g", "this.m", "w"]


def test_failing_model_is_no_empty_answer(spark):
    def broken(system, message):
        raise RuntimeError("no answer")

    files = fixture.frame(spark, {"a.py": "x = 1\n"})
    with pytest.raises(Exception, match="no answer"):
        scan.chunked(files, [], broken, "off").collect()
    with pytest.raises(ValueError):
        scan.chunked(files, [], None, "sometimes")
    assert scan.chunked(files, [], None, "off").filter(F.col("place.part") == 1).count() == 1
