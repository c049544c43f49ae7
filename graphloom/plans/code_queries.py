"""Registered queries on source code, diffs, reports and runs, over the made project of ``fixture``.

The supplied tables hold no code, so these queries read texts written for them; what they must give is stated row by row
in ``expected``, checked against the specification.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources, streaming
from ..functions import extract
from ..operators import authorship, cost, detect, diffs, evaluate, graph, rank, snapshots, traverse, windows
from ..sources import git, reports, tree
from . import expected, fixture, scan
from .lineage import cut, shared_folder

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf: f(spark)
    return f


def after(s: SparkSession) -> DataFrame:
    return fixture.frame(s, fixture.AFTER)


def parsed(s: SparkSession) -> DataFrame:
    return cut(extract.parsed(after(s)))


def the_graph(s: SparkSession, files: dict[str, str] = fixture.AFTER) -> tuple[DataFrame, DataFrame]:
    n, e = graph.of_files(fixture.frame(s, files))
    return cut(n), cut(e)


def joined(c: str):
    return F.array_join(c, ",").alias(c)


# ---- sources


@query
def q_source_tree(s):
    sources.register(s)
    return s.read.format("source_tree").load(fixture.on_disk(s, fixture.AFTER | fixture.OTHER)).select("rel", "language", "lines", "file_ord")


@query
def q_source_tree_python(s):
    """The detectors' way of reading: Python files by exact suffix, no folder skipped, capped."""
    sources.register(s)
    return s.read.format("source_tree").options(suffixes=".py", skip="false", maxfiles="4").load(fixture.on_disk(s, fixture.AFTER | fixture.OTHER)).select("rel", "file_ord", F.md5("source").alias("hash"))


@query
def q_only_files(s):
    return tree.only_files(after(s), s.createDataFrame([("routes.py",), ("app/store.py",), ("web",)], "n string")).select("rel")


@query
def q_git_snapshot(s):
    sources.register(s)
    return s.read.format("git_snapshot").options(commit="HEAD~1").load(fixture.repository(s)).select("rel", "lines", F.md5("source").alias("hash"))


@query
def q_git_diff(s):
    sources.register(s)
    return git.read_diff(s, fixture.repository(s)).filter("raw not like 'index %'").select("file", "raw", F.shiftright("pos", 32).alias("part"))


@query
def q_git_changed(s):
    sources.register(s)
    return git.changed_files(git.read_diff(s, fixture.repository(s)))


@query
def q_git_worktree(s):
    """Staged, unstaged and new files."""
    sources.register(s)
    root = fixture.repository(s)
    for rel, text in (("app/store.py", fixture.STORE + "x = 1\n"), ("app/gates.py", fixture.GATES + "y = 2\n"), ("app/new.py", "z = 3\n")):
        with open(f"{root}/{rel}", "w", encoding="utf-8") as f:
            f.write(text)
    git.git(root, "add", "app/store.py")
    return git.read_diff(s, root, changes="all").groupBy("diff_id", "file").agg(F.count_if(F.col("raw").startswith("+") & ~F.col("raw").startswith("+++")).alias("added"), F.count_if(F.col("raw") == "--- /dev/null").alias("made"))


@query
def q_commit_scores(s):
    sources.register(s)
    scored = authorship.commit_scores(git.commit_diffs(s, fixture.repository(s)))
    return scored.select("file", "lines_added", "lines_removed", F.round("confidence", 6).alias("confidence"), "likely_ai", "summary")


@query
def q_snapshot_pair(s):
    pairs = tree.snapshot_pair(fixture.frame(s, {k: v for k, v in fixture.BEFORE.items() if k != "app/store.py"}), after(s))
    diff = tree.unified(pairs.filter("old != new"))
    return diff.select("rel", F.size(F.filter(F.split("diff", "\n"), lambda l: l.rlike("^[+][^+]"))).alias("added"), F.size(F.filter(F.split("diff", "\n"), lambda l: l.rlike("^-[^-]"))).alias("removed"))


TRUTH = {
    "vulnerabilities": [
        {"id": "sql-find", "file": "app/routes.py", "category": "SQLi", "line_start": 6, "line_end": 7, "description": "string query"},
        {"id": "auth-update", "file": "app/Routes.py", "category": "Auth Bypass", "line_start": 11, "line_end": 11, "accepted_categories": ["Auth Bypass", "SQLi"]},
        {"id": "md5", "file": "store.py", "category": "Weak Crypto", "line_start": 16, "line_end": 16},
        {"id": "pickle", "file": "store.py", "category": "Insecure Deserialization", "line_start": 40, "line_end": 44},
        {"id": "maybe", "file": "app/gates.py", "category": "Auth", "line_start": 20, "line_end": 22, "provisional": True, "provisional_reason": "unsure"},
    ]
}
REPORT = """Some words first.

## [SEVERITY: critical] Query from a string
**Category:** SQL Injection
**Location:** `app/routes.py:8`
**Location:** `app/routes.py:8`
See also lib/x.ts:12 and app/routes.py:8.
---
## [severity: High]  Ignored check
**Category:** Broken access control
**Location:** Routes.py:14
---
## [SEVERITY: HIGH] Same check again
**Category:** auth
**Location:** `other/ROUTES.py:12`
---
## [SEVERITY: LOW] Hash
**category:** secrets exposure (md5)
**Location:** `a path/with blanks/store.py:18`
---
## [SEVERITY: MEDIUM] Objects
**Category:** Injection
**Location:** `store.py:46`
---
## [SEVERITY: MEDIUM] Perhaps
**Category:** authz
**Location:** `gates.py:25`
---
## [SEVERITY: LOW] Wrong kind
**Category:** XSS
**Location:** `store.py:40`
---
## [SEVERITY: LOW] Nowhere
**Category:** race condition
---
"""
SECOND = "## [SEVERITY: HIGH] Two\n**Category:** SQLi / Auth Bypass\n**Location:** `routes.py:11`\n---\n## [SEVERITY: HIGH] Far\n**Category:** SQLi\n**Location:** `routes.py:17`\n---\n"


def truth(s: SparkSession) -> DataFrame:
    return cut(reports.truth(s.createDataFrame([(json.dumps(TRUTH),)], "text string")))


def texts(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("one", REPORT), ("two", SECOND), ("none", "No findings.")], "run string, text string")


def found(s: SparkSession) -> DataFrame:
    return cut(evaluate.parse_findings(texts(s)))


@query
def q_truth(s):
    return truth(s).select("ord", "id", "file", "category", "line_start", "line_end", joined("accepted"), "provisional")


@query
def q_ledger(s):
    """Appended twice and read back."""
    path = shared_folder(s, "ledger")
    rows = s.createDataFrame([("t1", "graph", 0, 0.5, {"haiku_in": 10}, 0.25), ("t2", "plain", 1, 0.75, {"haiku_in": 30}, 1.5)], "ts string, arm string, run_index int, recall double, usage struct<haiku_in:bigint>, cost_usd double")
    for part in ("ts = 't1'", "ts = 't2'"):
        reports.append_ledger(rows.filter(part), path)
    return reports.read_ledger(s, path).select("ts", "arm", "run_index", "recall", F.col("usage.haiku_in").alias("haiku_in"), "cost_usd", "tp")


RULES = [{"id": "py/sql", "name": "SqlInjection", "shortDescription": {"text": "SQL injection"}, "properties": {"tags": ["security", "external/cwe/cwe-089"]}}]
SARIF = {
    "runs": [
        {
            "tool": {"driver": {"name": "scanner", "semanticVersion": "2.1", "rules": RULES}, "extensions": [{"name": "pack", "version": "0.9", "rules": [{"id": "py/sql", "name": "Later"}, {"id": "py/hash", "fullDescription": {"text": "weak hash"}}]}]},
            "results": [
                {"ruleId": "py/sql", "message": {"text": "query"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a%20b.py"}, "region": {"startLine": 3}}}, {"physicalLocation": {"artifactLocation": {"uri": "a%20b.py"}, "region": {"startLine": 3}}}, {"physicalLocation": {"artifactLocation": {"uri": "c+d.py"}}}]},
                {"rule": {"id": "py/hash"}, "message": {"text": "md5"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "e.py"}, "region": {"startLine": 9}}}]},
                {"ruleId": "unknown", "message": {"text": "x"}, "locations": []},
                {"ruleId": "", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "f.py"}}}]},
            ],
        }
    ]
}
SEMGREP = {"results": [{"check_id": "python.lang.sqli", "path": "a.py", "start": {"line": 4}, "extra": {"message": "bad query", "metadata": {"cwe": ["CWE-89", "CWE-90"]}}}, {"check_id": "md5", "path": "b.py", "start": {"line": 2}, "extra": {"message": "weak", "metadata": {"cwe": "CWE-327"}}}, {"check_id": "bare"}]}
BANDIT = "Working... 100%\n" + json.dumps({"results": [{"test_id": "B608", "test_name": "hardcoded_sql", "issue_text": "SQL injection", "filename": "a.py", "line_number": 4}]})


def places(c: str):
    return F.array_join(F.transform(c, lambda p: F.concat(p["file"], F.lit(":"), p["line"])), ",").alias(c)


def docs(s: SparkSession, text: str) -> DataFrame:
    return s.createDataFrame([("r", text)], "run string, text string")


@query
def q_sarif(s):
    return reports.sarif(docs(s, json.dumps(SARIF))).select("ord", "title", "category", "rule_id", joined("cwes"), places("locations"))


@query
def q_tool_versions(s):
    return reports.versions(docs(s, json.dumps(SARIF))).select("name", "version")


@query
def q_semgrep(s):
    return reports.semgrep(docs(s, json.dumps(SEMGREP))).select("ord", "title", "category", places("locations"))


@query
def q_bandit(s):
    return reports.bandit(docs(s, BANDIT)).select("ord", "title", "category", places("locations"))


@query
def q_run_records(s):
    kept = {"arm": "plain", "runs": [{"arm": "graph", "metrics": {"recall": 0.5}, "counts": {"tp": 2, "total_findings": 5}, "usage": {"haiku_in": 7, "sonnet_out": 3}, "target_loc": 120, "scan_time_seconds": 4.5}, {"metrics": {"recall": 1.0}, "counts": {"tp": 4, "total_findings": 4}, "target_loc": 120, "scan_time_seconds": 6.0, "cost_usd": 0.2}]}
    d = s.createDataFrame([("a.json", json.dumps(kept))], "path string, text string")
    return reports.run_records(d)


@query
def q_recall_values(s):
    made = [("a.json", {"arm": "graph", "aggregate": {"recall": {"raw_values": [0.5, 0.75]}}}), ("b.json", {"arm": "plain", "aggregate": {"recall": {"raw_values": [0.25]}}}), ("c.json", {"arm": "graph", "aggregate": {"recall": {"raw_values": [1.0]}}})]
    r = reports.recall_values(s.createDataFrame([(p, json.dumps(d)) for p, d in made], "path string, text string"))
    return r.groupBy("arm").agg(F.count("*").alias("n"), F.avg("recall").alias("mean"))


@query
def q_markdown(s):
    rows = s.createDataFrame([("b", 2, None), ("a", 1, 0.5)], "name string, n int, share double")
    return reports.markdown(rows, ["name"])


@query
def q_split_answer(s):
    text = "intro\n=== FILE: /app.py ===\n```python\nx = 1\n```\n=== FILE: db.py  ===\n\n\ny = 2\n=== FILE: app.py ===\nz = 3\n"
    return tree.split_answer(s.createDataFrame([(1, text)], "id int, text string"))


@query
def q_cache_merge(s):
    old = s.createDataFrame([("a", "h1", 1.0), ("b", "h2", 2.0)], "path string, hash string, v double")
    return rank.merge_cache(old, s.createDataFrame([("b", "h3", 3.0), ("c", "h4", 4.0)], old.schema))


@query
def q_contents(s):
    nodes, _ = the_graph(s)
    return tree.contents(nodes, after(s).filter("rel != 'app/broken.py'")).select("rel", F.md5("source").alias("hash"))


@query
def q_targets(s):
    return tree.targets(the_graph(s)[0], "S").select("kind", "label", "id")


@query
def q_source_count(s):
    return tree.source_count(after(s).withColumn("rel", F.when(F.col("rel") == "app/broken.py", "x.txt").otherwise(F.col("rel"))))


@query
def q_count_loc(s):
    return evaluate.count_loc(after(s))


# ---- extraction


@query
def q_extract_imports(s):
    return extract.imports(parsed(s)).select("rel", "ord", "module", joined("names"), "line", "is_relative")


@query
def q_extract_functions(s):
    return extract.functions(parsed(s)).select("rel", "ord", "qualified_name", "line_start", "line_end", joined("params"))


@query
def q_extract_classes(s):
    return extract.classes(parsed(s)).select("rel", "ord", "name", "line_start", "line_end", joined("bases"))


@query
def q_extract_calls(s):
    return extract.all_calls(parsed(s)).select("rel", "ord", "name", "line", "bare", joined("mixed"), "inside", joined("inside_params"))


@query
def q_function_calls(s):
    return extract.function_calls(parsed(s)).select("rel", "owner", "name", "line")


@query
def q_top_level_calls(s):
    return extract.top_level_calls(parsed(s)).select("rel", "name", "line")


@query
def q_table_functions(s):
    """The same as SQL over a view."""
    extract.register(s)
    after(s).createOrReplaceTempView("graphloom_sources")
    return s.sql("SELECT f.rel, c.name, c.line FROM graphloom_sources f, LATERAL calls_of(f.source, f.language) c WHERE c.bare")


# ---- graph


@query
def q_graph_nodes(s):
    return the_graph(s)[0].select("id", "type", "name", "file", "line_start", "line_end")


@query
def q_graph_edges(s):
    return the_graph(s)[1].select("src", "dst", "type", "line")


@query
def q_graph_relative(s):
    n, e = graph.relative(*(d.select(*(F.replace(F.col(c), F.lit("app/"), F.lit("/tmp/snap/app/")).alias(c) if c in ("id", "src", "dst", "file") else F.col(c) for c in d.columns)) for d in the_graph(s)), "/tmp/snap/")
    return e.filter("type = 'imports'").select("src", "dst")


@query
def q_graph_json(s):
    return graph.json_rows(*the_graph(s)).select("kind", "json")


@query
def q_graph_summary(s):
    out = graph.summary(*the_graph(s), functions=5)
    return out.select("files", "functions", "classes", joined("function_names"), joined("class_names"), F.to_json("edge_types").alias("edge_types"))


@query
def q_find_nodes(s):
    n, _ = the_graph(s)
    asked = [("exact", traverse.find_node(n, "file:app/store.py")), ("suffix", traverse.find_node(n, "store.py")), ("name", traverse.find_node(n, "open")), ("qualified", traverse.find_node(n, "Session.close")), ("file", traverse.find_file(n, "gates.py")), ("function", traverse.find_function(n, "run_query")), ("nothing", traverse.find_node(n, "absent"))]
    out = None
    for what, d in asked:
        one = d.select(F.lit(what).alias("asked"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query
def q_blast_report(s):
    _, e = the_graph(s)
    r = cut(traverse.blast_radius(e, "func:app/store.py::connect"))
    return traverse.blast_summary(r, tree=3)


@query
def q_blast_paths(s):
    _, e = the_graph(s)
    return traverse.blast_radius(e.filter("type = 'calls'"), "func:app/store.py::connect").select("node", "depth", F.array_join("path", " ").alias("path"), "direct_caller")


@query
def q_file_neighborhood(s):
    n, e = the_graph(s)
    files = n.select(F.col("id").alias("node"), F.concat(F.lit("file:"), "file").alias("file"))
    return traverse.neighborhood(e, "func:app/routes.py::update", 1, 50, files).select("node")


@query
def q_called_elsewhere(s):
    n, e = the_graph(s)
    return traverse.called_elsewhere(e, n, "app/routes.py").select(joined("names"))


@query
def q_neighbour_bodies(s):
    n, e = the_graph(s)
    return traverse.neighbour_bodies(e, n, after(s), "app/routes.py", budget=7)


@query
def q_edge_chain(s):
    n, e = the_graph(s)
    return traverse.edge_chain(e, n, ["update", "run_query", "connect"])


@query
def q_keep_relevant(s):
    return traverse.keep_relevant(the_graph(s)[0], ["store.py", "web/"]).select("id")


@query
def q_prune(s):
    top = s.createDataFrame([("store.py",), ("web/typed",)], "path string")
    return rank.prune(the_graph(s)[0], top).select("id")


@query
def q_combined(s):
    n, e = the_graph(s)
    extra = n.filter("name = 'fingerprint'").select(F.col("id").alias("node"))
    return traverse.combined(e, ["file:app/store.py"], extra, 1, 30)


# ---- changes


def both(s):
    (n0, e0), (n1, e1) = the_graph(s, fixture.BEFORE), the_graph(s)
    return n0, e0, n1, e1


@query
def q_code_deletions(s):
    n0, e0, n1, _ = both(s)
    return snapshots.deletion_text(snapshots.security_deletions(n0, e0, n1)).select("id", "name", joined("matched"), joined("called_by"), "in_degree", "text")


@query
def q_code_broken(s):
    n0, e0, n1, _ = both(s)
    return snapshots.broken_text(snapshots.broken_edges(e0, n1)).select("caller", "missing_callee", "edge_type", joined("callers_of_caller"), "text")


def opened(s: SparkSession) -> DataFrame:
    return diffs.diff_lines(s.createDataFrame([("d", fixture.OPENED)], "diff_id string, diff string"))


@query
def q_boundary_deletions(s):
    return diffs.boundary_text(diffs.boundary_deletions(opened(s))).select("pos", "file", "opener", "raw", "severity", "trigger", "text")


@query
def q_diff_files(s):
    return diffs.current_file(opened(s)).groupBy("file").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


@query
def q_diff_blocks(s):
    made = [("d", "words\ndiff --git a/x b/x\n+1\ndiff --git a/y b/y\n+2\ndiff --git a/x b/x\n+3"), ("e", "+no header\n+at all")]
    return diffs.split_by_file(diffs.diff_lines(s.createDataFrame(made, "diff_id string, diff string")))


# ---- detectors


def facts(s):
    p = parsed(s)
    return extract.all_calls(p), extract.functions(p)


@query
def q_sql_sinks(s):
    return detect.sql_sinks(*facts(s))


@query
def q_static_rules(s):
    return detect.static_rules(*facts(s)).select("part", "rel", "line", "caller", "severity", "category", "subject", joined("tainted"), "description")


@query
def q_ignored_returns(s):
    return detect.ignored_returns(*facts(s)).select("rel", "line", "caller", "severity", "category", "callee", "callee_file", "cross_file")


@query
def q_detector_report(s):
    c, f = facts(s)
    return detect.report(detect.ignored_returns(c, f), detect.static_rules(c, f)).select("place.part", "place.file_ord", "place.ord", F.md5("text").alias("hash"))


# ---- evaluation


@query
def q_report_findings(s):
    return found(s).select("run", "ord", "severity", "title", "category", places("locations"), F.length("raw").alias("n_raw"))


@query
def q_report_dedupe(s):
    return evaluate.dedupe(found(s)).select("run", "title")


@query
def q_report_matches(s):
    t = truth(s)
    matched, mismatched = evaluate.match(found(s), t)
    ids = t.select(F.col("ord").alias("t"), "id")
    return matched.select("run", "f", "t", "dist", F.lit(True).alias("agree")).unionByName(mismatched.select("run", "f", "t", F.lit(None).cast("long").alias("dist"), F.lit(False).alias("agree"))).join(ids, "t").select("run", "f", "id", "dist", "agree")


@query
def q_report_outcome(s):
    t, f = truth(s), found(s)
    out = evaluate.scores(evaluate.outcome(texts(s), f, t, evaluate.match(f, t)[0]))
    return out.select("run", "tp", "fp", "fn", "n_provisional", joined("caught"), joined("missed"), *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query
def q_tool_scores(s):
    return evaluate.tool_scores(texts(s), found(s), truth(s))


@query
def q_self_test(s):
    t = truth(s).filter("not provisional")
    perfect = cut(evaluate.perfect_findings(t))
    return evaluate.scores(evaluate.outcome(perfect, perfect, t, evaluate.match(perfect, t)[0])).select("run", "tp", "fp", "fn", "precision", "recall", "f1")


@query
def q_pooled_runs(s):
    order = s.createDataFrame([("two", 1), ("one", 2), ("none", 3)], "run string, k int")
    return evaluate.pooled(found(s), order, truth(s)).select("k", "n_findings", "tp", "fp", joined("caught"))


@query
def q_normalized_runs(s):
    runs = s.createDataFrame([("a", 5000, 30.0, 400, 3), ("b", 800, 12.0, 400, 0)], "run string, tokens long, seconds double, loc long, tp int")
    return evaluate.normalized(runs).select("run", "tokens_per_kloc", "seconds_per_kloc", "seconds_per_vuln")


@query
def q_arm_difference(s):
    runs = s.createDataFrame([("graph", 0.5, 1.0), ("graph", 1.0, 0.5), ("plain", 0.5, 0.25), ("other", 0.0, 0.0)], "arm string, recall double, precision double")
    return evaluate.arm_difference(runs, ["recall", "precision"], "graph", "plain")


@query
def q_deletion_recall(s):
    planted = s.createDataFrame([("comment", "app/routes.py", '"""'), ("comment", "app/none.py", "/*"), ("control", "", "verify_text")], "kind string, file string, key string")
    n0, e0, n1, _ = both(s)
    hits = diffs.boundary_deletions(opened(s)).select(F.lit("comment").alias("kind"), "file", F.col("opener").alias("key")).unionByName(snapshots.security_deletions(n0, e0, n1).select(F.lit("control").alias("kind"), F.lit("").alias("file"), F.col("name").alias("key")))
    return evaluate.recall_by_type(planted, hits)


@query
def q_specificity(s):
    ignored, static = scan.rules(fixture.frame(s, {"ok.py": "def f(a):\n    return a\n"}))
    return evaluate.specificity(static.select("rel").unionByName(ignored.select("rel")), evaluate.count_loc(after(s)))


@query
def q_heldout_gate(s):
    ignored, static = scan.rules(after(s))
    hits = static.select("category").unionByName(ignored.select("category"))
    return evaluate.heldout_gate(hits.limit(0), hits, ["SQLi", "Weak Crypto", "Auth Bypass"]).select("n_safe", joined("categories"), joined("lacking"), "passed")


@query
def q_file_scores(s):
    return authorship.file_scores(after(s)).select("rel", "lines_added", F.round("confidence", 6).alias("confidence"), "likely_ai", "summary")


@query
def q_human_study(s):
    runs = s.createDataFrame([("p", "c1", "a.py", 30, True, 0.6), ("p", "c2", "b.py", 25, False, 0.7), ("p", "c2", "b.js", 25, True, 0.9), ("p", "c3", "c.py", 40, True, 0.9), ("p", "c1", "d.py", 5, True, 0.9), ("q", "c9", "e.py", 20, False, 0.1)], "project string, sha string, file string, lines_added int, likely_ai boolean, code_confidence double")
    commits = s.createDataFrame([("p", "c1", "2019-01-01"), ("p", "c2", "2020-06-01"), ("p", "c3", "2022-01-01"), ("q", "c9", "2020-01-01")], "project string, sha string, at string").withColumn("at", F.to_timestamp("at"))
    return authorship.human_study(runs, commits, "project", "2021-01-01", 2)


# ---- cost


@query
def q_stage_records(s):
    at = lambda rows: s.createDataFrame(rows, "run string, stage string, at string").withColumn("at", F.to_timestamp("at"))
    begins = at([("r", "graph", "2024-01-01 00:00:00"), ("r", "scan", "2024-01-01 00:00:02"), ("r", "scan", "2024-01-01 00:00:10"), ("r", "lost", "2024-01-01 00:00:20")])
    ends = at([("r", "graph", "2024-01-01 00:00:02"), ("r", "scan", "2024-01-01 00:00:08"), ("r", "scan", "2024-01-01 00:00:11")])
    return cost.stage_records(begins, ends, ["run"])


@query
def q_usage_totals(s):
    calls = s.createDataFrame([("r", "haiku", 10, 2), ("r", "sonnet", 100, 50), ("r", "haiku", 5, 1), ("t", "sonnet", 7, 7)], "run string, model string, tokens_in long, tokens_out long")
    return cost.usage_totals(calls, ["run"])


@query
def q_fresh_records(s):
    runs = s.createDataFrame([(0, 12.5, 10, 2, 100, 50, 7, 3, 0.4)], "run_index int, wall_clock_s double, haiku_in long, haiku_out long, sonnet_in long, sonnet_out long, findings long, confirmed_tp long, cost_usd double")
    return cost.fresh_records(runs, "made", evaluate.count_loc(after(s)))


# ---- questions to a model


@query
def q_triage(s):
    said = ['Sure: {"relevant_files": ["a.py"], "severity": "high", "reasoning": "x {y}"} ok', "no json here", "{broken", '{"reasoning": "only"}', "{not: json}"]
    t = s.createDataFrame(list(enumerate(said)), "id int, raw string").select("id", scan.triage(F.col("raw")).alias("t"))
    return t.select("id", F.array_join("t.relevant_files", ",").alias("files"), "t.severity", "t.reasoning")


def echo(system: str, message: str):
    """Stands for a model: says how much it was told."""
    yield f"{len(message)} "
    yield message.split("\n", 1)[0]


def scan_rows(s, mode):
    return scan.chunked(after(s), ["app/routes.py", "notes.txt"], echo, mode, window=12, overlap=2).select("place.part", "place.rel", "place.at", "text")


@query
def q_scan_off(s):
    return scan_rows(s, "off").filter("part = 1")


@query
def q_scan_note(s):
    return scan_rows(s, "note").select("part", "rel", "at", F.md5("text").alias("hash"))


@query
def q_scan_subgraph(s):
    return scan_rows(s, "subgraph").filter("part = 1")


@query
def q_scan_report(s):
    """A whole report as one text, read again as findings."""
    report = scan.as_run(scan.chunked(after(s), ["app/routes.py"], None, "off"))
    f = evaluate.parse_findings(report.withColumn("run", F.lit("r")))
    return f.groupBy("severity", "category").agg(F.count("*").alias("n"))


@query
def q_context_parts(s):
    files = s.createDataFrame([("long.py", "\n".join(f"l{i}" for i in range(6))), ("short.py", "x\ny")], "rel string, source string")
    return windows.context_parts("told", files, "more", 4).select("place.part", "place.rel", "text")


@query
def q_orient_parts(s):
    return windows.orient_parts(after(s), 3)


@query
def q_debug_parts(s):
    n, e = the_graph(s)
    return scan.debug_parts(n, e, after(s), "connect", ["store.py"]).select("place.part", "place.rel", F.md5("text").alias("hash"))


@query
def q_change_report(s):
    change = opened(s).withColumn("file", F.lit("app/routes.py"))
    return scan.change_report(change, fixture.frame(s, fixture.BEFORE), after(s)).select("place.part", "place.key", F.md5("text").alias("hash"))


@query
def q_experiment(s):
    """Two arms, twice each; one fails once and is run again, one fails for good."""
    tried: dict[str, int] = {}

    def arm(text: str, fails: int):
        def make(i: int) -> DataFrame:
            tried[text] = tried.get(text, 0) + 1
            if tried[text] <= fails:
                raise RuntimeError("no answer")
            return s.createDataFrame([(text,)], "text string")

        return make

    runs, failed = scan.experiment(s, {"graph": arm(REPORT, 1), "plain": arm(SECOND, 0), "dead": arm("", 99)}, 2)
    assert [(a, i) for a, i, _ in failed] == [("dead", 0), ("dead", 1)]
    return scan.scored(runs, truth(s)).select("arm", "run_index", "tp", "fp", "fn", joined("caught"))


@query
def q_spend_first(s):
    planned = s.createDataFrame([(1, 0.5), (2, 0.4), (3, 0.4)], "ord int, estimate double")
    return scan.spend_first(planned, 6.0, 7.5)


# ---- streams


def streamed(s: SparkSession, rows: DataFrame, make, mode: str) -> DataFrame:
    """All rows through a stream into a table, which is read back."""
    path = shared_folder(s, "stream")
    rows.write.parquet(f"{path}/in")
    q = make(s.readStream.schema(rows.schema).parquet(f"{path}/in")).writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).format("parquet").option("path", f"{path}/out").start()
    q.awaitTermination()
    return s.read.parquet(f"{path}/out")


@query
def q_stream_budget(s):
    runs = s.createDataFrame([("a", 1, 0.5), ("a", 2, 0.6), ("a", 3, 0.2), ("b", 1, 2.0)], "arm string, ord long, estimate double")
    return streamed(s, runs, lambda d: streaming.budget_gate(d, "arm", 1.2), "append")


@query
def q_stream_authorship(s):
    d = s.createDataFrame([("a.py", "\n".join(f"+def f{i}():\n+    pass" for i in range(30)))], "file string, diff string")
    return streamed(s, d, streaming.judged_diffs, "append").select("file", "lines_added", F.round("confidence", 6).alias("confidence"), "summary")


@query
def q_stream_spend(s):
    calls = s.createDataFrame([("2024-01-01 00:10:00", "haiku", 0.1), ("2024-01-01 00:50:00", "haiku", 0.2), ("2024-01-01 01:10:00", "sonnet", 1.0), ("2024-01-01 05:00:00", "haiku", 9.0)], "at string, model string, cost_usd double").withColumn("at", F.to_timestamp("at"))
    out = streamed(s, calls, streaming.spend_by_window, "append")
    return out.select(F.date_format("start", "HH:mm").alias("start"), "model", F.round("cost_usd", 6).alias("cost_usd"), "calls")


def oracle_sql() -> dict[str, str]:
    return {k: expected.sql(k) for k in QUERIES if k in expected.ROWS}
