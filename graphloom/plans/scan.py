"""The three questions asked of a repository, and the experiments on them.

Every function builds tables; what a model says comes from a function that the caller gives (windows.answered). Reports
are rows in order, so that a reader can stream them; nothing is gathered before a model is asked for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract
from ..operators import authorship, cost, detect, diffs, evaluate, graph, snapshots, traverse, windows
from ..sources import tree
from .lineage import cut

Model = Callable[[str, str], Iterator[str]]

TRIAGE = "You decide which files of a code base matter for a question. Answer with one JSON object: relevant_files, relevant_functions, severity, reasoning."
DEBUG = "You explain the cause of a failure in a code base from its dependency graph and sources, and propose a fix."
SCAN = "You review code for security flaws. Start each finding with ## [SEVERITY: LEVEL] Title, then lines **Category:**, **Location:** `file:line`, **Attack Scenario:** and **Fix:**, and end it with ---."
ORIENT = "You write a map of a repository for a newcomer from its graph, its tree and previews of its files."

ANSWER = "relevant_files array<string>, relevant_functions array<string>, severity string, reasoning string"


def triage(raw: Column) -> Column:
    """What a triage answer says: the JSON between its first and last brace; where there is none that can be read, no
    files, and the whole answer as reasoning."""
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    said = F.from_json(body, ANSWER, {"mode": "PERMISSIVE"})
    broken = (body == "") | F.try_parse_json(body).isNull()
    none = F.expr("cast(array() as array<string>)")
    fallback = F.struct(none.alias("relevant_files"), none.alias("relevant_functions"), F.lit(None).cast("string").alias("severity"), raw.alias("reasoning"))
    return F.when(broken, fallback).otherwise(F.struct(F.coalesce(said["relevant_files"], none).alias("relevant_files"), F.coalesce(said["relevant_functions"], none).alias("relevant_functions"), said["severity"].alias("severity"), F.coalesce(said["reasoning"], F.lit("")).alias("reasoning")))


def notes(mode: str, files: DataFrame, nodes: DataFrame, edges: DataFrame, changed: list[str]) -> DataFrame | None:
    """What each file's windows are told about other files: nothing (off), names (note) or bodies (subgraph)."""
    if mode not in ("off", "note", "subgraph"):
        raise ValueError(f"unknown graph mode {mode}")
    out = None
    for rel in changed if mode != "off" else []:
        if mode == "note":
            listed = traverse.called_elsewhere(edges, nodes, rel)
            text = F.when(F.size("names") > 0, F.concat(F.lit("\n## Cross-file calls from this file\n"), F.array_join("names", ", "), F.lit("\n"))).otherwise("")
        else:
            bodies = traverse.neighbour_bodies(edges, nodes, files, rel)
            block = F.format_string("### `%s` (depth %d)\n```\n%s\n```", F.element_at(F.split("node", "::"), -1), "depth", "body")
            listed = bodies.agg(F.array_sort(F.collect_list(F.struct("depth", "node", block.alias("t")))).alias("names"))
            text = F.when(F.size("names") > 0, F.concat(F.lit("\n## Cross-file callee/caller bodies (dependency subgraph)\n"), F.array_join(F.transform("names", lambda x: x["t"]), "\n"), F.lit("\n"))).otherwise("")
        one = listed.select(F.lit(rel).alias("rel"), text.alias("note"))
        out = one if out is None else out.unionByName(one)
    return out


def rules(files: DataFrame, changed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(ignored checks, static findings) of Python files; findings of the changed files only, but seen with all files."""
    p = cut(extract.parsed(files.filter("language = 'python'")))
    calls, functions = extract.all_calls(p), extract.functions(p)
    ignored, static = detect.ignored_returns(calls, functions), detect.static_rules(calls, functions)
    if changed is None:
        return ignored, static
    keep = cut(tree.only_files(files.select("rel"), changed))
    return ignored.join(keep, "rel", "left_semi"), static.join(keep, "rel", "left_semi")


def chunked(files: DataFrame, diff_files: list[str], model: Model | None = None, mode: str = "note", window: int = 400, overlap: int = 40) -> DataFrame:
    """A scan that covers every line of the changed files (all source files, if none of them is one): deterministic
    findings first, then the answer to each window. Columns place (part, rel, at), text."""
    spark = files.sparkSession
    changed = spark.createDataFrame([(f,) for f in diff_files], "rel string") if diff_files else None
    ignored, static = rules(files, changed)
    known = detect.report(ignored, static).select(F.struct(F.lit(0).alias("part"), F.lpad(F.col("place.part").cast("string"), 4, "0").alias("rel"), (F.col("place.file_ord").cast("long") * (1 << 31) + F.col("place.ord")).alias("at")).alias("place"), "text")
    some = tree.changed_or_all(files, changed)
    told = None
    if mode != "off":
        nodes, edges = graph.of_files(files)
        told = notes(mode, files, cut(nodes), cut(edges), diff_files)
    asked = windows.requests(some, told, window, overlap)
    said = windows.answered(asked, model, SCAN)
    return known.unionByName(said.select(F.struct(F.lit(1).alias("part"), F.col("rel"), F.col("start").cast("long").alias("at")).alias("place"), F.concat(F.format_string("\n[scanning %s:%d-%d]\n", "rel", "start", "stop"), "output").alias("text")))


def deletions(diff: DataFrame, before: DataFrame, after: DataFrame) -> dict[str, DataFrame]:
    """What a change takes away: comment boundaries that open, controls that go, calls that break, nodes that come alive.
    diff: diff_id, pos, raw; before and after: source files."""
    (n0, e0), (n1, _) = graph.of_files(before), graph.of_files(after)
    n0, e0, n1 = cut(n0), cut(e0), cut(n1)
    return {
        "boundaries": diffs.boundary_text(diffs.boundary_deletions(diff)),
        "controls": snapshots.deletion_text(snapshots.security_deletions(n0, e0, n1)),
        "broken": snapshots.broken_text(snapshots.broken_edges(e0, n1)),
        "activated": snapshots.activated(n0, n1),
    }


def change_report(diff: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Everything a scan says of a change before it asks a model: place (part, key), text."""
    gone = deletions(diff, before, after)
    ignored, static = rules(after, diff.select("file").distinct())
    known = detect.report(ignored, static)
    per_file = authorship.analyze(diffs.split_by_file(diff), "text").filter("likely_ai")
    rows = [
        (0, F.concat("file", F.lit(" "), F.lpad(F.col("pos").cast("string"), 20, "0")), gone["boundaries"]),
        (1, F.col("id"), gone["controls"]),
        (2, F.concat("caller", F.lit(" "), "missing_callee"), gone["broken"]),
        (3, F.col("id"), gone["activated"].withColumn("text", F.concat(F.lit("activated: "), "id"))),
        (4, F.format_string("%d %010d %010d", "place.part", "place.file_ord", "place.ord"), known),
        (5, F.col("file"), per_file.withColumn("text", F.format_string("- `%s` — %s", "file", "summary"))),
    ]
    out = None
    for part, key, frame in rows:
        one = frame.select(F.struct(F.lit(part).alias("part"), key.alias("key")).alias("place"), "text")
        out = one if out is None else out.unionByName(one)
    return out


def debug_parts(nodes: DataFrame, edges: DataFrame, files: DataFrame, target: str, relevant: list[str] = (), cap: int = 80) -> DataFrame:
    """What a model is told to find a cause: the neighbourhood of a file (else of a function), narrowed to the relevant
    files if some of it is left then. place, text."""
    start = traverse.find_file(nodes, target).select("id").limit(1).collect() or traverse.find_function(nodes, target).select("id").limit(1).collect()
    if not start:
        return files.sparkSession.createDataFrame([], "place struct<part:int,rel:string>, text string")
    near = traverse.neighborhood(edges, start[0].id, 3, cap, nodes.select(F.col("id").alias("node"), F.concat(F.lit("file:"), "file").alias("file")))
    sub = cut(nodes.join(near.select(F.col("node").alias("id")), "id", "left_semi"))
    if relevant:
        some = cut(traverse.keep_relevant(sub, list(relevant)))
        sub = sub if some.isEmpty() else some
    inner = traverse.induced(edges, sub.select(F.col("id").alias("node")))
    told = graph.stats(sub, inner).first()
    summary = f"{told.nodes} nodes ({told.file_nodes} files, {told.function_nodes} functions, {told.class_nodes} classes), {told.edges} edges"
    texts = tree.contents(sub, files).select("rel", "source")
    return windows.context_parts(summary, texts)


def experiment(spark: SparkSession, arms: dict[str, Callable[[int], DataFrame]], repeats: int) -> tuple[DataFrame, list[tuple[str, int, str]]]:
    """Runs each arm so often, once more where it fails, and leaves out what fails twice. An arm makes a frame of one run
    (text). Returns arm, run_index, text, seconds, and what failed."""
    import time

    out, failed = None, []
    for arm, make in arms.items():
        for i in range(repeats):
            for attempt in (0, 1):
                began = time.perf_counter()
                try:
                    got = cut(make(i).select(F.lit(arm).alias("arm"), F.lit(i).alias("run_index"), "text"))
                except Exception as e:  # a model's failure is no empty answer: it is noted, and the run is left out
                    if attempt:
                        failed.append((arm, i, str(e)))
                    continue
                one = got.withColumn("seconds", F.lit(time.perf_counter() - began))
                out = one if out is None else out.unionByName(one)
                break
    return out if out is not None else spark.createDataFrame([], "arm string, run_index int, text string, seconds double"), failed


def as_run(report: DataFrame) -> DataFrame:
    """A report (place, text) as one text, for scoring. A report is what one reader reads."""
    return report.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "").alias("text"))


def scored(runs: DataFrame, truth: DataFrame, fuzz: int = 5) -> DataFrame:
    """Runs (arm, run_index, text) against the truth: findings without repeats, matched one to one, with precision,
    recall and F1."""
    keyed = runs.withColumn("run", F.concat("arm", F.lit("#"), "run_index"))
    found = cut(evaluate.parse_findings(keyed.select("run", "text")))
    kept = cut(evaluate.dedupe(found))
    got = evaluate.outcome(keyed, kept, truth, evaluate.match(kept, truth, "run", fuzz)[0])
    return evaluate.scores(got).join(keyed.select("run", "arm", "run_index"), "run")


def spend_first(planned: DataFrame, spent: float, cap: float, reserve: float = 0.30) -> DataFrame:
    """Which of the planned runs (ord, estimate) the budget allows, one after another."""
    return cost.within_budget(planned.withColumn("all", F.lit(0)), ["all"], ["ord"], "estimate", cap - spent, reserve).drop("all")
