"""Reports of other tools, truth lists and ledgers as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strip

TRUTH = "vulnerabilities array<struct<id string, file string, category string, line_start int, line_end int, description string, accepted_categories array<string>, provisional boolean, provisional_reason string>>"
RULE = "id string, name string, shortDescription struct<text string>, fullDescription struct<text string>, properties struct<tags array<string>>"
PART = f"struct<name string, version string, semanticVersion string, rules array<struct<{RULE}>>>"
PLACE = "struct<physicalLocation struct<artifactLocation struct<uri string>, region struct<startLine int>>>"
SARIF = f"runs array<struct<tool struct<driver {PART}, extensions array<{PART}>>, results array<struct<ruleId string, rule struct<id string>, message struct<text string>, locations array<{PLACE}>>>>>"
SEMGREP = "results array<struct<check_id string, path string, start struct<line int>, extra struct<message string, metadata struct<cwe string>>>>"
BANDIT = "results array<struct<test_id string, test_name string, issue_text string, filename string, line_number int>>"
USAGE = "struct<haiku_in bigint, haiku_out bigint, sonnet_in bigint, sonnet_out bigint, calls bigint>"
LEDGER = f"ts string, phase string, label string, arm string, run_index int, target string, chunked boolean, use_graph boolean, recall double, tp int, fp int, total_findings int, matched_ids array<string>, missed_ids array<string>, usage {USAGE}, cost_usd double, scan_time_s double"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows: path, text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def truth(docs: DataFrame, text: str = "text") -> DataFrame:
    """Planted flaws of truth lists: what each accepts by default is its own category; none is provisional unless it
    says so."""
    v = docs.select(F.posexplode(F.from_json(text, TRUTH)["vulnerabilities"]).alias("ord", "v"))
    return v.select("ord", "v.id", "v.file", "v.category", "v.line_start", "v.line_end", F.coalesce("v.accepted_categories", F.array("v.category")).alias("accepted"), F.coalesce("v.provisional", F.lit(False)).alias("provisional"), F.coalesce("v.description", F.lit("")).alias("description"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).json(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def one_line(file: Column, line: Column) -> Column:
    return F.array(F.struct(F.coalesce(file, F.lit("")).alias("file"), F.coalesce(line.cast("long"), F.lit(0)).alias("line")))


def semgrep(docs: DataFrame, text: str = "text", run: str = "run") -> DataFrame:
    """run, ord, title, category, locations. A weakness can be one string or a list of them."""
    r = docs.select(run, F.posexplode(F.from_json(text, SEMGREP)["results"]).alias("ord", "r"))
    cwe = F.col("r.extra.metadata.cwe")
    listed = F.array_join(F.from_json(cwe, "array<string>"), " ")
    said = F.when(cwe.startswith("["), listed).otherwise(F.coalesce(cwe, F.lit("")))
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    return r.select(run, "ord", F.element_at(F.split(part("r.check_id"), "[.]"), -1).alias("title"), F.concat(part("r.check_id"), F.lit(" "), said, F.lit(" "), part("r.extra.message")).alias("category"), one_line(F.col("r.path"), F.col("r.start.line")).alias("locations"))


def bandit(docs: DataFrame, text: str = "text", run: str = "run") -> DataFrame:
    """run, ord, title, category, locations. What stands before the first brace is progress, not report."""
    body = F.expr(f"substring({text}, locate('{{', {text}))")
    r = docs.select(run, F.posexplode(F.from_json(body, BANDIT)["results"]).alias("ord", "r"))
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    return r.select(run, "ord", part("r.test_name").alias("title"), F.concat_ws(" ", part("r.test_id"), part("r.test_name"), part("r.issue_text")).alias("category"), one_line(F.col("r.filename"), F.col("r.line_number")).alias("locations"))


def sarif(docs: DataFrame, text: str = "text", run: str = "run") -> DataFrame:
    """run, part, ord, title, category, rule_id, cwes, locations of analysis reports. Of rules with one id the first
    stands, the driver's before the extensions'; a place counts once; a result without a place is left out."""
    parts = docs.select(run, F.posexplode(F.from_json(text, SARIF)["runs"]).alias("part", "r"))
    none = F.expr(f"cast(array() as array<struct<{RULE}>>)")
    extensions = F.flatten(F.transform("r.tool.extensions", lambda e: F.coalesce(e["rules"], none)))
    rules = F.concat(F.coalesce("r.tool.driver.rules", none), F.coalesce(extensions, none))
    first = parts.select(run, "part", F.posexplode(rules).alias("k", "rule")).filter("rule.id != ''").groupBy(run, "part", F.col("rule.id").alias("rule_id")).agg(F.min_by("rule", "k").alias("rule"))
    res = parts.select(run, "part", F.posexplode("r.results").alias("ord", "x")).withColumn("rule_id", F.coalesce(F.nullif("x.ruleId", F.lit("")), "x.rule.id", F.lit("")))
    res = res.join(first, [run, "part", "rule_id"], "left")
    tags = F.transform(F.filter("rule.properties.tags", lambda t: F.lower(t).contains("cwe")), lambda t: F.substring_index(t, "/", -1))
    number = lambda t: F.regexp_replace(t, "[^0-9]", "")
    cwes = F.coalesce(F.flatten(F.transform(tags, lambda t: F.when(number(t) != "", F.array(t, F.concat(F.lit("CWE-"), number(t)))).otherwise(F.array(t)))), F.expr("cast(array() as array<string>)"))
    about = F.array_join(F.filter(F.array("rule.name", "rule.id", "rule.shortDescription.text", "rule.fullDescription.text"), lambda s: s != ""), " ")
    places = F.transform("x.locations", lambda p: F.struct(F.try_url_decode(F.replace(p["physicalLocation"]["artifactLocation"]["uri"], F.lit("+"), F.lit("%2B"))).alias("file"), F.coalesce(p["physicalLocation"]["region"]["startLine"].cast("long"), F.lit(0)).alias("line")))
    out = res.withColumn("cwes", cwes).withColumn("locations", F.array_distinct(F.filter(places, lambda p: p["file"] != "")))
    said = F.concat_ws(" ", "rule_id", about, F.array_join("cwes", " "), F.coalesce("x.message.text", F.lit("")))
    title = F.coalesce(F.nullif("rule.name", F.lit("")), F.nullif("rule_id", F.lit("")), F.lit("codeql-finding"))
    return out.filter(F.size("locations") > 0).select(run, "part", "ord", title.alias("title"), strip(said).alias("category"), "rule_id", "cwes", "locations")


def versions(docs: DataFrame, text: str = "text", run: str = "run") -> DataFrame:
    """run, name, version of the parts of an analysis tool; the last one named so stands."""
    parts = docs.select(run, F.posexplode(F.from_json(text, SARIF)["runs"]).alias("part", "r"))
    comps = F.concat(F.array("r.tool.driver"), F.coalesce("r.tool.extensions", F.expr(f"cast(array() as array<{PART}>)")))
    c = parts.select(run, "part", F.posexplode(comps).alias("k", "c")).select(run, F.struct("part", "k").alias("o"), "c.name", F.coalesce(F.nullif("c.semanticVersion", F.lit("")), F.nullif("c.version", F.lit(""))).alias("version"))
    return c.filter("name != '' and version is not null").groupBy(run, "name").agg(F.max_by("version", "o").alias("version"))


def run_records(docs: DataFrame, text: str = "text") -> DataFrame:
    """Cost records from stored result files: one row a run, with where it came from."""
    kind = f"runs array<struct<arm string, metrics struct<precision double, recall double, f1 double>, counts struct<tp int, fp int, fn int, total_findings int>, usage {USAGE}, target_loc int, scan_time_seconds double, cost_usd double>>, arm string"
    r = docs.select("path", F.from_json(text, kind).alias("d")).select("path", "d.arm", F.posexplode("d.runs").alias("run_index", "r"))
    return r.select(F.lit("stored").alias("source"), F.col("path").alias("artifact"), "run_index", F.coalesce("r.arm", "arm").alias("arm"), F.col("r.scan_time_seconds").alias("wall_clock_s"), F.col("r.target_loc").alias("loc"), *(F.coalesce(f"r.usage.{u}", F.lit(0)).alias(u) for u in ("haiku_in", "haiku_out", "sonnet_in", "sonnet_out")), F.col("r.counts.total_findings").alias("findings"), F.col("r.counts.tp").alias("confirmed_tp"), "r.cost_usd", "r.metrics.recall")


def recall_values(docs: DataFrame, text: str = "text") -> DataFrame:
    """Raw recall of every run by arm, over many result files (ST10): arm, path, run_index, recall."""
    kind = "arm string, aggregate struct<recall struct<raw_values array<double>>>"
    return docs.select("path", F.from_json(text, kind).alias("d")).select(F.col("d.arm").alias("arm"), "path", F.posexplode("d.aggregate.recall.raw_values").alias("run_index", "recall"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def markdown(rows: DataFrame, order: list[str]) -> DataFrame:
    """A report table as lines of Markdown, in order: head, rule, rows. A report is read by people; its rows are few."""
    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("—"))
    body = rows.select(F.lit(2).alias("part"), F.struct(*order).alias("o"), F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, rows.columns)), F.lit(" |")).alias("line"))
    kind = body.schema["o"].dataType.simpleString()
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(rows.columns) + " |"), (1, "|" + "---|" * len(rows.columns))], "part int, line string").select("part", F.expr(f"cast(null as {kind})").alias("o"), "line")
    return head.unionByName(body).orderBy("part", "o").select("line")
