"""Cost accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import div


def usd(usage: DataFrame, prices: DataFrame, by: list[str]) -> DataFrame:
    """usage: by, meter, tokens; prices: meter, per_million (a few rows). Cost of each group."""
    return usage.join(F.broadcast(prices), "meter").groupBy(*by).agg(F.sum(F.col("tokens") / 1e6 * F.col("per_million")).alias("usd"))


def running_spend(ledger: DataFrame, by: list[str], order: list[str], cost: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ledger.withColumn("spent", F.sum(cost).over(w))


def within_budget(ledger: DataFrame, by: list[str], order: list[str], cost: str, budget: float, reserve: float = 0.30) -> DataFrame:
    """Adds allowed: whether what is left before the row, less its cost, leaves the reserve."""
    run = running_spend(ledger, by, order, cost)
    return run.withColumn("allowed", F.lit(budget) - F.col("spent") >= reserve)


def per_benchmark(runs: DataFrame, by: str, cost: str, seconds: str, loc: str, files: str, tp: str) -> DataFrame:
    out = runs.groupBy(by).agg(F.count("*").alias("runs"), F.avg(cost).alias("cost_mean"), F.coalesce(F.stddev_samp(cost), F.lit(0.0)).alias("cost_std"), F.avg(seconds).alias("seconds_mean"), F.max(loc).alias("loc"), F.max(files).alias("files"), F.avg(tp).alias("tp_mean"))
    return out.select("*", div(F.col("cost_mean"), F.col("loc") / 1000).alias("cost_per_kloc"), div(F.col("cost_mean"), F.col("files")).alias("cost_per_file"), F.when(F.col("tp_mean") != 0, F.col("cost_mean") / F.col("tp_mean")).alias("cost_per_tp"))


def grand_total(benchmarks: DataFrame) -> DataFrame:
    """Sums of means with ratios taken anew; the deviation of a total is given as 0."""
    t = benchmarks.agg(F.sum("runs").alias("runs"), F.sum("cost_mean").alias("cost_mean"), F.lit(0.0).alias("cost_std"), F.sum("seconds_mean").alias("seconds_mean"), F.sum("loc").alias("loc"), F.sum("files").alias("files"), F.sum("tp_mean").alias("tp_mean"))
    return t.select("*", div(F.col("cost_mean"), F.col("loc") / 1000).alias("cost_per_kloc"), div(F.col("cost_mean"), F.col("files")).alias("cost_per_file"), F.when(F.col("tp_mean") != 0, F.col("cost_mean") / F.col("tp_mean")).alias("cost_per_tp"))


def outliers(rows: DataFrame, value: str, times: float = 3.0) -> DataFrame:
    """Adds outlier: over so many times the exact median (one row, joined to all)."""
    m = rows.agg(F.median(value).alias("_m"))
    return rows.join(F.broadcast(m)).withColumn("outlier", F.col(value) > times * F.col("_m")).drop("_m")


def stage_shares(stages: DataFrame, by: str, stage: str, seconds: str) -> DataFrame:
    means = stages.groupBy(by, stage).agg(F.avg(seconds).alias("mean_s"))
    whole = F.sum("mean_s").over(Window.partitionBy(by))
    return means.withColumn("pct", div(100 * F.col("mean_s"), whole))


def stage_records(starts: DataFrame, stops: DataFrame, by: list[str]) -> DataFrame:
    """Seconds of each stage from marks of its start and end (C8): by, stage, seconds; a stage may run more than once."""
    a = starts.groupBy(*by, "stage").agg(F.sum(F.col("at").cast("double")).alias("_a"), F.count("*").alias("_n"))
    b = stops.groupBy(*by, "stage").agg(F.sum(F.col("at").cast("double")).alias("_b"), F.count("*").alias("_m"))
    return a.join(b, [*by, "stage"]).filter("_n = _m").select(*by, "stage", (F.col("_b") - F.col("_a")).alias("seconds"))


def usage_totals(calls: DataFrame, by: list[str]) -> DataFrame:
    """Tokens in and out by model and how many calls, from records of single calls (by, model, tokens_in, tokens_out)."""
    total = lambda model, way: F.coalesce(F.sum(F.when(F.col("model") == model, F.col(f"tokens_{way}"))), F.lit(0)).alias(f"{model}_{way}")
    return calls.groupBy(*by).agg(*(total(m, w) for m in ("haiku", "sonnet") for w in ("in", "out")), F.count("*").alias("calls"))


def fresh_records(runs: DataFrame, benchmark: str, loc: DataFrame) -> DataFrame:
    """Cost records of runs made now (C11), in the form of stored ones: the runs themselves are the caller's."""
    return runs.crossJoin(loc.select("n_files", "loc")).select(F.lit(benchmark).alias("benchmark"), "run_index", F.lit("fresh").alias("source"), "wall_clock_s", F.col("n_files").alias("files"), "loc", "haiku_in", "haiku_out", "sonnet_in", "sonnet_out", "findings", "confirmed_tp", "cost_usd")  # one row of counts
