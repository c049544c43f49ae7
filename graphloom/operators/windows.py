"""Line windows and context assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import lines, split_lines


def window_starts(total: Column, window: int = 400, overlap: int = 40) -> Column:
    """Array of (start, stop), 1-based and inclusive; the first window that reaches the end is the last."""
    step = max(1, window - overlap)
    every = F.transform(F.sequence(F.lit(1), F.greatest(total, F.lit(1)), F.lit(step)), lambda s: F.struct(s.alias("start"), F.least(s + window - 1, total).alias("stop")))
    return F.filter(every, lambda w: (w["start"] == 1) | (w["start"] - step + window - 1 < total))


def line_windows(files: DataFrame, text: str = "text", window: int = 400, overlap: int = 40, numbered: bool = True) -> DataFrame:
    """One row a window: start, stop and its text with line numbers."""
    rows = files.withColumn("_l", lines(text))
    rows = rows.withColumn("_w", F.explode(window_starts(F.size("_l"), window, overlap)))
    part = F.slice("_l", F.col("_w.start"), F.col("_w.stop") - F.col("_w.start") + 1)
    if numbered:
        part = F.transform(part, lambda l, i: F.concat((F.col("_w.start") + i).cast("string"), F.lit(": "), l))
    keep = [c for c in files.columns if c != text]
    return rows.select(*keep, F.col("_w.start").alias("start"), F.col("_w.stop").alias("stop"), F.array_join(part, "\n").alias("body"))


def preview(files: DataFrame, text: str = "text", most: int = 500) -> DataFrame:
    """Each file cut to its first lines, with how many it has."""
    return files.withColumn("n_lines", F.size(lines(text))).withColumn("head", F.array_join(F.slice(lines(text), 1, most), "\n")).withColumn("truncated", F.col("n_lines") > most)


def context_parts(summary: str, contents: DataFrame, extra: str = "", most: int = 500) -> DataFrame:
    """The parts of a message about a piece of the graph, in order: summary, each file cut to its first lines, further
    notes. contents: rel, source. Columns place (part, rel) and text; joined by newlines they are the message."""
    cut = preview(contents, "source", most)
    note = F.when(F.col("truncated"), F.format_string("\n\n... (%d lines truncated)", F.col("n_lines") - most)).otherwise("")
    body = F.format_string("### %s\n```\n%s%s\n```\n", "rel", "head", note)
    spark = contents.sparkSession
    fixed = [(0, "## Dependency Graph\n" + summary), (1, "\n## Source Files\n")] + ([(3, "\n## Additional Context\n" + extra)] if extra else [])
    ends = spark.createDataFrame(fixed, "part int, text string").select(F.struct("part", F.lit("").alias("rel")).alias("place"), "text")
    return ends.unionByName(cut.select(F.struct(F.lit(2).alias("part"), F.col("rel").alias("rel")).alias("place"), body.alias("text")))


def orient_parts(contents: DataFrame, most: int = 100) -> DataFrame:
    """Previews for a map of a repository: rel, text."""
    cut = preview(contents, "source", most)
    note = F.when(F.col("truncated"), F.format_string("\n... (%d more lines)", F.col("n_lines") - most)).otherwise("")
    return cut.select("rel", F.format_string("### %s\n```\n%s%s\n```\n", "rel", "head", note).alias("text"))


def requests(files: DataFrame, notes: DataFrame | None = None, window: int = 400, overlap: int = 40) -> DataFrame:
    """One request a window of every file (rel, source): rel, start, stop, message. notes: rel, note."""
    rows = files.select("rel", split_lines("source").alias("_l")).filter(F.size("_l") > 0)
    rows = rows.join(notes.select("rel", "note"), "rel", "left") if notes is not None else rows.withColumn("note", F.lit(""))
    rows = rows.withColumn("_w", F.explode(window_starts(F.size("_l"), window, overlap)))
    start, stop = F.col("_w.start"), F.col("_w.stop")
    body = F.array_join(F.transform(F.slice("_l", start, stop - start + 1), lambda l, i: F.concat((start + i).cast("string"), F.lit(": "), l)), "\n")
    asked = "## Task\nReport security vulnerabilities in this code using the ## [SEVERITY: ...] format, with **Location:** `%s:LINE` using the exact line numbers shown."
    message = F.format_string("## File `%s` (lines %d-%d of %d)\n```\n%s\n```\n%s\n" + asked, "rel", start, stop, F.size("_l"), body, F.coalesce("note", F.lit("")), "rel")
    return rows.select("rel", start.alias("start"), stop.alias("stop"), message.alias("message"))


def answered(asked: DataFrame, scan: Callable[[str, str], Iterator[str]] | None = None, system: str = "") -> DataFrame:
    """Each request with the answer of a model: ``scan(system, message)`` gives it in chunks and runs on executors.

    Without one, nothing is found: the model behind it is the caller's. Its errors are the task's errors; they are not
    taken for empty answers.
    """
    if scan is None:
        return asked.withColumn("output", F.lit(""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(output=["".join(scan(system, m)) for m in b.message])

    return asked.mapInPandas(run, StructType([*asked.schema.fields, StructField("output", StringType())]))
