"""op5: lines lose the white space at their ends, of any kind, whichever end has it."""

from pyspark.sql import functions as F

from graphloom.llm import line_dedup


def test_ends(spark):
    inner = ["", "a", "a b", "é　ü", "日本", "​", "x\ty"]
    lines = [p + x + q for x in inner for p in ("", *line_dedup.WHITE, " \t　") for q in ("", *line_dedup.WHITE, "\r ")]
    df = spark.createDataFrame([(x,) for x in [*lines, None]], "line string")
    rows = df.select("line", line_dedup.trimmed(F.col("line")).alias("got"), F.trim("line", F.lit(line_dedup.WHITE)).alias("want")).collect()
    assert all(r.got == r.want == (r.line and r.line.strip(line_dedup.WHITE)) for r in rows)
