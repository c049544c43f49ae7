"""Corpus pipeline: quality, lines, near documents, benchmark passages, packing; each stage written and read again.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last keep the columns of documents. A stage
sees exactly what its predecessor kept.

* quality: documents that the importance-resampling classifier rejects go; its models count the stage's own input.
* lines: redundant lines go; a document that had text and has none left is a copy and goes too.
* near documents: of each group of near copies the smallest doc_id stays.
* decontamination: documents that hold a window of a benchmark item go.
* packing: the rest becomes sequences.

Defined cases: a null or empty text is no line, near copy or benchmark passage, passes every stage and is packed as its end
id; texts of any length are read whole; ties go to the smaller doc_id; rows that share a doc_id are told apart by their
texts, and rows that repeat are one document after the near stage; a null doc_id is the largest; other columns pass through
whatever their names; an empty table gives no rows at any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, line_dedup, minhash, packing, quality
from graphloom.llm._text import shared_dir, stored


def slim(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, so that no name can clash with an operator's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(0)).alias("_rest"))


def unslim(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col("_rest")[c].alias(c) for c in columns))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unslim(quality.judged(slim(docs), model, ["text", "_rest"]).filter("kept"), docs.columns)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(slim(docs))
    emptied = (F.col("_removed") > 0) & (F.trim(F.translate("text", "\n\r\t", "   ")) == "")
    out = unslim(out.filter(~F.coalesce(emptied, F.lit(False))), docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where doc_ids name rows, they tell them apart. Else (repeated or null ones) each distinct row gets a number in the
    order of its doc_id, and rows that repeat are one document."""
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if shared.isEmpty():
        gone = minhash.dedup(docs, k=5).filter("not kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    row = F.xxhash64("doc_id", "text"), F.md5(F.coalesce("text", F.lit("")))
    keyed = slim(docs).withColumns({"_one": row[0], "_two": row[1], "_null": F.col("text").isNull()})
    names = keyed.select("doc_id", "_one", "_two", "_null").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "_one", "_two", "_null")
    numbered = stored(names.withColumn("_uid", F.monotonically_increasing_id()), "row-numbers")
    same = (keyed.doc_id.eqNullSafe(numbered.doc_id)) & (keyed["_one"] == numbered["_one"]) & (keyed["_two"] == numbered["_two"]) & (keyed["_null"] == numbered["_null"])
    rows = keyed.join(numbered, same).select(keyed.doc_id, "text", "_rest", "_uid").dropDuplicates(["_uid"])
    rows = stored(rows, "rows")
    gone = minhash.dedup(rows, k=5, id_col="_uid").filter("not kept").select(F.col("doc_id").alias("_uid"))
    return unslim(rows.join(gone, "_uid", "left_anti"), docs.columns)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find(slim(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id", "text", "_rest"])
    return unslim(found.filter(F.size("spans") == 0), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality_filter), ("lines", line_filter), ("near documents", near_filter), ("decontamination", benchmark_filter), ("packing", pack)]

#: Tokenisation and trained models are beyond SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
