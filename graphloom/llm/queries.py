"""Queries over the operators of this subpackage, with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_output

    return token_output.read_records(spark, token_output.write_records(table(spark, sf_dir, "documents")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"))


def op4_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    found = decontaminate.report(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.drop("spans")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), "text")


def op6_bottom_k_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.dedup(table(spark, sf_dir, "documents"))


def op7_multi_index_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embed_dedup

    return embed_dedup.links(table(spark, sf_dir, "embeddings"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents")
    scores = quality.judged(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    out = quality.resample(scores, docs.count() // 2)
    return out.select("doc_id", *(F.round(c, 6).alias(c) for c in ("log_weight", "mean_ratio", "lowest", "gumbel")), "kept", "sampled")


def op10_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    out = sharding.interleave(table(spark, sf_dir, "documents"))
    return out.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def queries() -> dict:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return dict(oracles.SQL)
