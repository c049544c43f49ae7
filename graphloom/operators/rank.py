"""Similarity ranking and the content-hash cache (V1-V3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import running


def cosine(a: Column, b: Column) -> Column:
    """Over the common length; norms over the whole vectors; 0 where a norm is 0."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    n = F.least(F.size(a), F.size(b))
    dot = total(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot / (norm(a) * norm(b)))


def nearest(vectors: DataFrame, query: list[float], id_col: str, vec_col: str, top: int = 20) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(id_col, F.round(cosine(F.col(vec_col), q), 6).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(top)


def cache_lookup(files: DataFrame, cache: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Files with hit (same path and content hash) and, for misses, the batch of 20 that computes them."""
    f = files.withColumn("hash", F.sha2(content, 256))
    c = cache.select(path, "hash", F.lit(True).alias("_hit")).distinct()
    return f.join(c, [path, "hash"], "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def batches(misses: DataFrame, path: str = "path", size: int = 20) -> DataFrame:
    """Adds the batch of each row: so many rows each, in the order of the path."""
    return running(misses, [path], F.lit(1), "_before").withColumn("batch", F.floor(F.col("_before") / size)).drop("_before")


def merge_cache(cache: DataFrame, fresh: DataFrame, path: str = "path") -> DataFrame:
    """The cache with new entries in place of old ones of the same path."""
    return cache.join(fresh.select(path), path, "left_anti").unionByName(fresh.select(*cache.columns))


def prune(nodes: DataFrame, top_files: DataFrame, file: str = "path") -> DataFrame:
    """Nodes whose file contains one of the top files' paths (a top-k list, so it is broadcast)."""
    f = F.broadcast(top_files.select(F.col(file).alias("_top")))
    return nodes.join(f, F.contains(F.col("file"), F.col("_top")), "left_semi")
