"""Cutting lineage of iterative plans in a way that survives lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one is set here only where none is, and only in local mode."""
    sc = spark.sparkContext
    set_dir = sc._jsc.sc().getCheckpointDir()
    named = sc.getConf().get("spark.checkpoint.dir", None) or (set_dir.get() if set_dir.isDefined() else None)
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file:///tmp/graphloom-checkpoints"
    if not set_dir.isDefined():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh address under the shared folder."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder: lineage ends here and survives the loss of executors."""
    shared(df.sparkSession)
    return df.checkpoint()


def running(df: DataFrame, order: list[Column | str], value: Column, out: str) -> DataFrame:
    """Adds the sum of value over all rows before each, in a total order of the whole frame. Rows are dealt by ranges of
    the order; only one count a range is summed in one place."""
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = cut(dealt.withColumn("_v", value))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("_part").agg(F.sum("_v").alias("_s")).select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(base), "_part").withColumn(out, F.col("_base") + F.coalesce(F.sum("_v").over(inner), F.lit(0))).drop("_part", "_v", "_base")
