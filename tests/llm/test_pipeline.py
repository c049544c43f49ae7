"""Each stage of the corpus pipeline against a plain version of it, and the whole."""

import corpus_pipeline as cp
from pyspark.sql import functions as F

from graphloom.llm import quality
from graphloom.llm._text import stored
from graphloom.llm._tok import default_path

from ..conftest import DATA
from . import brute

SF = f"{DATA}/sf0.01"


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, types = docs.columns, docs.dtypes
    now = docs
    for name, stage in cp.STAGES:
        before = pairs(now)
        out = stored(stage(spark, now, SF), "test-stage")
        if name == "quality":
            model = quality.fit(now, spark.read.parquet(f"{SF}/labels.parquet"))
            assert sorted(r[0] for r in pairs(out)) == sorted(r.doc_id for r in quality.judged(now, model).filter("kept").select("doc_id").collect())
            assert 0.5 * len(before) < out.count() < len(before)
        elif name == "lines":
            want = sorted((i, t) for i, _, gone, t in brute.lines(before) if not (gone and not t.strip()))
            assert sorted(pairs(out)) == want
        elif name == "near documents":
            assert sorted(r[0] for r in pairs(out)) == [r[0] for r in brute.near(before, 5) if r[3]]
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert sorted(r[0] for r in pairs(out)) == [r[0] for r in brute.contamination(before, items) if not r[-1]]
        else:
            assert sorted(tuple(r) for r in out.select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == brute.pieces(before, default_path())
            break
        assert out.columns == columns and out.dtypes == types
        now = out


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "x"), (2, "", "x"), (3, "same words over and over again\nsame words over and over again", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("kept", F.lit(1))
    for _, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, f"{DATA}/sf0.001"), "test-odd")
        assert docs.columns == ["doc_id", "text", "spans", "kept"]
    assert cp.STAGES[-1][1](spark, docs, SF).count() == docs.count() > 0  # the repeated row is one document by now
    none = stored(docs.limit(0), "none")
    for _, stage in cp.STAGES:
        assert stage(spark, none, f"{DATA}/sf0.001").count() == 0


def test_near_rows_that_share_an_id(spark):
    words = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(1, words), (2, words), (2, other), (3, other + " more"), (None, words), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_uid", F.lit("mine"))
    out = stored(cp.near_filter(spark, docs, SF), "near-shared")
    assert out.columns == ["doc_id", "text", "_uid"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, words), (2, other), (4, None), (5, "")], key=str)
