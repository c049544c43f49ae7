"""Quality classifier by importance resampling.

Two generative models over BUCKETS hashed byte n-grams: one of target text (documents labelled good and not toxic), one
of raw text (all documents). Each n-gram has the log of its target count over the count that the raw model expects
there, both smoothed by PRIOR, so n-grams too rare to tell count for nothing. A document's log weight is the sum over
its n-grams. Gumbel noise, a function of the seed and doc_id, is added to it, and the k highest are the resampled corpus.

For the decision to keep a document two statistics of the same log ratios are used: their mean, and the lowest sum of
negative ones over WINDOW n-grams in a row, which shows one foul word in a long clean text. Both thresholds are set on
labelled documents that the target model did not see: as high as they can be while at most FALSE_REJECTS of the good fall under.

The labelled rows used are a sample of at most MAX_LABELS, by hash of doc_id. Raw counts cover all documents. Only the
BUCKETS counts come to the driver, whatever the corpus.

Defined cases: null and empty texts have no n-grams, weight 0 and are kept; texts of any length are read whole; ties in the
resampling go to the smaller doc_id, a null one last, and exactly k rows are taken; without labels all is kept; a null
doc_id has no label; repeated rows are judged one by one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ._text import column, mix, powers, prefix_hash, slices, stored

GRAM = 5
BUCKETS = 1 << 18
WINDOW = 6
BINS = 1 << 16
MAX_LABELS = 40_000
FALSE_REJECTS = 0.002
PRIOR = 5.0


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte; -1 where the text ends before it does."""
    out, n = np.full(len(data), -1, np.int32), len(data) - GRAM + 1
    if n > 0:
        s = prefix_hash(data)
        h = mix((s[GRAM:] - s[:-GRAM]) * powers(len(s))[1][:n])
        out[:n] = (h >> np.uint64(20)) % np.uint64(BUCKETS)
    for k in range(1, GRAM):
        last = off[1:] - k
        out[last[last >= off[:-1]]] = -1
    return out


def counted(docs: DataFrame, target_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts of all documents, and of those in the target sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for rows, data, off in slices(batches):
            b = features(data, off)
            mine = np.repeat(np.isin(np.asarray(column(rows, "doc_id").fill_null(-1)), target_ids), np.diff(off))
            whole = b >= 0
            raw += np.bincount(b[whole], minlength=BUCKETS)
            target += np.bincount(b[whole & mine], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        for a in range(0, len(at), 1 << 16):
            i = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(raw[i]), pa.array(target[i])], ["b", "raw", "target"])

    got = docs.select("doc_id", "text").mapInArrow(run, "b int, raw long, target long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[got.b], target[got.b] = got.raw, got.target
    return raw, target


def scored(docs: DataFrame, ratio: np.ndarray, extra: list[str] = ()) -> DataFrame:
    """log_weight, mean and lowest window of every document."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(ratio.astype(np.float64))
    keep = ["doc_id", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = sent.value
        for rows, data, off in slices(batches):
            b = features(data, off)
            single = np.where(b >= 0, r[np.maximum(b, 0)], 0.0)
            sums = np.concatenate([[0.0], np.cumsum(single)])
            weight, size = sums[off[1:]] - sums[off[:-1]], np.diff(off)
            n = np.maximum(size - GRAM + 1, 0)
            c = np.concatenate([[0.0], np.cumsum(np.minimum(single, 0.0))])
            at = np.arange(len(single))
            window = c[np.minimum(at + WINDOW, np.repeat(off[1:], size))] - c[at]
            low, some = np.zeros(len(n)), size > 0
            if some.any():
                low[some] = np.minimum.reduceat(window, off[:-1][some])
            cols = [column(rows, c) for c in keep] + [pa.array(weight), pa.array(np.where(n > 0, weight / np.maximum(n, 1), 0.0)), pa.array(low), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "log_weight", "mean_ratio", "lowest", "n_grams"])

    schema = StructType([docs.schema[c] for c in keep] + [StructField(c, DoubleType()) for c in ("log_weight", "mean_ratio", "lowest")] + [StructField("n_grams", LongType())])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def threshold(good: np.ndarray, bad: np.ndarray, allowed: float) -> float:
    """The highest cut under which at most that share of the good ones falls, moved halfway to the bad one below it."""
    if not len(good) or not len(bad):
        return -np.inf
    good = np.sort(good)
    top = good[int(allowed * len(good))]
    under = bad[bad < top]
    return float((top + under.max()) / 2) if len(under) else -np.inf


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> dict:
    """Models and thresholds. Of the labelled sample, by hash, half makes the target model, a quarter sets the thresholds,
    and ``heldout`` has the figures on the last quarter, which neither has seen."""
    sample = labels.filter("doc_id is not null and quality is not null and toxic is not null").select("doc_id", "quality", "toxic", F.xxhash64(F.lit(5), "doc_id").alias("h")).orderBy("h", "doc_id").limit(max_labels).toPandas()
    good = ((sample.quality == 1) & (sample.toxic == 0)).to_numpy()
    part = sample.h.to_numpy() % 4
    held, unseen = part == 0, part == 1
    ids = sample.doc_id.to_numpy(np.int64)
    raw, target = counted(docs, np.unique(ids[good & (part > 1)]))
    ratio = np.log((target + PRIOR) / (raw * (target.sum() / max(1.0, raw.sum())) + PRIOR)) if target.any() else np.zeros(BUCKETS)
    either = held | unseen
    asked = docs.sparkSession.createDataFrame([(int(i),) for i in np.unique(ids[either])], "doc_id long")
    got = scored(docs.join(F.broadcast(asked), "doc_id", "left_semi"), ratio).toPandas()  # at most half of max_labels ids
    label, role = dict(zip(ids[either], good[either], strict=True)), dict(zip(ids[either], held[either], strict=True))
    is_good, sets = (np.array([d[i] for i in got.doc_id], bool) for d in (label, role))
    cut = {c: threshold(got[c].to_numpy()[sets & is_good], got[c].to_numpy()[sets & ~is_good], FALSE_REJECTS) for c in ("mean_ratio", "lowest")}
    out = (got.mean_ratio < cut["mean_ratio"]) | (got.lowest < cut["lowest"])
    told = lambda x: int((x & ~sets).sum())
    stats = {"good": told(is_good), "bad": told(~is_good), "good_rejected": told(out & is_good), "bad_rejected": told(out & ~is_good)}
    return {"ratio": ratio, "mean_ratio": cut["mean_ratio"], "lowest": cut["lowest"], "heldout": stats}


def judged(docs: DataFrame, model: dict, extra: list[str] = ()) -> DataFrame:
    """Every document with its statistics and the decision."""
    ok = F.lit(True)
    for c in ("mean_ratio", "lowest"):
        if np.isfinite(model[c]):
            ok = ok & (F.col(c) >= F.lit(model[c]))
    return scored(docs, model["ratio"], extra).withColumn("kept", (F.col("n_grams") == 0) | ok)


def least(rows: DataFrame, value: str, k: int) -> tuple:
    """The k-th smallest value (k > 0), and how many rows are below it, by counts of ever narrower ranges: each pass
    brings at most BINS counts to the driver, however the values lie."""
    lo, hi = rows.agg(F.min(value), F.max(value)).first()
    below = 0
    while lo < hi:
        at = F.floor((F.col(value) - F.lit(lo)) / F.lit(float(hi) - float(lo)) * BINS)
        inside = rows.filter(F.col(value).between(F.lit(lo), F.lit(hi)))
        for b in inside.groupBy(F.least(F.greatest(at, F.lit(0)), F.lit(BINS - 1)).alias("c")).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).orderBy("lo").collect():  # at most BINS counts
            if below + b.n >= k:
                break
            below += b.n
        lo, hi = b.lo, b.hi
    return lo, below


def resample(scores: DataFrame, k: int, seed: int = 11) -> DataFrame:
    """Adds gumbel (log weight plus noise) and sampled: whether a row is among the k highest, of all rows. Exactly k rows
    are, if there are so many: ties go to the smaller doc_id (a null one last), then to one of the rows that repeat."""
    u = (F.xxhash64(F.lit(seed), "doc_id").bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / F.lit(float(1 << 52))
    noisy = stored(scores.withColumn("gumbel", F.col("log_weight") - F.log(-F.log(u))).withColumn("_u", F.monotonically_increasing_id()), "resampled")
    if k >= noisy.count():
        return noisy.withColumn("sampled", F.lit(True)).drop("_u")
    ranked = noisy.withColumn("_g", -F.col("gumbel")).withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)))
    tied, same, taken, left = ranked.select("_g", "_d", "_u"), F.lit(True), F.lit(False), k
    for c in ("_g", "_d", "_u") if k > 0 else ():
        border, below = least(tied, c, left)
        taken = taken | (same & (F.col(c) < F.lit(border)))
        same, left = same & (F.col(c) == F.lit(border)), left - below
        tied = tied.filter(F.col(c) == F.lit(border))
    taken = (taken | same) if k > 0 else taken
    return ranked.withColumn("sampled", taken).drop("_u", "_g", "_d")
