"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct K-word shingles. Equal sets are one class, so exact copies never meet.
Of each class the KEYS smallest values are retained as entries of inverted lists, and the SKETCH smallest as a sketch.

* Lists of at most LIST entries yield the pairs that overlap in them; the Jaccard estimate from the sketch of the union
  (the smallest values of both) drops pairs far below the threshold.
* Longer lists never yield their pairs. A class with at least half of its retained values in short lists is found
  through those. The others meet, in each long list, a few leaders, of which all but one differ from list to list, so
  that these pairs grow with the members and not with their square; and once the links so far are known, every class that
  is not in its list's largest component is compared, in blocks, with all members of the list. What travels to the blocks
  is a bit for each place that an odd number of a set's values falls on: two sets differ in at least as many values as
  these bits do, so no link is lost, and few other pairs are left. The same bits drop most of the leaders' pairs that are
  no links before any full set is read.

Every link is confirmed on full sets. Links within a component that is connected already are not checked again: first
each class checks its best pair, and after contraction the remaining pairs between different components. Two sets of
similarity 0.8 fail to share one of 16 retained values with a chance of some 0.2**16, and fail the estimate (four standard
deviations below) with one of some 1e-5. Not in that figure: a class of which half or more of the retained values are not
hot stays out of the long lists, even if those values are in no list at all, and its links there are missed.

Defined cases: null, empty and blank texts have an empty set and link with nothing; texts of fewer than K words are one
shingle; texts of any length are read whole; rows with a null doc_id link with nothing; rows that repeat come back as often
as they came; equal estimates (ties) go to the pair of smaller ids; other columns, whatever their names, are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._graph import components
from ._text import LOWER, column, grams, mix, prefix_hash, slices, span_hash, stored, words

K = 4
THRESHOLD = 0.8
KEYS, SKETCH, LIST = 16, 32, 32
LEAST_ESTIMATE = 0.5
LEADERS = 3
SALTS = 16
BLOCK = 1024
BROADCAST_ROWS = 4 << 20
IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text one after another, and where each text's start."""
    data = LOWER[data]
    start, end, first = words(data, off, IS_WORD)
    h = span_hash(prefix_hash(data), start, end)
    n = np.diff(first)
    g = grams(h, k)
    count = np.maximum(n - k + 1, 0)
    at = np.arange(int(count.sum())) + np.repeat(first[:-1] - (np.cumsum(count) - count), count)
    text, value = np.repeat(np.arange(len(n)), count), g[at]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):  # the whole sequence, told apart from longer ones by its length
        whole = np.array([mix(np.array([sum(int(x) * pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i, x in enumerate(h[first[t] : first[t + 1]])) + int(n[t]) & (1 << 64) - 1], np.uint64))[0] for t in short.tolist()], np.uint64)
        text, value = np.concatenate([text, short]), np.concatenate([value, whole])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    text, value = text[new], value[new]
    return value, np.searchsorted(text, np.arange(len(n) + 1))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, size of the set, two sums that name the set, retained values, sketch (upper halves)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in slices(batches):
            v, at = shingles(data, off, k)
            n = np.diff(at)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (mix(v), mix(v ^ np.uint64(0xA5A5A5A55A5A5A5A)))]
            s1, s2 = ((x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums)
            keys = [v[a : a + min(c, KEYS)].view(np.int64) for a, c in zip(at[:-1].tolist(), n.tolist(), strict=True)]
            sketch = [(v[a : a + min(c, SKETCH)] >> np.uint64(32)).astype("<u4").tobytes() for a, c in zip(at[:-1].tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array(n.astype(np.int64)), pa.array(s1), pa.array(s2), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["doc_id", "n", "s1", "s2", "keys", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, keys array<long>, sketch binary")


def estimate(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> float:
    """Jaccard estimate from the sketch of the union."""
    u = np.union1d(a, b)
    full = len(a) >= na and len(b) >= nb
    u = u if full else u[:SKETCH]
    both = np.intersect1d(a, b, assume_unique=False)
    return float(np.isin(u, both).sum()) / max(1, len(u))


def list_pairs(postings: DataFrame) -> DataFrame:
    """(a, b, est) for the pairs in each short list that pass the estimate."""
    lists = postings.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("rep", "n", "sketch"))).alias("m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for m in b.m:
                s = [np.frombuffer(r["sketch"], "<u4") for r in m]
                for i in range(len(m)):
                    for j in range(i + 1, len(m)):
                        x, y = m[i]["n"], m[j]["n"]
                        if min(x, y) >= THRESHOLD * max(x, y) and (e := estimate(s[i], s[j], x, y)) >= LEAST_ESTIMATE:
                            out.append((m[i]["rep"], m[j]["rep"], e))
            if out:
                yield pd.DataFrame(out, columns=["a", "b", "est"])

    return lists.mapInPandas(run, "a long, b long, est double")


def leader_pairs(hot: DataFrame) -> DataFrame:
    """(a, b, est): every member of a long list with a few leaders of it."""
    order = [F.col("rep"), *(F.xxhash64(F.lit(i), "v", "rep") for i in range(1, LEADERS))]
    tops = hot.groupBy("v").agg(*(F.min(F.struct(o.alias("o"), "rep", "n", "sketch")).alias(f"l{i}") for i, o in enumerate(order)))
    tops = tops.select("v", F.explode(F.array(*(F.struct(*(F.col(f"l{i}.{c}").alias(c) for c in ("rep", "n", "sketch"))) for i in range(len(order))))).alias("l"))
    # A list is dealt over several tasks.
    tops = tops.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = hot.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(tops, ["v", "salt"]).filter("rep != l.rep").filter(F.least("n", "l.n") >= THRESHOLD * F.greatest("n", "l.n"))
    met = met.select("rep", "n", "sketch", F.col("l.rep").alias("r2"), F.col("l.n").alias("n2"), F.col("l.sketch").alias("s2"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            e = np.array([estimate(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), n, m) for x, y, n, m in zip(b.sketch, b.s2, b.n, b.n2, strict=True)])
            p = pd.DataFrame({"a": np.minimum(b.rep, b.r2), "b": np.maximum(b.rep, b.r2), "est": e})
            yield p[p.est >= LEAST_ESTIMATE].drop_duplicates()

    return met.mapInPandas(run, "a long, b long, est double")


def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, set) of the documents named; the names are broadcast only while they are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in slices(batches):
            v, at = shingles(data, off, k)
            yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array([v[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], ["id", "set"])

    ids = stored(ids, "wanted")
    few = ids.count() <= BROADCAST_ROWS
    return stored(docs.join(F.broadcast(ids) if few else ids, docs.doc_id == ids.id, "left_semi").mapInArrow(run, "id long, set binary"), "sets")


def only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the ids, which are broadcast only while they are few."""
    ids = stored(ids.select(F.col("id").alias(key)).distinct(), "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids.hint("merge"), key, "left_semi")


def linked(i: int, x: int, y: int) -> bool:
    return 100 * i >= 80 * (x + y - i)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are links."""
    x, y = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    met = pairs.select("a", "b").join(x.hint("merge"), "a").join(y.hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(column(batch, "x"), column(batch, "y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                ok.append(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return met.mapInArrow(run, "b long, a long" if met.columns[0] == "b" else "a long, b long")


def parity(values: np.ndarray) -> bytes:
    """A bit for each of 2 to 4 times as many places as values: whether an odd number of them falls there."""
    places = 64
    while places < 2 * len(values):
        places *= 2
    odd = np.bincount((values & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parities(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, size of the set, bits) of the documents named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in slices(batches):
            v, at = shingles(data, off, k)
            yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array([parity(v[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], ["id", "n", "bits"])

    return stored(only(docs, ids, "doc_id").select("doc_id", "text").mapInArrow(run, "id long, n long, bits binary"), "parities")


def folded(bits: np.ndarray, places: int) -> np.ndarray:
    """Rows of bits (as 64-bit words) over fewer places."""
    while bits.shape[1] * 64 > places:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def possible(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs (a, b, est) whose bits do not rule out a link."""
    x, y = (bits.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in ("a", "b"))
    met = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "est", "n_a", "n_b", "bits_a", "bits_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for n, m, x, y in zip(*(column(batch, c) for c in ("n_a", "n_b", "bits_a", "bits_b")), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "<u8").reshape(1, -1) for v in (x, y))
                places = 64 * min(x.shape[1], y.shape[1])
                ok.append(9 * int(np.bitwise_count(folded(x, places) ^ folded(y, places)).sum(dtype=np.int64)) <= n.as_py() + m.as_py())
            yield batch.select(["a", "b", "est"]).filter(pa.array(ok, pa.bool_()))

    return met.mapInArrow(run, "a long, b long, est double")


def maybe_linked(rows: pd.DataFrame, cols: pd.DataFrame) -> pd.DataFrame:
    """(a, b, ca, cb, diff): the pairs of different components whose bits do not rule out a link. Linked sets of n and m
    values differ in (n + m) / 9 values at most."""
    out = []
    of = lambda x: np.frombuffer(b"".join(x), "<u8").reshape(len(x), -1)
    for (_, mine), (_, theirs) in ((x, y) for x in rows.groupby(rows.bits.map(len)) for y in cols.groupby(cols.bits.map(len)) if x[0] <= 2 * y[0] and y[0] <= 2 * x[0]):
        x, y = of(mine.bits), of(theirs.bits)
        places = 64 * min(x.shape[1], y.shape[1])
        x, y = folded(x, places), folded(y, places)
        m, comp, ids = theirs.n.to_numpy(), theirs.component.to_numpy(), theirs.rep.to_numpy()
        for rep, n, component, bits in zip(mine.rep.tolist(), mine.n.tolist(), mine.component.tolist(), x, strict=True):
            diff = np.bitwise_count(y ^ bits).sum(1, dtype=np.int64)
            hit = np.flatnonzero((9 * diff <= n + m) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (comp != component))
            if len(hit):
                out.append(pd.DataFrame({"a": rep, "b": ids[hit], "ca": component, "cb": comp[hit], "diff": diff[hit]}))
    return pd.concat(out) if out else pd.DataFrame(columns=["a", "b", "ca", "cb", "diff"]).astype("int64")


def minor_links(hot: DataFrame, label: DataFrame, docs: DataFrame, k: int, bits: DataFrame | None = None) -> DataFrame | None:
    """Links between classes outside their long list's largest component and any member of the list; between components
    that links join already, not all."""
    tagged = stored(hot.select("v", "rep", "n").join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "tagged")
    sizes = tagged.groupBy("v", "component").agg(F.count("*").alias("c")).groupBy("v").agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("parts")).filter("parts > 1")
    split = tagged.join(sizes.select("v", F.col("top.component").alias("main")), "v")
    minor = stored(split.filter(F.col("component") != F.col("main")).drop("main"), "minor")
    if minor.isEmpty():
        return None
    lists = minor.select("v").distinct()
    cols = stored(tagged.join(lists, "v", "left_semi"), "columns")
    bits = bits if bits is not None else parities(docs, cols.select(F.col("rep").alias("id")), k)
    bits = bits.select(F.col("id").alias("rep"), "bits")

    def parts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("v").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    per = stored(parts(minor, "rn").join(parts(cols, "cn"), "v"), "blocks")
    per = F.broadcast(per) if per.count() <= BROADCAST_ROWS // 8 else per
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shown = [F.col(c).alias(c) for c in ("rep", "n", "component", "bits")]
    left = minor.join(per, "v").join(bits, "rep").select(F.col("v").alias("v"), block("rn").alias("rb"), every("cn").alias("cb"), *shown)
    right = cols.join(per, "v").join(bits, "rep").select(F.col("v").alias("v"), every("rn").alias("rb"), block("cn").alias("cb"), *shown)
    found = left.groupBy("v", "rb", "cb").cogroup(right.groupBy("v", "rb", "cb")).applyInPandas(maybe_linked, "a long, b long, ca long, cb long, diff long")
    found = stored(found.distinct(), "candidates")
    if found.isEmpty():
        return None
    # First the nearest pair of each class and each component, then what is between components that are still apart.
    sets = full_sets(docs, found.select(F.explode(F.array("a", "b")).alias("id")).distinct(), k)
    first = stored(found.groupBy("a", "ca", "cb").agg(F.min(F.struct("diff", "b")).alias("m")).select("a", F.col("m.b").alias("b"), "ca", "cb"), "nearest")
    one = stored(verify(first, sets).select("a", "b"), "links")
    joined = components(one.join(first, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    mine, theirs = (joined.select(F.col("node").alias(c), F.col("component").alias(f"{c}_root")) for c in ("ca", "cb"))
    rest = found.join(first.select("a", "b"), ["a", "b"], "left_anti").join(mine, "ca", "left").join(theirs, "cb", "left")
    rest = stored(rest.filter(F.coalesce("ca_root", "ca") != F.coalesce("cb_root", "cb")).select("a", "b"), "rest")
    two = stored(verify(rest, only(sets, rest.select(F.explode(F.array("a", "b")).alias("id")), "id")).select("a", "b"), "links")
    return one.unionByName(two)


def dedup(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = stored(signatures(docs, k), "signatures")
    real = sig.filter("n > 0 and doc_id is not null")
    classes = real.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"))
    reps = stored(real.join(classes.withColumnRenamed("rep", "doc_id").hint("merge"), ["s1", "s2", "n", "doc_id"], "left_semi").select(F.col("doc_id").alias("rep"), "n", "keys", "sketch"), "reps")
    # Entries travel without their sketches until it is known which lists they share with others.
    posts = reps.select("rep", F.posexplode("keys").alias("rank", "v"))
    sketches = reps.select("rep", "n", "sketch", F.size("keys").alias("have"))
    df = stored(posts.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "lists")
    short = stored(list_pairs(posts.join(df.filter(F.col("df") <= LIST).hint("merge"), "v", "left_semi").join(sketches.hint("merge"), "rep")).groupBy("a", "b").agg(F.max("est").alias("est")), "pairs")
    long_lists = df.filter(F.col("df") > LIST).select("v")
    hot = bits = None
    if not long_lists.isEmpty():
        hot = posts.join(long_lists.hint("merge"), "v", "left_semi").withColumn("hot", F.count("*").over(Window.partitionBy("rep")))
        hot = stored(hot.join(sketches.hint("merge"), "rep").filter(F.col("hot") * 2 > F.col("have")).drop("hot", "have"), "hot")
        bits = parities(docs, hot.select(F.col("rep").alias("id")), k)
        led = leader_pairs(hot).groupBy("a", "b").agg(F.max("est").alias("est"))
        pairs = stored(short.unionByName(possible(led, bits)).groupBy("a", "b").agg(F.max("est").alias("est")), "pairs")
    else:
        pairs = short
    sets = full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), k)
    best = pairs.select("a", "b", "est", F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.max(F.struct("est", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("m")).select((-F.col("m.a")).alias("a"), (-F.col("m.b")).alias("b")).distinct()
    edges = stored(verify(best, sets).select("a", "b"), "links")
    label = components(edges)
    one, two = label.select(F.col("node").alias("a"), F.col("component").alias("ca")), label.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    rest = pairs.join(best, ["a", "b"], "left_anti").join(one, "a", "left").join(two, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    rest = stored(rest.select("a", "b"), "rest")
    more = stored(verify(rest, only(sets, rest.select(F.explode(F.array("a", "b")).alias("id")), "id")).select("a", "b"), "links")
    edges = edges.unionByName(more)
    label = components(edges)
    if hot is not None:
        last = minor_links(hot, label, docs, k, bits)
        if last is not None:
            edges = edges.unionByName(last)
            label = components(edges)
    classes = classes.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    out = sig.join(classes, ["s1", "s2", "n"], "left")
    comp = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
