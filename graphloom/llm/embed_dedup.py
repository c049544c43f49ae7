"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, span a product grid; a vector belongs to the cell of its nearest
centroids. A search visits cells in order of the sum of both halves' distances (multi-sequence order). How many it
visits is set so that, for sample vectors turned by exactly the threshold angle in a random direction, the cell of the
turned vector is among them with probability TARGET; as both vectors of a pair search, fewer than 1 - TARGET of such
pairs are missed, and closer ones hardly ever. Every vector is indexed and every vector searches; what it meets
is verified by cosine in double precision.

Equal vectors are one class with a weight, so copies are never compared. Cells are cut into blocks of at most BLOCK
members and BLOCK searchers; a task compares one pair of blocks as matrices and returns counts for its rows and a
spanning forest of its links, so its output is linear in its rows whatever the links. A pair met from both sides counts
once.

Codebooks are fitted on at most SAMPLE vectors.

Defined cases: vectors that are null, all zero, or hold null, NaN or infinite components link with nothing; shorter
vectors are padded with zeros; rows that repeat a vec_id are other vectors with that id; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._text import stored

THRESHOLD = 0.9
TARGET = 0.95
SAMPLE = 20_000
BLOCK = 1024
PER_CELL = 512
MOST_CENTROIDS = 256


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (((c * c).sum(1))[None] - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[r.choice(len(x), int((n == 0).sum()))]
    return c


class Grid:
    def __init__(self, left: np.ndarray, right: np.ndarray, visits: int = 1):
        self.left, self.right, self.visits = left, right, visits

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.left.shape[1]
        d = []
        for part, c in ((x[:, :h], self.left), (x[:, h:], self.right)):
            d.append((part * part).sum(1)[:, None] - 2 * part @ c.T + (c * c).sum(1)[None])
        return d[0], d[1]

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.right) + b.argmin(1)

    def nearest(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The cells of the multi-sequence order, nearest first: rank i of one half meets rank j of the other only if
        (i + 1)(j + 1) is at most the number of visits."""
        a, b = self.distances(x)
        k1, k2 = len(self.left), len(self.right)
        visits = min(visits, k1 * k2)
        ia, ib = a.argsort(1, kind="stable")[:, :visits], b.argsort(1, kind="stable")[:, :visits]
        da, db = np.take_along_axis(a, ia, 1), np.take_along_axis(b, ib, 1)
        ij = np.array([(i, j) for i in range(min(visits, k1)) for j in range(min(visits // (i + 1), k2))])
        out = np.empty((len(x), visits), np.int64)
        for s in range(0, len(x), 2048):
            sums = da[s : s + 2048, ij[:, 0]] + db[s : s + 2048, ij[:, 1]]
            best = sums.argsort(1, kind="stable")[:, :visits]
            out[s : s + 2048] = np.take_along_axis(ia[s : s + 2048], ij[best, 0], 1) * k2 + np.take_along_axis(ib[s : s + 2048], ij[best, 1], 1)
        return out


def fit(sample: np.ndarray, n: int, threshold: float = THRESHOLD, target: float = TARGET, seed: int = 9) -> Grid:
    k = int(min(MOST_CENTROIDS, max(2, math.ceil(math.sqrt(n / PER_CELL)))))
    half = sample.shape[1] // 2
    grid = Grid(kmeans(sample[:, :half], k, seed), kmeans(sample[:, half:], k, seed + 1))
    r = np.random.default_rng(seed + 2)
    x = sample[r.choice(len(sample), min(len(sample), 4000), replace=False)]
    noise = r.normal(size=x.shape)
    noise -= (noise * x).sum(1)[:, None] * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-300)[:, None]
    cell = grid.cell(threshold * x + math.sqrt(1 - threshold**2) * noise)
    order = grid.nearest(x, k * k)
    rank = np.sort((order == cell[:, None]).argmax(1))
    grid.visits = int(rank[min(len(rank) - 1, math.ceil(target * len(rank)))]) + 1
    return grid


def unit(blobs: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), "<f4").reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def forest(link: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the same rows and columns as the links do, at most one a row and column.

    A first pass links each row with its first column; rows that meet in one column follow from it.
    """
    out, parent = [], {}

    def root(v: tuple) -> tuple:
        while parent.get(v, v) != v:
            parent[v] = parent.get(parent[v], parent[v])
            v = parent[v]
        return v

    seen: dict[bytes, int] = {}
    for i in np.flatnonzero(link.any(1)).tolist():
        pattern = np.packbits(link[i]).tobytes()
        js = np.flatnonzero(link[i])
        if pattern in seen:
            js = js[:1]  # the columns are joined already
        seen[pattern] = i
        for j in js.tolist():
            a, b = root((0, i)), root((1, j))
            if a != b:
                parent[a] = b
                out.append((int(rows[i]), int(cols[j])))
    return out


def links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<float>").alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    good = v.withColumn("ok", fine)
    valid = good.filter("ok").select("vec_id", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0).cast("float")).otherwise(x)).alias("v"))
    size = valid.agg(F.max(F.size("v")), F.count("*")).first()
    if not size[1]:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = size[0]
    padded = F.concat("v", F.array_repeat(F.lit(0.0).cast("float"), F.lit(dim) - F.size("v")))
    valid = valid.withColumn("v", padded)
    classes = stored(valid.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w")), "vectors")
    n = classes.count()
    head = classes.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(SAMPLE).toPandas()
    grid = fit(unit([np.asarray(x, "<f4").tobytes() for x in head.v], dim), n, threshold, target)
    sent = spark.sparkContext.broadcast(grid)
    kcells = len(grid.left) * len(grid.right)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = sent.value
        for b in batches:
            for a in range(0, len(b), 4096):
                p = b.iloc[a : a + 4096]
                raw = [np.asarray(x, "<f4").tobytes() for x in p.v]
                x = unit(raw, dim)
                probes = g.nearest(x, g.visits).astype("<i4")
                yield pd.DataFrame({"rep": p.rep, "w": p.w, "vec": raw, "cell": g.cell(x), "probes": [r.tobytes() for r in probes], "visits": list(probes)})

    placed = stored(classes.mapInPandas(place, "rep long, w long, vec binary, cell long, probes binary, visits array<int>"), "placed")
    members = placed.select("cell", "rep", "w", "vec", "probes")
    searchers = placed.select(F.explode(F.col("visits").cast("array<long>")).alias("cell"), F.col("rep").alias("srep"), F.col("w").alias("sw"), F.col("vec").alias("svec"), F.col("cell").alias("own"))

    def blocks(rows: DataFrame) -> DataFrame:
        """Number of blocks of each cell: at most one row a cell of the grid."""
        return rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))

    per = blocks(members).withColumnRenamed("n", "mn").join(blocks(searchers).withColumnRenamed("n", "sn"), "cell")
    per = F.broadcast(stored(per, "cells"))
    mine = F.pmod(F.xxhash64("rep"), F.col("mn")).cast("int"), F.pmod(F.xxhash64("srep"), F.col("sn")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("sn") - 1)), F.explode(F.sequence(F.lit(0), F.col("mn") - 1))
    m = members.join(per, "cell").select("cell", mine[0].alias("mb"), every[0].alias("sb"), "rep", "w", "vec", "probes")
    s = searchers.join(per, "cell").select("cell", every[1].alias("mb"), mine[1].alias("sb"), "srep", "sw", "svec", "own")
    least = threshold

    def compare(mem: pd.DataFrame, sea: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"rep": np.zeros(0, np.int64), "k": np.zeros(0, np.int64), "other": pd.array([], "Int64")})
        if not len(mem) or not len(sea):
            return none
        mr, sr, mw, sw = mem.rep.to_numpy(), sea.srep.to_numpy(), mem.w.to_numpy(), sea.sw.to_numpy()
        link = unit(list(sea.svec), dim) @ unit(list(mem.vec), dim).T >= least
        link &= sr[:, None] != mr[None]
        some = np.flatnonzero(link.any(1))
        if not len(some):
            return none
        # If the member's own search comes to the searcher's cell, both meet twice: the smaller id counts.
        own, probes = sea.own.to_numpy(), np.frombuffer(b"".join(mem.probes), "<i4").reshape(len(mem), -1)
        back = np.zeros_like(link)
        for o in np.unique(own[some]).tolist():
            back[np.flatnonzero(own == o)] = (probes == o).any(1)[None]
        counted = link & (~back | (sr[:, None] < mr[None]))
        one, two, edges = counted @ mw, counted.T @ sw, np.array(forest(counted, sr, mr), np.int64).reshape(-1, 2)
        ids = np.concatenate([sr[one > 0], mr[two > 0], edges[:, 0]])
        k = np.concatenate([one[one > 0], two[two > 0], np.zeros(len(edges), np.int64)])
        other = pd.array([None] * (len(ids) - len(edges)) + edges[:, 1].tolist(), "Int64")
        return pd.DataFrame({"rep": ids, "k": k, "other": other})

    pairs = m.groupBy("cell", "mb", "sb").cogroup(s.groupBy("cell", "mb", "sb"))
    found = stored(pairs.applyInPandas(compare, "rep long, k long, other long"), "links")
    counts = found.groupBy("rep").agg(F.sum("k").alias("k"))
    comp = components(found.filter("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    of_class = classes.join(counts, "rep", "left").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    of_class = of_class.select("v", (F.coalesce("k", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    key = F.xxhash64("v")
    out = valid.withColumn("key", key).join(of_class.withColumn("key", key), ["key", "v"]).select("vec_id", "n_links", "component_id")
    alone = good.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
