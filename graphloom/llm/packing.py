"""Best-fit-decreasing packing of token pieces into sequences of a fixed length.

Best-fit decreasing needs only how many pieces there are of each length, and lengths are bounded by the capacity. So
the driver runs it over run lengths: bins with the same history form one group, a segment tree over remaining
capacities finds the tightest open group in logarithmic time, and one step places as many pieces as the group has bins
or the length has pieces left. The plan maps (length, rank among that length) to (sequence, offset); its size depends on
the capacity, not on the corpus. Ranks come from counts by (partition, length) and a running sum.

A document longer than the capacity is cut into capacity-sized pieces, the remainder first.

Defined cases: null text is empty (the end id alone); a text of any length is cut into pieces; a marker string of the
vocabulary within a text is its own id, as the library reads it; a null doc_id is packed like any other and stays null;
pieces of one length are ties, ranked by task and place; rows that repeat are packed as often as they come; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import column, slices, stored
from ._tok import default_path, encoder

CAPACITY = 2048


class Tightest:
    """Segment tree over remaining capacities: which is the smallest one >= x that has an open group."""

    def __init__(self, capacity: int):
        self.n = 1
        while self.n <= capacity:
            self.n *= 2
        self.open = np.zeros(2 * self.n, np.int64)

    def add(self, r: int, by: int) -> None:
        r += self.n
        while r:
            self.open[r] += by
            r //= 2

    def find(self, x: int) -> int:
        """-1 if there is none."""
        i = x + self.n
        if self.open[i]:
            return x
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.n
            i //= 2
        return -1


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, offset): piece number r of that length goes to sequence
    first + r - first rank, at that offset."""
    tree, groups, rows, used = Tightest(capacity), [[] for _ in range(capacity + 1)], [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            r = tree.find(length)
            if r < 0:
                per = capacity // length  # a new bin takes as many of this length as fit, one after another
                bins = left // per or 1
                many = min(left, per)
                for k in range(many):
                    rows.append((length, rank, rank + bins, used, k * length))
                    rank += bins
                left -= bins * many
                rest, first, used = capacity - many * length, used, used + bins
                if rest:
                    groups[rest].append((first, bins))
                    tree.add(rest, 1)
                continue
            first, bins = groups[r].pop()
            tree.add(r, -1)
            take = min(bins, left)
            rows.append((length, rank, rank + take, first, capacity - r))
            rank, left = rank + take, left - take
            if take < bins:
                groups[r].append((first + take, bins - take))
                tree.add(r, 1)
            if r > length:
                groups[r - length].append((first, take))
                tree.add(r - length, 1)
    return rows


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece, with the task that made it and its rank there among pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, pid = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for rows, data, off in slices(batches):
            ids, first = enc(data, off)
            n = len(off) - 1
            out = np.full(len(ids) + n, end_id, "<u4")
            out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(first))] = ids
            at = first + np.arange(n + 1)
            size = np.diff(at)
            parts = -(-size // capacity)
            doc = np.repeat(np.arange(n), parts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            head = size - (parts - 1) * capacity
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[doc], capacity)
            lo = at[doc] + start
            crc = [zlib.crc32(out[a : a + b]) for a, b in zip(lo.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            by = length[order]
            run_first = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
            within = np.arange(len(by)) - np.repeat(run_first, np.diff(np.append(run_first, len(by))))
            rank = np.empty(len(by), np.int64)
            rank[order] = seen[by] + within
            seen += np.bincount(length, minlength=capacity + 1)
            cols = [column(rows, "doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), pid, np.int32)), pa.array(rank)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "pid", "local"]
            if with_ids:
                cols.append(pa.array([out[a : a + b].astype(np.int32) for a, b in zip(lo.tolist(), length.tolist(), strict=True)], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, local long" + (", ids array<int>" if with_ids else ""))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    made = stored(pieces(docs, tokenizer or default_path(), capacity, end_id, id_col, text_col, with_ids), "pieces")
    counts = made.groupBy("length", "pid").agg((F.max("local") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "pid", "base")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(total, capacity)
    where = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "length long, r0 long, r1 long, s0 long, offset long")
    # One row of ranges for each length: at most as many as the capacity, each a bounded list.
    where = where.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("r0", "r1", "s0", "offset"))).alias("steps"))
    ranked = made.join(ranks, ["length", "pid"]).withColumn("rank", F.col("base") + F.col("local"))
    step = F.filter("steps", lambda s: (s["r0"] <= F.col("rank")) & (F.col("rank") < s["r1"]))[0]
    placed = ranked.join(F.broadcast(where), "length").withColumn("step", step)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("step.s0") + F.col("rank") - F.col("step.r0")).alias("sequence_id"), F.col("step.offset").alias("offset"), *(["ids"] if with_ids else []))
