"""Benchmark decontamination by winnowing.

Both sides are cut into words; of every WINDOW - K + 1 consecutive K-word hashes the smallest is kept, so any shared run
of WINDOW words shares a kept fingerprint. Fingerprints of the documents are joined with those of the test items, each
hit is extended to the windows that contain it, and a window counts only if its words equal an item's words. Items
shorter than a window are looked up whole, by hashes of exactly their length.

The test side is taken in blocks of at most BLOCK_BYTES, each sent to the executors; more blocks mean more passes, never
a larger broadcast.

Defined cases: null and empty texts have no words; texts of any length are searched whole; items without words never occur;
items that repeat count once by item_id, and an item without one marks words but has no name to list; rows that repeat, or
have a null doc_id, are judged one by one; equal fingerprints (ties) are all kept; other columns, whatever their names, are
ignored; without items, nothing is contaminated; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ._text import LOWER, column, flat, grams, prefix_hash, slices, sliding, span_hash, stored, words

WINDOW, K = 10, 5
BLOCK_BYTES = 4 << 20
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def kept(g: np.ndarray, w: int) -> np.ndarray:
    """Which entries are the smallest of some w consecutive ones (all of them, on ties)."""
    if len(g) < w:
        return np.zeros(len(g), bool)
    low = sliding(np.minimum, g, w)
    pad = np.concatenate([np.zeros(w - 1, g.dtype), low, np.zeros(w - 1, g.dtype)])
    return sliding(np.maximum, pad, w) == g


class Index:
    """Fingerprints and exact windows of one block of test items."""

    def __init__(self, items: list[tuple[int, str | None]]):
        data, off = flat(pa.array([t for _, t in items], pa.large_string()))
        data = LOWER[data]
        start, end, first = words(data, off, IS_WORD)
        h = span_hash(prefix_hash(data), start, end)
        prints, by_len = [], {}
        self.exact: dict[bytes, set] = {}
        for i, (item, _) in enumerate(items):
            a, b = int(first[i]), int(first[i + 1])
            m = min(WINDOW, b - a)
            if not m:
                continue
            toks = [data[s:e].tobytes() for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
            for j in range(b - a - m + 1):
                self.exact.setdefault(b" ".join(toks[j : j + m]), set()).add(item)
            by_len.setdefault(m, []).append(grams(h[a:b], m))
            if m == WINDOW:
                g = grams(h[a:b], K)
                prints.append(g[kept(g, WINDOW - K + 1)])
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.whole = {m: np.unique(np.concatenate(g)) for m, g in by_len.items()}

    def search(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, set]]]:
        """Words of each text, and every window found: text, first word, words, items."""
        data = LOWER[data]
        start, end, first = words(data, off, IS_WORD)
        h = span_hash(prefix_hash(data), start, end)
        found = []
        for m, keys in self.whole.items():
            g = grams(h, m)
            if not len(g):
                continue
            if m == WINDOW:
                k = grams(h, K)
                hit = np.flatnonzero(kept(k, WINDOW - K + 1))
                # A window of one text may lie beside another text, whose grams are smaller: each text's own windows
                # are winnowed as if alone where its border is near.
                near = self._borders(k, first, WINDOW - K + 1)
                hit = np.union1d(hit, near) if len(near) else hit
                hit = hit[_in(k[hit], self.prints)]
                at = np.unique((hit[:, None] - np.arange(WINDOW - K + 1)[None, :]).ravel())
                at = at[(at >= 0) & (at < len(g))]
                at = at[_in(g[at], keys)]
            else:
                at = np.flatnonzero(_in(g, keys))
            text = np.searchsorted(first, at, "right") - 1
            whole = at + m <= first[text + 1]
            for p, t in zip(at[whole].tolist(), text[whole].tolist(), strict=True):
                items = self.exact.get(b" ".join(data[s:e].tobytes() for s, e in zip(start[p : p + m].tolist(), end[p : p + m].tolist(), strict=True)))
                if items:
                    found.append((t, p - int(first[t]), m, items))
        return np.diff(first), found

    def _borders(self, k: np.ndarray, first: np.ndarray, w: int) -> np.ndarray:
        """Positions a window at a text's border would keep; any gram within w of a border is taken."""
        edge = first[1:-1]
        at = (edge[:, None] + np.arange(-w - K, w)[None, :]).ravel()
        return np.unique(at[(at >= 0) & (at < len(k))])


def _in(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys) or not len(x):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int, str | None]]]:
    """The test items in blocks of bounded size; the driver holds one at a time (a longer item is a block)."""
    block, size = [], 0
    for r in benchmark.select(id_col, text_col).toLocalIterator():
        n = len((r[1] or "").encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """For every document: its words, the word ranges hit (merged), the items found, and the columns to keep."""
    spark = docs.sparkSession
    few = int(benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]) <= block_bytes
    keep = list(keep or [id_col])
    docs = docs.select(*keep, F.col(text_col).alias("_text"))
    if not few:
        docs = stored(docs.withColumn("_uid", F.monotonically_increasing_id()), "decontam")
        keep.append("_uid")
    span = StructType([StructField("s", IntegerType()), StructField("e", IntegerType())])
    schema = StructType([docs.schema[c] for c in keep] + [StructField("n_words", LongType()), StructField("spans", ArrayType(span)), StructField("items", ArrayType(StringType()))])

    def one(block: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value)
            for rows, data, off in slices(batches, "_text"):
                n, found = index.search(data, off)
                spans, items = [[] for _ in n], [set() for _ in n]
                for t, p, m, got in sorted(found, key=lambda x: (x[0], x[1], x[2])):
                    s = spans[t]
                    if s and p <= s[-1]["e"]:
                        s[-1]["e"] = max(s[-1]["e"], p + m)
                    else:
                        s.append({"s": p, "e": p + m})
                    items[t] |= got
                cols = [column(rows, c) for c in keep]
                cols += [pa.array(n.astype(np.int64)), pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array([sorted(str(i) for i in x if i is not None) for x in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, [*keep, "n_words", "spans", "items"])

        return docs.mapInArrow(run, schema)

    out = None
    for block in blocks(benchmark, item_col, item_text, block_bytes):
        out = one(block) if out is None else out.unionByName(one(block))
    if out is None:
        out = one([])
    if few:
        return out
    merged = out.groupBy(*keep).agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    start = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    fold = F.aggregate(
        "spans",
        start,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return merged.withColumn("spans", fold).drop("_uid")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["e"] - x["s"]))
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans")
