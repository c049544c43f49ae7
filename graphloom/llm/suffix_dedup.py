"""Removal of repeated byte strings, by suffix arrays over shards.

A byte goes if a string of SPAN bytes covers it that also starts in a document with a smaller doc_id; matches never
cross documents and are judged on the input.

Every SPAN-byte window has an anchor: the smallest of the hashed ANCHOR-byte strings in it, the leftmost on ties. Equal
windows have equal anchors, so dealing windows by anchor brings equal windows together. Windows in a row with one anchor
travel as one run of at most 2 * SPAN - ANCHOR bytes. Work goes in four passes over blocks of text, which are packed
once, compressed, into the shared folder:

1. anchors, distinct within a block, to shards; shards answer, in bits, which occur in more than one document;
2. runs with such anchors, distinct within a block, with the smallest doc_id that has them, to shards;
3. each shard joins its distinct runs, builds their suffix array by induced sorting and the permuted common prefixes;
   neighbours that agree in SPAN bytes are one string, and the smallest doc_id of each string answers every window;
4. the answers mark the bytes of each document.

A block sends a run once however many of its documents hold it, so a passage of a third of all documents is as many
rows as there are blocks. Shards number with the input.

Defined cases: null text is empty; texts shorter than SPAN keep everything; a text of any length is in one block; rows with
one doc_id, also rows that repeat, never remove each other's bytes; a null doc_id counts as the largest there is, ties with
that one included, and stays null; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import column, mix, powers, prefix_hash, slices, sliding, stored, total_bytes
from .suffix_array import common_prefixes, suffix_array

SPAN, ANCHOR = 50, 24
BLOCK_BYTES = 2 << 20
SHARD_BYTES = 8 << 20
PARTS = 16  # a shard is worked on in so many parts, again by anchor, to bound memory
POS_BITS = 26
NULL_ID = np.iinfo(np.int64).max


class Runs:
    """The windows of a block in runs of one anchor: first window, windows, anchor hash, text."""

    def __init__(self, data: np.ndarray, off: np.ndarray, span: int, anchor: int):
        self.data, self.off, w = data, off, span - anchor + 1
        n = len(data) - anchor + 1
        empty = np.zeros(0, np.int64)
        self.start, self.count, self.hash, self.text = empty, empty, np.zeros(0, np.uint64), empty
        if n < w:
            return
        s = prefix_hash(data)
        h = mix((s[anchor:] - s[:-anchor]) * powers(len(s))[1][:n])
        self.sums = s
        size = np.diff(off)
        text = np.repeat(np.arange(len(size)), np.maximum(size - span + 1, 0))
        first = np.cumsum(np.maximum(size - span + 1, 0)) - np.maximum(size - span + 1, 0)
        q = np.arange(len(text)) - first[text] + off[:-1][text]
        if not len(q):
            return
        mask = np.uint64((1 << POS_BITS) - 1)
        at = np.empty(len(h) - w + 1, np.int64)
        step = (1 << POS_BITS) - w
        for a in range(0, len(at), step):
            part = h[a : a + step + w - 1]
            low = sliding(np.minimum, (part & ~mask) | np.arange(len(part), dtype=np.uint64), w)
            at[a : a + len(low)] = (low & mask).astype(np.int64) + a
        anchor_at = at[q]
        new = np.ones(len(q), bool)
        new[1:] = (anchor_at[1:] != anchor_at[:-1]) | (text[1:] != text[:-1])
        i = np.flatnonzero(new)
        self.start, self.count, self.hash, self.text = q[i], np.diff(np.append(i, len(q))), h[anchor_at[i]], text[i]

    def keep(self, chosen: np.ndarray) -> None:
        self.start, self.count, self.hash, self.text = (x[chosen] for x in (self.start, self.count, self.hash, self.text))


def sorted_anchors(runs: Runs, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors by shard and value; for each whether several texts have it; where each shard's begin; and the
    index of every run's anchor."""
    u, inv = np.unique(runs.hash, return_inverse=True)
    lo, hi = np.full(len(u), 1 << 62), np.full(len(u), -1)
    np.minimum.at(lo, inv, runs.text)
    np.maximum.at(hi, inv, runs.text)
    shard = (u % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    back = np.empty(len(u), np.int64)
    back[order] = np.arange(len(u))
    return u[order], (hi > lo)[order], np.searchsorted(shard[order], np.arange(shards + 1)), back[inv]


def distinct_runs(runs: Runs, doc: np.ndarray, shards: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs by shard: an example of each, the smallest doc_id that has it, where shards begin, index by run."""
    size = runs.count + span - 1
    s = runs.sums
    content = mix((s[runs.start + size] - s[runs.start]) * powers(len(s))[1][runs.start] + size.astype(np.uint64))
    shard = runs.hash % np.uint64(shards)
    order = np.lexsort((doc[runs.text], content, runs.hash, shard))
    c, h = content[order], runs.hash[order]
    new = np.ones(len(order), bool)
    new[1:] = (c[1:] != c[:-1]) | (h[1:] != h[:-1])
    example = order[new]
    index = np.empty(len(order), np.int64)
    index[order] = np.cumsum(new) - 1
    return example, doc[runs.text[example]], np.searchsorted(shard[example], np.arange(shards + 1).astype(np.uint64)), index


def shard_masks(data: np.ndarray, lengths: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
    """For each run (bytes, length, smallest doc_id): a bit for every window that also starts in a smaller document."""
    start = np.cumsum(lengths) - lengths
    view = data.tobytes()
    seen: dict[bytes, int] = {}
    which = np.fromiter((seen.setdefault(view[a : a + n], len(seen)) for a, n in zip(start.tolist(), lengths.tolist(), strict=True)), np.int64, len(start))
    segments = list(seen)
    size = np.fromiter(map(len, segments), np.int64, len(segments))
    least = np.full(len(segments), NULL_ID)
    np.minimum.at(least, which, doc)
    text = np.frombuffer(b"".join(segments), np.uint8).astype(np.int16) + 1
    first = np.cumsum(size + 1) - (size + 1)
    t = np.zeros(int((size + 1).sum()) + 1, np.int16)
    t[np.arange(len(text)) + np.repeat(np.arange(len(segments)), size)] = text
    sa = suffix_array(t, 257)
    same = common_prefixes(t, sa, first, size, span)[sa] >= span
    windows = size - span + 1
    at = np.arange(int(windows.sum())) + np.repeat(first - (np.cumsum(windows) - windows), windows)
    owner = np.full(len(t), -1, np.int64)
    owner[at] = np.repeat(np.arange(len(segments)), windows)
    group = np.cumsum(~same) - 1
    smallest = np.full(int(group[-1]) + 1, NULL_ID)
    real = owner[sa] >= 0
    np.minimum.at(smallest, group[real], least[owner[sa[real]]])
    answer = np.full(len(t), NULL_ID)
    answer[sa] = smallest[group]
    n = lengths - span + 1
    j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    hit = answer[np.repeat(first[which], n) + j] < np.repeat(doc, n)
    return np.bitwise_or.reduceat(np.where(hit, np.uint32(1) << j.astype(np.uint32), np.uint32(0)), np.cumsum(n) - n)


def pack_blocks(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        z, k = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32
        for rows, data, off in slices(batches, size=BLOCK_BYTES):
            ids = column(rows, "doc_id")
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.asarray(ids.fill_null(NULL_ID)).astype("<i8").tobytes()]), pa.array([np.asarray(ids.is_null()).tobytes()]), pa.array([off.astype("<i8").tobytes()]), pa.array([z.compress(data.tobytes())])], ["block", "ids", "no_id", "off", "data"])
            k += 1

    return docs.mapInArrow(run, "block long, ids binary, no_id binary, off binary, data binary")


def unpacked(row: dict, span: int, anchor: int) -> tuple[np.ndarray, Runs]:
    off = np.frombuffer(row["off"], "<i8")
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(1, int(off[-1]))), np.uint8) if off[-1] else np.zeros(0, np.uint8)
    return np.frombuffer(row["ids"], "<i8"), Runs(data, off, span, anchor)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}


def six(x: np.ndarray) -> bytes:
    """The upper six bytes of each value."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unsix(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def marked(bits: list | None, begin: np.ndarray) -> np.ndarray:
    """The shards' answers about a block's distinct anchors, in one array."""
    out = np.zeros(int(begin[-1]), bool)
    for r in bits or []:
        a, b = int(begin[r["shard"]]), int(begin[r["shard"] + 1])
        out[a:b] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=b - a).astype(bool)
    return out


def dedup(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte offsets), and the kept bytes."""
    if span - anchor + 1 > 32:
        raise ValueError("a run's windows must fit 32 bits")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shards = max(32, -(-total_bytes(docs) // SHARD_BYTES))
    blocks = stored(pack_blocks(docs), "blocks")

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids, runs = unpacked(row, span, anchor)
            u, multi, begin, _ = sorted_anchors(runs, shards)
            full, said = np.flatnonzero(np.diff(begin)), six(u)
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([row["block"]] * len(full), pa.int64()), pa.array([said[6 * begin[s] : 6 * begin[s + 1]] for s in full], pa.binary()), pa.array([np.packbits(multi[begin[s] : begin[s + 1]]).tobytes() for s in full], pa.binary())], ["shard", "block", "anchors", "multi"])

    def repeated(pdf: pd.DataFrame) -> pd.DataFrame:
        size = [len(x) // 6 for x in pdf.anchors]
        u, inv, n = np.unique(unsix(b"".join(pdf.anchors)), return_inverse=True, return_counts=True)
        own = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=p) for m, p in zip(pdf.multi, size, strict=True)]).astype(bool)
        any_multi = np.zeros(len(u), bool)
        any_multi[inv[own]] = True
        bits = np.split(((n > 1) | any_multi)[inv], np.cumsum(size)[:-1])
        out = pd.DataFrame({"block": pdf.block.to_numpy(), "shard": pdf.shard.to_numpy(), "bits": [np.packbits(b).tobytes() for b in bits]})
        return out[[b.any() for b in bits]]

    sent = blocks.mapInArrow(send_anchors, "shard int, block long, anchors binary, multi binary")
    bits = stored(sent.groupBy("shard").applyInPandas(repeated, "block long, shard int, bits binary"), "bits")

    def by_block(answers: DataFrame, value: str) -> DataFrame:
        return answers.groupBy("block").agg(F.collect_list(F.struct("shard", value)).alias(value))

    def send_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids, runs = unpacked(row, span, anchor)
            _, _, begin, index = sorted_anchors(runs, shards)
            runs.keep(marked(row["bits"], begin)[index])
            example, least, begin, _ = distinct_runs(runs, ids, shards, span)
            size = runs.count[example] + span - 1
            first = np.concatenate([[0], np.cumsum(size)])
            data = runs.data[np.arange(int(first[-1])) + np.repeat(runs.start[example] - first[:-1], size)]
            part = ((runs.hash[example] >> np.uint64(40)) % np.uint64(PARTS)).astype(np.uint8)
            full = np.flatnonzero(np.diff(begin))
            cut = [(int(begin[s]), int(begin[s + 1])) for s in full]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), pa.array([row["block"]] * len(full), pa.int64()), pa.array([part[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([data[first[a] : first[b]].tobytes() for a, b in cut], pa.binary()), pa.array([size[a:b].astype(np.uint8).tobytes() for a, b in cut], pa.binary()), pa.array([least[a:b].astype("<i8").tobytes() for a, b in cut], pa.binary())],
                ["shard", "block", "part", "data", "size", "least"],
            )

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        part, size = (np.frombuffer(b"".join(pdf[c]), np.uint8) for c in ("part", "size"))
        data, least = np.frombuffer(b"".join(pdf.data), np.uint8), np.frombuffer(b"".join(pdf.least), "<i8")
        size = size.astype(np.int64)
        first, masks = np.cumsum(size) - size, np.zeros(len(size), "<u4")
        for p in range(PARTS):
            i = np.flatnonzero(part == p)
            if len(i):
                n = size[i]
                masks[i] = shard_masks(data[np.arange(int(n.sum())) + np.repeat(first[i] - (np.cumsum(n) - n), n)], n, least[i], span)
        cut = np.cumsum(pdf.part.map(len).to_numpy())[:-1]
        return pd.DataFrame({"block": pdf.block.to_numpy(), "shard": pdf.shard.to_numpy(), "masks": [m.tobytes() for m in np.split(masks, cut)]})

    runs_sent = blocks.join(by_block(bits, "bits"), "block").mapInArrow(send_runs, "shard int, block long, part binary, data binary, size binary, least binary")
    masks = stored(runs_sent.groupBy("shard").applyInPandas(answer, "block long, shard int, masks binary"), "masks")
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s:long,e:long>>" + (", kept_bytes binary" if with_text else "")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids, runs = unpacked(row, span, anchor)
            off, gone = runs.off, np.zeros(len(runs.data) + 1, np.int64)
            if row["bits"] and row["masks"]:
                _, _, begin, index = sorted_anchors(runs, shards)
                runs.keep(marked(row["bits"], begin)[index])
                _, least, begin, index = distinct_runs(runs, ids, shards, span)
                mask = np.zeros(len(least), np.uint32)
                for r in row["masks"]:
                    mask[begin[r["shard"]] : begin[r["shard"] + 1]] = np.frombuffer(r["masks"], "<u4")
                n = runs.count
                j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                later = ids[runs.text] > least[index]
                hit = np.repeat(later, n) | ((np.repeat(mask[index], n) >> j.astype(np.uint32)) & 1).astype(bool)
                at = (np.repeat(runs.start, n) + j)[hit]
                np.add.at(gone, at, 1)
                np.subtract.at(gone, at + span, 1)
            removed = np.cumsum(gone[:-1]) > 0
            out = []
            for i in range(len(off) - 1):
                a, b = int(off[i]), int(off[i + 1])
                r = removed[a:b]
                if r.any():
                    d = np.diff(np.concatenate([[0], r.astype(np.int8), [0]]))
                    spans = [{"s": int(x), "e": int(y)} for x, y in zip(np.flatnonzero(d > 0), np.flatnonzero(d < 0), strict=True)]
                    left = runs.data[a:b][~r].tobytes()
                else:
                    spans, left = [], runs.data[a:b].tobytes()
                out.append((None if row["no_id"][i] else int(ids[i]), b - a, int(r.sum()), len(spans), hashlib.sha256(left).hexdigest(), spans, *([left] if with_text else [])))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_bytes"][: len(cols)])

    return blocks.join(by_block(masks, "masks"), "block", "left").join(by_block(bits, "bits"), "block", "left").mapInArrow(finish, fields)
