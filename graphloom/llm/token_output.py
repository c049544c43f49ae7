"""Token-ID output: length-delimited binary records with masked checksums and a separate offset index.

Record: ``length u64 | masked crc32c(length) u32 | payload | masked crc32c(payload) u32`` (all little-endian). The
payload holds the ids as unsigned 16-bit integers where the vocabulary allows it, else 32-bit ones. Beside each record
file stands an index, one entry a record (``doc_id i64, offset u64, n_ids u64, no_id u8``), so that a reader can visit records
in any order without scanning.

Documents are dealt out by ranges of doc_id (and of a hash of the text, so that one id on many rows is no one task's work);
each range is sorted, encoded and written as a stream, so memory is bounded by one slice of a batch. A manifest, committed
by Spark, names the files of the task attempts that succeeded; files of lost or repeated attempts are never read.

Defined cases: null text is empty; an empty text is the end id alone; a null doc_id sorts first and stays null; rows that
share a doc_id, or repeat, are written as often as they come, in an order that depends on their texts alone; a text of any
length is one record; a marker string of the vocabulary within a text is its own id, as the library reads it; an empty table
gives no files; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._text import column, shared_dir, slices, total_bytes
from ._tok import default_path, encoder
from .sharding import running

FILE_BYTES = 64 << 20
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n_ids", "<u8"), ("no_id", "?")])
BLOCK = 256


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
    return t


CRC = _byte_table()


def _shift_tables() -> list[np.ndarray]:
    """Entry i maps a register to itself after 2**i zero bytes, as four tables of its bytes."""

    def apply(t: np.ndarray, x: np.ndarray) -> np.ndarray:
        return t[0][x & 255] ^ t[1][(x >> 8) & 255] ^ t[2][(x >> 16) & 255] ^ t[3][x >> 24]

    b = np.arange(256, dtype=np.uint32)
    one = np.stack([CRC[v & 255] ^ (v >> 8) for v in (b << (8 * i) for i in range(4))])
    out = [one]
    for _ in range(40):
        out.append(np.stack([apply(out[-1], row) for row in out[-1]]))
    return out


SHIFT = _shift_tables()


def _shifted(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers after n zero bytes each."""
    x, n, i = x.copy(), n.copy(), 0
    while n.any():
        odd = np.flatnonzero(n & 1)
        if len(odd):
            v, t = x[odd], SHIFT[i]
            x[odd] = t[0][v & 255] ^ t[1][(v >> 8) & 255] ^ t[2][(v >> 16) & 255] ^ t[3][v >> 24]
        n, i = n >> 1, i + 1
    return x


def crc32c(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """CRC-32C of every record data[off[i]:off[i+1]], all at once."""
    size = np.diff(off)
    blocks = -(-size // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    n = int(first[-1])
    # Records are set flush right in whole blocks: leading zero bytes leave an empty register as it is.
    grid = np.zeros(n * BLOCK, np.uint8)
    grid[np.arange(len(data)) + np.repeat(first[1:] * BLOCK - off[1:], size)] = data
    grid = np.ascontiguousarray(grid.reshape(n, BLOCK).T)
    reg = np.zeros(n, np.uint32)
    for row in grid:
        reg = CRC[(reg ^ row) & 255] ^ (reg >> np.uint32(8))
    after = np.repeat(first[1:], blocks) - 1 - np.arange(n)
    reg = _shifted(reg, after * BLOCK)
    out = _shifted(np.full(len(size), 0xFFFFFFFF, np.uint32), size)
    some = np.flatnonzero(blocks)
    if len(some):
        out[some] ^= np.bitwise_xor.reduceat(reg, first[:-1][some])
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frame(payload: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The framed bytes of all records, and where each frame starts."""
    size = np.diff(off)
    heads = size.astype("<u8").view(np.uint8).reshape(-1, 8)
    head_crc = masked(crc32c(heads.reshape(-1), np.arange(len(size) + 1) * 8)).astype("<u4")
    crc = masked(crc32c(payload, off)).astype("<u4")
    at = np.concatenate([[0], np.cumsum(size + 16)])
    out = np.empty(int(at[-1]), np.uint8)
    for k in range(8):
        out[at[:-1] + k] = heads[:, k]
    for where, c in ((at[:-1] + 8, head_crc), (at[1:] - 4, crc)):
        c = c.view(np.uint8).reshape(-1, 4)
        for k in range(4):
            out[where + k] = c[:, k]
    out[np.arange(len(payload)) + np.repeat(at[:-1] + 12 - off[:-1], size)] = payload
    return out, at


def file_system(uri: str):
    """Where a shared folder lives, for reading and writing from a Python worker."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_records(docs: DataFrame, out_dir: str | None = None, tokenizer: str | None = None, end_id: int = 0, file_bytes: int = FILE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes all documents in ascending doc_id order; returns the folder (files, indexes, manifest)."""
    spark = docs.sparkSession
    path, out_dir = tokenizer or default_path(), out_dir or shared_dir(spark, "records")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes(docs, text_col) // file_bytes))
    store, folder = file_system(out_dir)
    store.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        enc, bucket = encoder(path), TaskContext.get().partitionId()
        width = np.dtype("<u2") if enc.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        fs, root = file_system(out_dir)
        done, out, index, at, seq, ids = [], None, [], 0, 0, 0

        def close() -> None:
            nonlocal out, index, at, seq, ids
            out.close()
            entries = np.concatenate(index)
            with fs.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(entries.tobytes())
            done.append((bucket, seq, name, len(entries), ids))
            out, index, at, ids, seq = None, [], 0, 0, seq + 1

        for rows, data, off in slices(batches):
            if out is not None and at >= file_bytes:
                close()
            if out is None:
                name = f"records-{bucket:08d}-{seq:05d}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(f"{root}/{name}.bin")
            got, first = enc(data, off)
            m = len(off) - 1
            ended = np.full(len(got) + m, end_id, width)
            ended[np.arange(len(got)) + np.repeat(np.arange(m), np.diff(first))] = got
            size = np.diff(first) + 1
            framed, where = frame(ended.view(np.uint8), np.concatenate([[0], np.cumsum(size)]) * width.itemsize)
            out.write(framed.tobytes())
            doc = column(rows, "doc_id")
            e = np.empty(m, INDEX)
            e["doc_id"], e["no_id"] = np.asarray(doc.fill_null(0)), np.asarray(doc.is_null())
            e["offset"], e["n_ids"] = where[:-1] + at, size
            index.append(e)
            at, ids = at + int(where[-1]), ids + len(ended)
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["bucket", "seq", "name", "n_records", "n_ids"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = given.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    dealt.mapInArrow(write, "bucket int, seq int, name string, n_records long, n_ids long").write.mode("overwrite").parquet(f"{out_dir}/manifest")
    return out_dir


def read_records(spark: SparkSession, out_dir: str, tokenizer: str | None = None, seed: int | None = None, with_ids: bool = False) -> DataFrame:
    """One row a record, from the files alone, every checksum verified: doc_id, start, n_tokens, ids_crc32 (and ids).

    ``seed``: records of each file are visited in a shuffled order, by the index.
    """
    path = tokenizer or default_path()
    files = spark.read.parquet(f"{out_dir}/manifest")
    before = Window.partitionBy("bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = running(files.groupBy("bucket").agg(F.sum("n_ids").alias("all")), [], "bucket", "all", "base")
    placed = files.join(base.select("bucket", "base"), "bucket").withColumn("start", F.col("base") + F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(out_dir)
        enc = encoder(path)
        width = np.dtype("<u2") if enc.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        for batch in batches:
            for f in batch.to_pylist():
                with fs.open_input_stream(f"{root}/{f['name']}.idx") as s:
                    index = np.frombuffer(s.read(), INDEX)
                start = f["start"] + np.concatenate([[0], np.cumsum(index["n_ids"].astype(np.int64))])[:-1]
                order = np.arange(len(index)) if seed is None else np.random.default_rng([seed, f["bucket"], f["seq"]]).permutation(len(index))
                with fs.open_input_file(f"{root}/{f['name']}.bin") as s:
                    step = max(1, (1 << 20) // max(1, int(index["n_ids"].mean() * width.itemsize))) if len(index) else 1
                    for a in range(0, len(order), step):
                        take = order[a : a + step]
                        if seed is None:
                            raw = s.read_at(int(index["offset"][take[-1]] + index["n_ids"][take[-1]] * width.itemsize + 16 - index["offset"][take[0]]), int(index["offset"][take[0]]))
                            frames = [memoryview(raw)[int(o) : int(o) + int(n) * width.itemsize + 16] for o, n in zip(index["offset"][take] - index["offset"][take[0]], index["n_ids"][take], strict=True)]
                        else:
                            frames = [s.read_at(int(index["n_ids"][i]) * width.itemsize + 16, int(index["offset"][i])) for i in take]
                        size = np.array([len(x) - 16 for x in frames], np.int64)
                        off = np.concatenate([[0], np.cumsum(size)])
                        payload = np.frombuffer(b"".join(x[12:-4] for x in frames), np.uint8)
                        again, _ = frame(payload, off)
                        if again.tobytes() != b"".join(frames):
                            raise ValueError(f"damaged record in {f['name']}")
                        ids = payload.view(width).astype("<u4")
                        cut = off // width.itemsize
                        crc = [zlib.crc32(ids[x:y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                        out = [pa.array(index["doc_id"][take], pa.int64(), mask=index["no_id"][take]), pa.array(start[take]), pa.array(np.diff(cut)), pa.array(crc, pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            out.append(pa.array([ids[x:y].astype(np.int32) for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int32())))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(out, names)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "bucket", "seq").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
