"""Vectorised work on batches of UTF-8 texts: slicing, word boundaries, rolling hashes.

Everything here sees whole texts. A batch is cut into slices of about ``SLICE`` bytes so that numpy temporaries stay
small whatever the length of the corpus; one text longer than that is a slice of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240131))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers = {"f": np.ones(1, U64), "b": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers["f"]) < n:
        size = max(n, SLICE + 1024)
        for k, b in (("f", BASE), ("b", BASE_INV)):
            x = np.full(size, b, U64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=U64)
    return _powers["f"][:n], _powers["b"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def prefix_hash(data: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """S with S[e] - S[s] = BASE**s * (polynomial hash of data[s:e])."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(code[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span; spans with the same content have the same hash wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(U64))


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each starts (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if not (pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)):
        texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_large_binary(texts.type) else "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in slices of about ``size`` bytes: rows, their bytes, their offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = flat(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
            yield batch.slice(at, end - at), data[off[at] : off[end]], off[at : end + 1] - off[at]
            at = end


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of word bytes within one text, and the index of the first word of each text
    (with a last entry for the end)."""
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts_of_texts = off[:-1][off[:-1] < off[1:]]
    first[starts_of_texts] = inside[starts_of_texts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_of_texts = off[1:][off[:-1] < off[1:]] - 1
    last[ends_of_texts] = inside[ends_of_texts]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def grams(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words; entry i starts at word i (borders between texts are the caller's care)."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out = out * U64(0xD6E8FEB86659FD93) + word_hash[j : j + n]
    return mix(out)


def sliding(op, x: np.ndarray, w: int) -> np.ndarray:
    """op over every w consecutive entries (w <= len(x)), by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def shared_dir(spark, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share; set here only where it is unset."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if base is None:
        base = jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/graphloom-checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    elif not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df, name: str):
    """The frame written as a Parquet table in the shared folder and read back: lineage ends here and survives the
    loss of executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dropped(*frames) -> None:
    """Removes the folders of tables made by ``stored`` once nothing that is still to run reads them."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def total_bytes(docs, column: str = "text") -> int:
    from pyspark.sql import functions as F

    return int(docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])
