"""Source trees as a table of files (S2-S4, S21): format ``source_tree``.

The driver lists names only; executors read and decode. Any file system that pyarrow knows will do (file, hdfs, s3 and
so on), as long as executors reach it. Spark's own readers skip names that begin with an underscore, and with them every
``__init__.py``.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import spec

FILES = "rel string, language string, source string, lines int, file_ord int"
PER_TASK = 64


class Chunk(InputPartition):
    def __init__(self, items: list):
        self.items = items


def kind(name: str) -> str | None:
    return spec.LANGUAGES.get(PurePosixPath(name).suffix.lower())


def skipped(parts: tuple[str, ...] | list[str]) -> bool:
    return any(p in spec.SKIP_DIRS for p in parts)


def decoded(raw: bytes) -> str:
    """UTF-8 with replacement; every line end is a newline."""
    return raw.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


def row(rel: str, raw: bytes, place: int) -> tuple:
    text = decoded(raw)
    return rel, kind(rel), text, text.count("\n") + 1, place


def opened(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def chunks(items: list) -> list[Chunk]:
    return [Chunk(items[i : i + PER_TASK]) for i in range(0, len(items), PER_TASK)] or [Chunk([])]


class SourceTree(DataSource):
    """Options: path; maxfiles (of supported ones, in the order of paths); skip (false: no folder is skipped);
    absolute (true: folders above the root count as skipped ones, too); suffixes (a comma-separated list)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.most = int(options.get("maxfiles", spec.MAX_FILES))
        self.skip = options.get("skip", "true") == "true"
        self.above = options.get("absolute", "false") == "true"
        self.suffixes = [s for s in options.get("suffixes", "").split(",") if s]

    def partitions(self) -> list[Chunk]:
        from pyarrow import fs

        store, root = opened(self.root)
        out = []
        for f in store.get_file_info(fs.FileSelector(root, recursive=True)):
            rel = f.path[len(root.rstrip("/")) + 1 :]
            parts = rel.split("/")
            if f.type != fs.FileType.File or kind(rel) is None or (self.suffixes and PurePosixPath(rel).suffix not in self.suffixes):
                continue
            if not (self.skip and skipped(f.path.split("/") if self.above else parts)):
                out.append((parts, rel, f.path))
        return chunks([(rel, path, i) for i, (_, rel, path) in enumerate(sorted(out)[: self.most])])

    def read(self, part: Chunk):
        store, _ = opened(self.root)
        for rel, path, place in part.items:
            try:
                with store.open_input_stream(path) as f:
                    raw = f.read()
            except (OSError, pa.ArrowException):
                continue
            yield row(rel, raw, place)


def fingerprint(spark: SparkSession, root: str) -> str:
    """Names and times of all source files as one hash: the key of a cache of parsed trees. Only names are listed."""
    import hashlib

    from pyarrow import fs

    store, base = opened(root)
    seen = []
    for f in store.get_file_info(fs.FileSelector(base, recursive=True)):
        rel = f.path[len(base.rstrip("/")) + 1 :]
        if f.type == fs.FileType.File and kind(rel) and not skipped(rel.split("/")):
            seen.append((rel, f.mtime_ns))
    return hashlib.sha256("\n".join(f"{rel}:{t}" for rel, t in sorted(seen)).encode()).hexdigest()


def only_files(files: DataFrame, names: DataFrame) -> DataFrame:
    """Files whose relative path, or whose last part, is among the names."""
    n = names.select(F.col(names.columns[0]).alias("_name")).distinct()
    by_rel = files.join(n.withColumnRenamed("_name", "rel"), "rel", "left_semi")
    tail = F.element_at(F.split("rel", "/"), -1)
    by_base = files.withColumn("_name", tail).join(n, "_name", "left_semi").drop("_name").select(*files.columns)
    return by_rel.select(*files.columns).unionByName(by_base).dropDuplicates(["rel"])


def changed_or_all(files: DataFrame, changed: DataFrame | None) -> DataFrame:
    """What a scan covers: the changed source files, or all if none of the changed ones is a source file."""
    code = F.lower(F.regexp_extract("rel", r"(\.[^./]+)$", 1)).isin(spec.SOURCE_SUFFIXES)
    every = files.filter(code)
    if changed is None:
        return every
    some = every.join(changed.select(F.col(changed.columns[0]).alias("rel")).distinct(), "rel", "left_semi")
    return every if some.isEmpty() else some


def targets(nodes: DataFrame, search: str = "") -> DataFrame:
    """What a user can pick: files by path, then functions by name; those that hold the search text."""
    files = nodes.filter("type = 'file'").select(F.lit(0).alias("kind"), F.col("file").alias("label"), "id")
    functions = nodes.filter("type = 'function'").select(F.lit(1).alias("kind"), F.coalesce("qualified_name", "name").alias("label"), "id")
    return files.unionByName(functions).filter(F.lower("label").contains(search.lower())).orderBy("kind", "label", "id")


def source_count(files: DataFrame) -> DataFrame:
    """One row: how many source files there are."""
    return files.agg(F.count_if(F.lower(F.regexp_extract("rel", r"(\.[^./]+)$", 1)).isin(spec.SOURCE_SUFFIXES)).alias("n_files"))


def contents(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """The text of each file node; a note where the file is not there."""
    n = nodes.filter("type = 'file'").select("id", F.col("file").alias("rel"))
    return n.join(files.select("rel", "source"), "rel", "left").select("id", "rel", F.coalesce("source", F.format_string("# Could not read %s", "rel")).alias("source"))


def snapshot_pair(before: DataFrame, after: DataFrame, whole: bool = False) -> DataFrame:
    """Two versions of every file of a project: what it was (a stub where there was none, or for all with ``whole``) and
    what it is. Columns rel, old, new."""
    stub = F.format_string("# %s — clean baseline stub\n", F.element_at(F.split("rel", "/"), -1))
    a = after.filter(F.lower(F.regexp_extract("rel", r"(\.[^./]+)$", 1)).isin(spec.SOURCE_SUFFIXES)).select("rel", F.col("source").alias("new"))
    b = before.select("rel", F.col("source").alias("old"))
    out = a.join(b, "rel", "left").withColumn("old", F.coalesce("old", stub))
    return out.withColumn("old", stub).select("rel", "old", "new") if whole else out.select("rel", "old", "new")


def unified(pairs: DataFrame) -> DataFrame:
    """The unified diff of each pair of versions: rel, diff (null where nothing changed)."""

    def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import difflib

        for batch in batches:
            out = []
            for r, a, b in zip(batch.rel, batch.old, batch.new, strict=True):
                body = list(difflib.unified_diff(a.splitlines(), b.splitlines(), f"a/{r}", f"b/{r}", lineterm=""))
                out.append("\n".join([f"diff --git a/{r} b/{r}", *body]) if body else None)
            yield pd.DataFrame({"rel": batch.rel, "diff": pd.Series(out, dtype="object", index=batch.index)})

    return pairs.select("rel", "old", "new").mapInPandas(diff, "rel string, diff string")


def split_answer(texts: DataFrame, text: str = "text", id_col: str = "id") -> DataFrame:
    """Files of an answer that holds many, each behind a line ``=== FILE: name ===``; of two of one name the last
    stands. Fences around a body and blank lines before it go."""
    parts = texts.select(id_col, F.posexplode(F.split(text, r"(?md)(?=^===\s*FILE:\s*.+?\s*===\s*$)")).alias("ord", "part"))
    head = r"(?d)^===\s*FILE:\s*(.+?)\s*===\s*(?:\n|$)"
    p = parts.filter(F.col("part").rlike(head)).withColumn("rel", F.regexp_replace(F.regexp_extract("part", head, 1), "^/+", ""))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("part", head, ""), r"^\s*```[a-zA-Z]*\n", ""), r"\n```\s*$", "\n")
    return p.groupBy(id_col, "rel").agg(F.max_by(F.ltrim(body, F.lit("\n")), "ord").alias("source"))
