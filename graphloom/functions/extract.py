"""Files to facts (X1-X10, S3): one pass over the texts, then plain tables.

``parsed`` reads each file once in Arrow batches; the tables explode its arrays, so Catalyst prunes what is not asked for.
Also registered as table functions for SQL: calls_of(source, language), functions_of(source, language).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from . import python_source, script_source

TEXT, NUMBER, FLAG = StringType(), IntegerType(), BooleanType()


def rows_of(**fields) -> ArrayType:
    return ArrayType(StructType([StructField(k, v) for k, v in fields.items()]))


CALL = {"name": TEXT, "line": NUMBER}
LINES = {"line_start": NUMBER, "line_end": NUMBER}
FACTS = StructType(
    [StructField("rel", TEXT), StructField("language", TEXT), StructField("lines", NUMBER), StructField("file_ord", NUMBER)]
    + [
        StructField("imports", rows_of(module=TEXT, names=ArrayType(TEXT), line=NUMBER, is_relative=FLAG)),
        StructField("functions", rows_of(name=TEXT, qualified_name=TEXT, **LINES, params=ArrayType(TEXT), decorators=ArrayType(TEXT), calls=rows_of(**CALL))),
        StructField("classes", rows_of(name=TEXT, **LINES, bases=ArrayType(TEXT))),
        StructField("calls", rows_of(**CALL, bare=FLAG, mixed=ArrayType(TEXT), inside=TEXT, inside_params=ArrayType(TEXT))),
    ]
)


def facts(source: str | None, language: str) -> dict:
    return (python_source if language == "python" else script_source).facts(source or "")


def parsed(files: DataFrame) -> DataFrame:
    """Facts of every file (rel, language, source, lines, file_ord) of a known language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(FACTS)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200).to_pylist()
                rows = [{k: f[k] for k in ("rel", "language", "lines", "file_ord")} | facts(f["source"], f["language"]) for f in part]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.filter("language is not null").select("rel", "language", "source", "lines", "file_ord").mapInArrow(run, FACTS)


def imports(p: DataFrame) -> DataFrame:
    return p.select("rel", "file_ord", F.posexplode("imports").alias("ord", "i")).select("rel", "file_ord", "ord", "i.*")


def functions(p: DataFrame) -> DataFrame:
    f = p.select("rel", "file_ord", F.posexplode("functions").alias("ord", "f"))
    return f.select("rel", "file_ord", "ord", *(f"f.{c}" for c in ("name", "qualified_name", "line_start", "line_end", "params", "decorators")))


def classes(p: DataFrame) -> DataFrame:
    return p.select("rel", "file_ord", F.posexplode("classes").alias("ord", "c")).select("rel", "file_ord", "ord", "c.*")


def function_calls(p: DataFrame) -> DataFrame:
    """Calls by the function whose body holds them: rel, owner, name, line, ord (over the whole project)."""
    f = p.select("rel", "file_ord", F.posexplode("functions").alias("k", "f")).select("rel", "file_ord", "k", F.col("f.qualified_name").alias("owner"), F.posexplode("f.calls").alias("j", "c"))
    return f.select("rel", "owner", "c.name", "c.line", F.struct("file_ord", "k", "j").alias("ord"))


def all_calls(p: DataFrame) -> DataFrame:
    """Every call of every file: rel, ord, name, line, bare, mixed, inside, inside_params."""
    return p.select("rel", "file_ord", F.posexplode("calls").alias("ord", "c")).select("rel", "file_ord", "ord", "c.*")


def spans(p: DataFrame) -> DataFrame:
    """Lines that functions and classes own."""
    both = F.concat(F.transform("functions", lambda f: F.struct(f["line_start"].alias("a"), f["line_end"].alias("b"))), F.transform("classes", lambda c: F.struct(c["line_start"].alias("a"), c["line_end"].alias("b"))))
    return p.select("rel", F.explode(both).alias("s")).select("rel", "s.a", "s.b")


def top_level_calls(p: DataFrame) -> DataFrame:
    """Calls on lines that no function or class owns."""
    from ..operators.detect import outside

    return outside(all_calls(p).select("rel", "ord", "name", "line"), spans(p), ["rel"], "line", "a", "b")


def register(spark: SparkSession) -> None:
    """Table functions for SQL: calls_of and functions_of."""

    @F.udtf(returnType="name string, line int, bare boolean, inside string")
    class CallsOf:
        def eval(self, source: str, language: str):
            for c in facts(source, language)["calls"]:
                yield c["name"], c["line"], c["bare"], c["inside"]

    @F.udtf(returnType="qualified_name string, line_start int, line_end int, params array<string>")
    class FunctionsOf:
        def eval(self, source: str, language: str):
            for f in facts(source, language)["functions"]:
                yield f["qualified_name"], f["line_start"], f["line_end"], f["params"]

    spark.udtf.register("calls_of", CallsOf)
    spark.udtf.register("functions_of", FunctionsOf)
