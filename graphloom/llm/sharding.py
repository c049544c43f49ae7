"""Proportional stratified interleaving of documents into shards.

Within each source rows are ranked in a seeded random order; rank r of n has the place (2r - 1) / 2n. All rows sorted by
that place, ties by source, are cut into shards of equal row counts, so every shard (and every stretch of one) holds the
sources in the proportions of the whole. Law: ``rows``.

No window ever spans a source or the corpus: ranks come from row numbers within small (source, hash range) cells plus
running sums of the cells' counts, in two levels.

Defined cases: null text has no bytes; a text of any length is one row; null sources are one source; a null doc_id is dealt
like any other and stays null; ties in the random order go by doc_id and size, and rows that repeat are dealt one by one;
an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import stored

CELL = 1024
FAN = 1024


def running(cells: DataFrame, by: list[str], cell: str, n: str, out: str) -> DataFrame:
    """Sum of n over the cells before each, within ``by``; no task sees more than FAN cells of one group at once, but
    for their sums."""
    hi = cells.withColumn("_hi", F.floor(F.col(cell) / FAN))
    inner = Window.partitionBy(*by, "_hi").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    outer = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_hi").rowsBetween(Window.unboundedPreceding, -1)
    tops = hi.groupBy(*by, "_hi").agg(F.sum(n).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(outer), F.lit(0)))
    return hi.join(tops.drop("_n"), [*by, "_hi"]).withColumn(out, F.col("_base") + F.coalesce(F.sum(n).over(inner), F.lit(0))).drop("_base", "_hi")


def interleave(docs: DataFrame, shards: int = 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, source, shard, slot for every row."""
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("s"),
            F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0)).alias("bytes"),
            F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"),
        ).withColumn("u", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_crc32")).bitwiseAND(F.lit((1 << 62) - 1))),
        "shard-rows",
    )
    total = rows.count()
    cells = max(1, -(-total // CELL))
    rows = rows.withColumn("c", F.shiftright("u", 22) * cells / F.lit(float(1 << 40)))
    rows = rows.withColumn("c", F.floor("c"))
    counts = rows.groupBy("s", "c").agg(F.count("*").alias("n"))
    ranks = running(counts, ["s"], "c", "n", "before").select("s", "c", "before")
    sizes = counts.groupBy("s").agg(F.sum("n").alias("of"))
    ranks = ranks.join(sizes, "s")
    within = Window.partitionBy("s", "c").orderBy("u", "doc_id", "bytes")
    ranked = rows.join(ranks, ["s", "c"]).withColumn("r", F.col("before") + F.row_number().over(within))
    ranked = stored(ranked.withColumn("f", (2.0 * F.col("r") - 1) / (2.0 * F.col("of"))).withColumn("g", F.least(F.floor(F.col("f") * cells), F.lit(cells - 1))).drop("c", "before", "r", "of"), "shard-ranks")
    spans = running(ranked.groupBy("g").agg(F.count("*").alias("n")), [], "g", "n", "base").select("g", "base")
    order = Window.partitionBy("g").orderBy("f", "s", "u", "doc_id", "bytes")
    placed = ranked.join(spans, "g").withColumn("pos", F.col("base") + F.row_number().over(order) - 1)
    shard = F.expr(f"cast(cast(pos as decimal(38,0)) * {shards} div {max(total, 1)} as int)")
    first = F.expr(f"cast((cast(shard as decimal(38,0)) * {total} + {shards - 1}) div {shards} as bigint)")
    return placed.withColumn("shard", shard).select(
        "doc_id",
        (F.col("bytes") + 8).alias("size"),
        "text_crc32",
        F.when(F.col("s") != "n", F.expr("substring(s, 2)")).alias("source"),
        "shard",
        (F.col("pos") - first).alias("slot"),
    )
