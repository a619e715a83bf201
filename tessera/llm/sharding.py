"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are ranked within their source in the order of a seeded hash, and all rows are sorted by fractional rank, (rank + offset) /
rows of the source, with ranks from 0 and an offset below 1 that the seed gives each source, so that sources of like sizes don't
fall on the same places. Any stretch of that order holds each source in proportion, and it is cut into shards of equal size, so
that the sizes are at most one apart (law ``rows``).

Ranks come in two steps, so that no task holds a source or the whole order: rows are dealt to equal ranges of their sort
key, counted by range, and numbered within it after the rows of the ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed


def numbered(rows: DataFrame, by: list[str], cell: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: the position from 0 within ``by`` in the order of (cell, *order)."""
    counts = rows.groupBy(*by, cell).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*by, cell, F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*by, cell).orderBy(*order)) - 1
    return rows.withColumn("__own", own).join(offsets, [*by, cell]).withColumn(name, (F.col("__before") + F.col("__own")).cast("bigint")).drop("__before", "__own")


def fraction(key: Column) -> Column:
    """A hash as a number in [0, 1), in its unsigned order."""
    return F.shiftrightunsigned(key, 11).cast("double") / F.lit(float(1 << 53))


def cells(part: Column, n: int) -> Column:
    """The range of n equal ones in [0, 1) that ``part`` falls in."""
    return F.least(F.floor(part * n), F.lit(n - 1)).cast("bigint")


def shard(docs: DataFrame, shards: int = 8, seed: int = 17, cell_rows: int = 20_000, least_cells: int = 256) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, text_crc32, shard (0 to ``shards`` - 1), slot (gapless from 0).

    ``size`` is the UTF-8 bytes of the text (null: none) plus 1. Rows with a null source form one source; a null doc_id is
    shuffled like any other; repeated rows each get a place of their own, interchangeably; of an empty table nothing is
    returned; with fewer rows than shards some shards are empty; other columns are ignored, whatever they are called. The
    shuffle depends on the seed, on doc_id and text, and for rows that repeat both on their number among these.
    """
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), text)
    rows = rows.select("doc_id", "source", (F.octet_length("text") + 1).cast("bigint").alias("size"), F.crc32("text").alias("text_crc32"))
    # equal rows are told apart by a number, so that they don't share a key and a range
    copies = rows.groupBy("doc_id", "source", "size", "text_crc32").agg(F.count(F.lit(1)).alias("__copies"))
    rows = copies.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies")))).drop("__copies")
    shuffled = F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size", "__copy")
    rows = checkpointed(rows.withColumn("__key", shuffled).withColumn("__source", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    total = rows.count()
    n = max(least_cells, -(-total // cell_rows))
    part = fraction(F.col("__key"))
    ranked = numbered(rows.withColumn("__cell", cells(part, n)), ["__source"], "__cell", ["__key", "doc_id", "text_crc32", "__copy"], "__rank")
    sizes = rows.groupBy("__source").agg(F.count(F.lit(1)).alias("__rows"))
    ranked = ranked.join(sizes, "__source").withColumn("__part", (F.col("__rank") + fraction(F.xxhash64(F.lit(seed), "__source"))) / F.col("__rows"))
    ranked = ranked.withColumn("__cell", cells(F.col("__part"), n)).withColumn("__all", F.lit(0))
    order = ["__part", F.xxhash64(F.lit(seed), "__source"), "__source", "__key", "doc_id", "text_crc32", "__copy"]
    placed = numbered(ranked, ["__all"], "__cell", order, "__place")
    number = F.expr(f"__place * {shards} div {max(1, total)}")
    start = F.expr(f"(__shard * {total} + {shards - 1}) div {shards}")
    placed = placed.withColumn("__shard", number.cast("bigint"))
    return placed.select("doc_id", "source", "size", "text_crc32", F.col("__shard").cast("int").alias("shard"), (F.col("__place") - start).cast("bigint").alias("slot"))


def digests(sharded: DataFrame) -> DataFrame:
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
