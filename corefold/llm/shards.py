"""Shards by proportional stratified interleaving.

Rows are shuffled inside their source by a seeded hash and ranked; a row with rank r of
n stands at (r + 1/2) / n. Sorted by that fraction, every stretch of the table holds the
sources in their shares, so it is cut into shards of equal numbers of rows (at most one
apart), each with the mixture of the whole.

Both sorts are range partitioned (``order.number_by_range``), so neither a source with
most of the rows nor the whole table passes through one task. ``assign`` moves narrow
rows: the caller's kept columns, never the text. ``write_shards`` moves whole rows.

Odd rows: a null source is a source of its own; a null text has size 16 and the checksum
of no bytes; a null key is hashed as a word of its own. Repeated rows each get a place of
their own, in any order among themselves, as do copies of a text under different keys:
they are spread like all rows. With fewer rows than shards some shards stay empty. An
empty table gives no rows. Other columns, whatever their names, are left alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corefold.operators import order
from corefold.session import broadcast_if_small, written

LAW = "rows"


def size_of(text: Column) -> Column:
    """UTF-8 bytes and 16 for the record around them."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def checksum(text: Column) -> Column:
    return F.crc32(F.coalesce(text.cast("binary"), F.lit(b"")))


def seeded(key: Column, seed: int) -> Column:
    """The first 60 bits of sha256."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def interleave(rows: DataFrame, shards: int, source: str, key: str, seed: int, ties: Sequence[str] = ()) -> DataFrame:
    """Adds shard and slot (from 0 in each shard)."""
    named = rows.withColumn("_shuffled", seeded(F.col(key), seed)).withColumn("_source", F.col(source))
    ranked = order.number_by_range(named, ["_shuffled", *ties], "_rank", keys=["_source"])
    sizes = written(ranked.groupBy(F.col("_source").alias("_of")).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    placed = ranked.join(broadcast_if_small(sizes), F.col("_source").eqNullSafe(F.col("_of"))).withColumn("_fraction", (2 * F.col("_rank") + 1) / (2 * F.col("_n")))
    numbered = order.number_by_range(placed.drop("_rank", "_of"), ["_fraction", "_shuffled", "_source", *ties], "_place")
    total = numbered.count()
    whole = numbered.withColumn("shard", F.expr(f"int(_place * {shards} div {max(total, 1)})"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return whole.withColumn("slot", F.col("_place") - first).drop("_shuffled", "_source", "_n", "_fraction", "_place")


def assign(docs: DataFrame, shards: int = 40, source: str = "source", key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """key, size, text_crc32, shard, slot of every row."""
    narrow = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), checksum(F.col(text)).alias("text_crc32"))
    return interleave(narrow, shards, "source", "key", seed, ["size", "text_crc32"]).select(F.col("key").alias(key), "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 40, source: str = "source", key: str = "doc_id", seed: int = 1) -> None:
    """Whole rows as Parquet, a folder per shard, in slot order inside a file; a
    column of the caller called shard or slot is an error."""
    if {"shard", "slot"} & set(docs.columns):
        raise ValueError("shard and slot are columns of the files")
    placed = interleave(docs, shards, source, key, seed)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
