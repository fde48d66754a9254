"""Numbering and running totals that do not put a hot key into one task.

Whole tables are numbered over range partitions (``number_by_range``). The others
work in two levels: rows are numbered inside (key, block), and the totals
of the earlier blocks, a far smaller table, are added. ``block`` must grow with
the order, so that every row of an earlier block sorts before the later ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corefold.session import broadcast_if_small, written

_ROW_BITS = 33  # monotonically_increasing_id: partition above, place in it below


def _in_ranges(df: DataFrame, order: Sequence) -> DataFrame:
    """The rows sorted into range partitions and written, with the number of the
    partition and the place inside it. Writing fixes the ranges, whose bounds come
    from a sample, for every later reader."""
    place = F.monotonically_increasing_id()
    return written(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_order_part", F.shiftright(place, _ROW_BITS)).withColumn("_order_at", place.bitwiseAND((1 << _ROW_BITS) - 1)),
        "ranges",
    )


def _with_bases(placed: DataFrame, amounts: dict[str, Column]) -> DataFrame:
    """Adds, by name, the total of each amount over the earlier partitions. One row per
    partition passes through the driver, however long the table is."""
    sums = placed.groupBy("_order_part").agg(*[a.alias(name) for name, a in amounts.items()])
    rows, before = [], None
    for part, *totals in sorted((tuple(r) for r in sums.collect()), key=lambda r: r[0]):
        before = before or [t - t for t in totals]
        rows.append((part, *before))
        before = [b + t for b, t in zip(before, totals)]
    return placed.join(F.broadcast(placed.sparkSession.createDataFrame(rows, sums.schema)), "_order_part")


def number_by_range(df: DataFrame, order: Sequence, out: str, start: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Dense numbers in ``order`` over the whole table, or from ``start`` on in each
    group of ``keys`` (nulls are a group), ``order`` then holding inside it.

    A group may span any number of partitions: rows are numbered through and the
    number of the group's first row is taken off. Rows equal in ``order`` get their
    numbers in any order."""
    keys = list(keys)
    placed = _in_ranges(df, [*keys, *order])
    numbered = _with_bases(placed, {"_order_base": F.count(F.lit(1))}).withColumn(out, F.col("_order_at") + F.col("_order_base") + start)
    numbered = numbered.drop("_order_part", "_order_at", "_order_base")
    if not keys:
        return numbered
    firsts = written(numbered.groupBy(*[F.col(k).alias(f"_order_{i}") for i, k in enumerate(keys)]).agg(F.min(out).alias("_order_first")), "firsts")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_order_{i}"))
    joined = numbered.join(broadcast_if_small(firsts), same).withColumn(out, F.col(out) - F.col("_order_first") + start)
    return joined.drop("_order_first", *[f"_order_{i}" for i in range(len(keys))])


def running_totals_by_range(df: DataFrame, order: Sequence, values: dict[str, Column]) -> DataFrame:
    """Adds, by name, the sums of ``values`` (never null) up to each row in ``order``
    over the whole table. A window never reaches beyond one range partition."""
    placed = _in_ranges(df, order)
    based = _with_bases(placed, {f"_order_{name}": F.sum(value) for name, value in values.items()})
    inner = Window.partitionBy("_order_part").orderBy("_order_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = based.withColumns({name: F.sum(value).over(inner) + F.col(f"_order_{name}") for name, value in values.items()})
    return totals.drop("_order_part", "_order_at", *[f"_order_{name}" for name in values])


def _earlier_blocks(df: DataFrame, keys: Sequence[str], amount: Column) -> DataFrame:
    window = (
        Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ).orderBy("_order_block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.groupBy(*keys, "_order_block")
        .agg(amount.alias("_order_amount"))
        .withColumn("_order_base", F.coalesce(F.sum("_order_amount").over(window), F.lit(0)))
        .drop("_order_amount")
    )


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence, block: Column, out: str, start: int = 0
) -> DataFrame:
    """Dense numbers in ``order`` per ``keys``; no keys numbers the whole table."""
    keys = list(keys)
    blocked = df.withColumn("_order_block", block)
    base = _earlier_blocks(blocked, keys, F.count(F.lit(1)))
    inner = Window.partitionBy(*keys, "_order_block").orderBy(*order)
    return (
        blocked.withColumn("_order_local", F.row_number().over(inner))
        .join(base, [*keys, "_order_block"])
        .withColumn(out, (F.col("_order_local") + F.col("_order_base") - 1 + start).cast("long"))
        .drop("_order_local", "_order_base", "_order_block")
    )


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence, block: Column, value: Column, out: str,
    inclusive: bool = False,
) -> DataFrame:
    """Sum of ``value`` over the rows before each one (or up to it)."""
    keys = list(keys)
    blocked = df.withColumn("_order_block", block).withColumn("_order_value", value)
    base = _earlier_blocks(blocked, keys, F.sum("_order_value"))
    inner = (
        Window.partitionBy(*keys, "_order_block")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    return (
        blocked.withColumn("_order_local", F.coalesce(F.sum("_order_value").over(inner), F.lit(0)))
        .join(base, [*keys, "_order_block"])
        .withColumn(out, F.col("_order_local") + F.col("_order_base"))
        .drop("_order_local", "_order_base", "_order_block", "_order_value")
    )


def running_max(
    df: DataFrame, keys: Sequence[str], order: Sequence, block: Column, value: Column, out: str
) -> DataFrame:
    """Largest ``value`` of the rows before each one, null for the first."""
    keys = list(keys)
    blocked = df.withColumn("_order_block", block).withColumn("_order_value", value)
    earlier = (
        Window.partitionBy(*keys).orderBy("_order_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    base = (
        blocked.groupBy(*keys, "_order_block")
        .agg(F.max("_order_value").alias("_order_max"))
        .withColumn("_order_base", F.max("_order_max").over(earlier))
        .drop("_order_max")
    )
    inner = (
        Window.partitionBy(*keys, "_order_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        blocked.withColumn("_order_local", F.max("_order_value").over(inner))
        .join(base, [*keys, "_order_block"])
        .withColumn(out, F.greatest("_order_local", "_order_base"))
        .drop("_order_local", "_order_base", "_order_block", "_order_value")
    )


def blocks_of(column: Column, width: int) -> Column:
    return F.floor(column / F.lit(width))
