"""One-to-one choices between two sides as rounds of grouped maxima.

``best_matching`` finds the largest total (assignment), ``choose_in_order`` lets rows
take their best free column one after another. Neither sees a component, a row's or a
column's edges as a whole: a round is joins, maxima with map-side partials and a
checkpoint, and only counts and sums reach the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corefold.operators import order
from corefold.session import written

EDGES_PER_TASK = 200_000


def _top_two(edges: DataFrame, key: str, value: Column, *carry: str) -> DataFrame:
    """key, _best (value, carry), _second: the group limit prunes each task's rows to
    two per key before the shuffle."""
    ranked = edges.withColumn("_value", value)
    by = Window.partitionBy(key).orderBy(F.desc("_value"), *[F.desc(c) for c in carry])
    two = ranked.withColumn("_r", F.row_number().over(by)).filter("_r <= 2")
    return two.groupBy(key).agg(F.max(F.struct("_value", *carry)).alias("_best"), F.max(F.when(F.col("_r") == 2, F.col("_value"))).alias("_second"))


@dataclass
class Matching:
    """pairs: left, right, value. No choice can total more than ``bound``."""

    pairs: DataFrame
    total: float
    bound: float
    forced: int
    rounds: int


def _forced_pairs(edges: DataFrame) -> DataFrame:
    """Edges worth at least the best other edge of their left end plus that of their
    right end belong to a best choice, whatever the rest does; of several at one end
    the first by name. Other forced edges stay forced when these are taken out."""
    left = _top_two(edges, "left", F.col("value")).select("left", F.col("_best._value").alias("_l1"), F.coalesce("_second", F.lit(0.0)).alias("_l2"))
    right = _top_two(edges, "right", F.col("value")).select("right", F.col("_best._value").alias("_r1"), F.coalesce("_second", F.lit(0.0)).alias("_r2"))
    other = lambda a, b: F.when(F.col("value") == F.col(a), F.col(b)).otherwise(F.col(a))
    forced = edges.join(left, "left").join(right, "right").filter(F.col("value") >= other("_l1", "_l2") + other("_r1", "_r2")).select("left", "right", "value")
    of_left = forced.groupBy("left").agg(F.min("right").alias("right"))
    of_right = forced.groupBy("right").agg(F.min("left").alias("left"))
    return forced.join(of_left, ["left", "right"], "left_semi").join(of_right, ["left", "right"], "left_semi")


def _auction_round(arcs: DataFrame, objects: DataFrame, eps: float) -> DataFrame:
    """Every person without an object bids for the best one; the highest bid takes it."""
    owners = objects.filter("owner IS NOT NULL").select(F.col("owner").alias("person"))
    bidding = arcs.join(owners, "person", "left_anti").join(objects.select("object", "price"), "object")
    two = _top_two(bidding, "person", F.col("value") - F.col("price"), "object", "price")
    bids = two.select("person", F.col("_best.object").alias("object"), (F.col("_best.price") + F.col("_best._value") - F.col("_second") + eps).alias("_bid"))
    won = bids.groupBy("object").agg(F.max(F.struct("_bid", "person")).alias("_won"))
    return objects.join(won, "object", "left").select(
        "object", F.coalesce("_won._bid", "price").alias("price"), F.coalesce("_won.person", "owner").alias("owner")
    )


def best_matching(edges: DataFrame, tolerance: float = 1e-7, shrink: float = 6.0) -> Matching:
    """The best one-to-one choice of the edges (left, right, value > 0); names are
    compared as text, an edge given twice counts with its larger value.

    Pairs that are certain are settled first. The rest goes to an auction (Bertsekas)
    whose step shrinks from phase to phase. To let nodes stay alone, each node gets a
    stand-in worth nothing on the other side, and the stand-ins of two joined nodes
    may pair up as well: then everybody is matched, prices may be kept between phases,
    and prices plus best profits bound every choice from above. It ends when that bound
    is within ``tolerance`` per node of what is chosen."""
    named = edges.select(F.col("left").cast("string").alias("left"), F.col("right").cast("string").alias("right"), F.col("value").cast("double").alias("value"))
    rest = written(named.filter("value > 0").groupBy("left", "right").agg(F.max("value").alias("value")), "matching")
    settled, forced, rounds = [rest.limit(0)], 0, 0
    while True:
        sure = written(_forced_pairs(rest), "matching")
        found = sure.count()
        if not found:
            break
        forced += found
        settled.append(sure)
        rest = written(rest.join(sure.select("left"), "left", "left_anti").join(sure.select("right"), "right", "left_anti"), "matching")
    pairs = settled[0]
    for part in settled[1:]:
        pairs = pairs.unionByName(part)
    pairs = written(pairs, "matching")
    sure_total = pairs.agg(F.coalesce(F.sum("value"), F.lit(0.0))).first()[0]
    size, most = rest.agg(F.count("*"), F.max("value")).first()
    if not size:
        return Matching(pairs, sure_total, sure_total, forced, 0)

    left, right = F.concat(F.lit("l:"), "left"), F.concat(F.lit("r:"), "right")
    ends = rest.select(left.alias("node")).unionByName(rest.select(right.alias("node"))).distinct()
    arcs = (
        rest.select(left.alias("person"), right.alias("object"), "value")
        .unionByName(rest.select(right.alias("person"), left.alias("object"), F.lit(0.0).alias("value")))
        .unionByName(ends.select(F.col("node").alias("person"), F.col("node").alias("object"), F.lit(0.0).alias("value")))
    )
    arcs = written(arcs.coalesce(max(1, 4 * size // EDGES_PER_TASK)), "matching")
    objects = written(ends.select(F.col("node").alias("object"), F.lit(0.0).alias("price"), F.lit(None).cast("string").alias("owner")), "matching")
    nodes = objects.count()
    eps = most / 4
    while True:
        objects = objects.withColumn("owner", F.lit(None).cast("string"))
        while True:
            objects, rounds = written(_auction_round(arcs, objects, eps), "matching"), rounds + 1
            if objects.filter("owner IS NULL").isEmpty():
                break
        priced = arcs.join(objects, "object")
        profit = priced.groupBy("person").agg(F.max(F.col("value") - F.col("price")).alias("_v")).agg(F.sum("_v")).first()[0]
        bound = profit + objects.agg(F.sum("price")).first()[0]
        chosen = priced.filter("person = owner")
        total = chosen.agg(F.sum("value")).first()[0]
        if bound - total <= tolerance * nodes:
            break
        eps /= shrink
    real = chosen.filter("person LIKE 'l:%' AND object LIKE 'r:%'")
    last = real.select(F.expr("substring(person, 3)").alias("left"), F.expr("substring(object, 3)").alias("right"), "value")
    return Matching(pairs.unionByName(last), sure_total + total, sure_total + bound, forced, rounds)


def _last_resort(idle: DataFrame, held: DataFrame, first: int, last: int) -> DataFrame:
    """place, column for rows that no column they like is left to: the last column by
    name that is free or held by a later row. The k-th such row may go straight to the
    k-th column as long as all of them would be let in there."""
    mixed = (F.col("place") > first) & (F.col("place") < last)
    edge = held.agg(F.min(F.when(mixed, F.col("back"))).alias("edge")).first()["edge"]
    open_ = held.filter(F.col("place").isNull() | (F.col("place") > last))
    if edge is not None:
        open_ = open_.filter(F.col("back") < edge)
        if open_.isEmpty():
            return held.filter(F.col("back") == edge).select(F.lit(first).cast("long").alias("place"), "column")
    ranked = order.number_by_range(idle.select("place"), ["place"], "_k")
    columns = order.number_by_range(open_.select("column", "back"), ["back"], "_k")
    return ranked.join(columns, "_k").select("place", "column")


def choose_in_order(rows: DataFrame, columns: DataFrame, worth: DataFrame) -> DataFrame:
    """place, column: in the order of ``place`` each row takes, of the columns still
    free, the one worth most to it (ties and columns worth nothing: the last by name).

    rows: place (0, 1, ...); columns: column; worth: place, column, n > 0. Since all
    columns prefer the earlier row, the outcome is the one stable matching, and rows may
    apply at the same time: each to the best column that no earlier row holds, each
    column keeping the earliest applicant, until nobody is turned away any more."""
    held = written(order.number_by_range(columns.select("column").distinct(), [F.desc("column")], "back").withColumn("place", F.lit(None).cast("long")), "matching")
    while True:
        idle = rows.select("place").join(held.select("place"), "place", "left_anti")
        holder = held.select("column", F.col("place").alias("_held"))
        wanted = worth.join(idle, "place", "left_semi").join(holder, "column").filter(F.col("_held").isNull() | (F.col("_held") > F.col("place")))
        best = wanted.groupBy("place").agg(F.max(F.struct("n", "column")).alias("_b")).select("place", F.col("_b.column").alias("column"))
        applying = written(idle.join(best, "place", "left"), "matching")
        without = F.when(F.col("column").isNull(), F.col("place"))
        hopeful, first, last = applying.agg(F.count("column"), F.min(without), F.max(without)).first()
        proposals = applying.filter("column IS NOT NULL")
        if first is not None:
            resort = written(_last_resort(applying.filter("column IS NULL"), held, first, last), "matching")
            hopeful += resort.count()
            proposals = proposals.unionByName(resort)
        if not hopeful:
            return held.filter("place IS NOT NULL").select("place", "column")
        kept = proposals.groupBy("column").agg(F.min("place").alias("_new"))
        held = written(held.join(kept, "column", "left").withColumn("place", F.least("place", "_new")).drop("_new"), "matching")
