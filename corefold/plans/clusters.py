"""From links to clusters and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corefold.operators import order
from corefold.session import BROADCAST_ROWS, cut_lineage, packed


def roots_of_links(links: DataFrame) -> DataFrame:
    """(doc, idx, antecedent) -> doc, idx, root by pointer jumping: each round
    doubles the length of the jump, so a chain of n links takes log2(n) rounds."""
    jump = cut_lineage(
        links.select("doc", "idx", F.when(F.col("antecedent") >= 0, F.col("antecedent")).otherwise(F.col("idx")).alias("root"))
    )
    while True:
        over = jump.filter("root <> idx").select("doc", F.col("idx").alias("root"), F.col("root").alias("_next"))
        moved = cut_lineage(
            jump.join(over, ["doc", "root"], "left").select("doc", "idx", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_m"))
        )
        jump = moved.drop("_m")
        if moved.filter("_m").isEmpty():
            return jump


def antecedents_to_clusters(links: DataFrame) -> DataFrame:
    """doc, idx, root, cluster_id: ids from 1 over all documents in (doc, root) order."""
    rooted = roots_of_links(links)
    heads = rooted.filter("root = idx").select("doc", "root")
    ids = order.number_by_range(heads, ["doc", "root"], "cluster_id", start=1)
    return rooted.join(ids, ["doc", "root"])


def clusters_to_antecedents(mentions: DataFrame, label: str = "cluster") -> DataFrame:
    """Earliest earlier mention with the same label, else -1."""
    first = mentions.groupBy("doc", label).agg(F.min("idx").alias("_first"))
    return mentions.join(first, ["doc", label]).select(
        "doc", "idx", F.when(F.col("_first") < F.col("idx"), F.col("_first")).otherwise(-1).alias("antecedent")
    )


def threshold_antecedents(candidates: DataFrame, threshold: float) -> DataFrame:
    """Best earlier mention if its score is above the threshold, else -1."""
    best = candidates.filter("i >= 0").groupBy("doc", "j").agg(F.max(F.struct("score", (-F.col("i")).alias("_i"))).alias("_b"))
    every = candidates.select("doc", "j").distinct()
    return every.join(best, ["doc", "j"], "left").select(
        "doc", F.col("j").alias("idx"), F.when(F.col("_b.score") > threshold, -F.col("_b._i")).otherwise(-1).alias("antecedent")
    )


def visual_cluster_link(best: DataFrame) -> DataFrame:
    """(doc, idx, partner, is_action): a mention whose best partner is an action
    links to the first mention with that action, the others to their partner."""
    first = best.filter("is_action").groupBy("doc", "partner").agg(F.min("idx").alias("_first"))
    joined = best.join(first, ["doc", "partner"], "left")
    visual = F.when(F.col("_first") < F.col("idx"), F.col("_first")).otherwise(-1)
    return joined.select("doc", "idx", F.when(F.col("is_action"), visual).otherwise(F.col("partner")).alias("antecedent"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(src, dst) -> node, component (the smallest node of each component).

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the
    edges no longer change; every step is one grouped minimum and a join, and the
    number of rounds grows with the logarithm of the component size."""
    pairs = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    pairs = cut_lineage(pairs)
    before, size = None, pairs.count()
    while True:
        # Few edges lie in few partitions and stay where they are while the minima come to them.
        pairs = packed(pairs, size)
        near = F.broadcast if 2 * size <= BROADCAST_ROWS else (lambda rows: rows)
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(near(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        small_low = packed(large.groupBy("a").agg(F.min("b").alias("m")), size)
        with_low = large.join(near(small_low), "a")
        small = (
            with_low.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
            .unionByName(small_low.select("a", F.col("m").alias("b"))).distinct()
        )
        pairs = cut_lineage(packed(small, size))
        mark = pairs.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if before == mark:
            break
        before, size = mark, mark["n"]
    inner = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return nodes.join(inner, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
