"""Evaluation: pairwise, MUC, B-cubed, CEAF-e, curves and averaged F1.

``labelled`` tables are (doc, idx, gold, pred) with 0 for no cluster. Pair counts
come from cluster sizes, never from pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corefold.operators import order
from corefold.operators.matching import Matching, best_matching
from corefold.session import cut_lineage


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def f_one(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def with_prf(counts: DataFrame) -> DataFrame:
    """tp, fp, fn, tn -> accuracy, precision, recall, f1; zero denominators give 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        counts.withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", f_one(F.col("precision"), F.col("recall")))
    )


def binary_prf(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """From explicit decisions (pred, label), 1 is positive."""
    p, y = F.col("pred") == 1, F.col("label") == 1
    counts = rows.groupBy(*keys).agg(
        F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn")
    )
    return with_prf(counts)


def _cells(labelled: DataFrame, *keys: str) -> DataFrame:
    """Mentions per (doc, gold, pred) with the sizes of the gold cluster, of the
    predicted cluster and of the document."""
    cells = labelled.groupBy("doc", "gold", "pred", *keys).agg(F.count("*").alias("n"))
    cell = cells.groupBy("doc", "gold", "pred").agg(F.sum("n").alias("n_cell"))
    gold = cell.groupBy("doc", "gold").agg(F.sum("n_cell").alias("n_gold"))
    pred = cell.groupBy("doc", "pred").agg(F.sum("n_cell").alias("n_pred"))
    docs = gold.groupBy("doc").agg(F.sum("n_gold").alias("n_doc"))
    return cells.join(cell, ["doc", "gold", "pred"]).join(gold, ["doc", "gold"]).join(pred, ["doc", "pred"]).join(docs, "doc")


def _pair_sums(cells: DataFrame, *keys: str) -> DataFrame:
    """Pairs seen from each mention: its partners of the same clusters."""
    n = F.col("n")

    def partners(size: str, *clusters: str) -> Column:
        held = F.lit(True)
        for c in clusters:
            held = held & (F.col(c) > 0)
        return F.sum(F.when(held, n * (F.col(size) - 1)).otherwise(0))

    sums = cells.groupBy(*keys).agg(
        partners("n_cell", "gold", "pred").alias("tp"), partners("n_gold", "gold").alias("_g"),
        partners("n_pred", "pred").alias("_p"), partners("n_doc").alias("_all"),
    )
    return sums.select(
        *keys, "tp", (F.col("_p") - F.col("tp")).alias("fp"), (F.col("_g") - F.col("tp")).alias("fn"),
        (F.col("_all") - F.col("_p") - F.col("_g") + F.col("tp")).alias("tn"),
    )


def pairwise_prf(labelled: DataFrame) -> DataFrame:
    """Over all mention pairs of each document. Every pair is seen from both of
    its mentions, so the sums are halved."""
    sums = _pair_sums(_cells(labelled))
    return with_prf(sums.select(*[(F.col(c) / 2).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")]))


def pairwise_by_type(labelled: DataFrame, kind: str = "type") -> DataFrame:
    """A pair counts for the type of each member, twice if they are equal: just the
    sums seen from the mentions of a type."""
    return with_prf(_pair_sums(_cells(labelled, kind), kind))


def all_positive_baseline(labelled: DataFrame) -> DataFrame:
    return pairwise_prf(labelled.withColumn("pred", F.lit(1)))


def clusters_for_scoring(labelled: DataFrame, keep_singletons: bool = False) -> DataFrame:
    """side, doc, cluster, idx. Gold: every label above 0. Predicted: clusters of
    at least two mentions unless ``keep_singletons``."""
    gold = labelled.filter("gold > 0").select(F.lit("gold").alias("side"), "doc", F.col("gold").alias("cluster"), "idx")
    pred = labelled.filter("pred > 0")
    if not keep_singletons:
        big = pred.groupBy("doc", "pred").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
        pred = pred.join(big, ["doc", "pred"], "left_semi")
    return gold.unionByName(pred.select(F.lit("pred").alias("side"), "doc", F.col("pred").alias("cluster"), "idx"))


def _drop_single_predictions(labelled: DataFrame) -> DataFrame:
    sizes = labelled.filter("pred > 0").groupBy("doc", "pred").agg(F.count("*").alias("_n"))
    return (
        labelled.join(sizes, ["doc", "pred"], "left")
        .withColumn("pred", F.when(F.col("_n") > 1, F.col("pred")).otherwise(0)).drop("_n")
    )


def _overlaps(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("doc", "gold", "pred").agg(F.count("*").alias("n"))


def _link_score(cells: DataFrame, side: str, other: str) -> DataFrame:
    """Numerator and denominator of the link score of the clusters of ``side``."""
    parts = F.when(F.col(other) > 0, 1).otherwise(F.col("n"))
    clusters = cells.filter(F.col(side) > 0).groupBy("doc", side).agg(F.sum("n").alias("_size"), F.sum(parts).alias("_parts"))
    return clusters.agg(
        F.coalesce(F.sum(F.col("_size") - F.col("_parts")), F.lit(0)).alias("num"), F.coalesce(F.sum(F.col("_size") - 1), F.lit(0)).alias("den")
    )


def _prf_of(precision: DataFrame, recall: DataFrame, metric: str) -> DataFrame:
    """Two one-row tables (num, den) as one row of scores."""
    both = precision.select(F.lit("p").alias("_s"), "num", "den").unionByName(recall.select(F.lit("r").alias("_s"), "num", "den"))
    wide = both.groupBy().agg(
        *[F.sum(F.when(F.col("_s") == s, F.col(c))).alias(f"{s}_{c}") for s in ("p", "r") for c in ("num", "den")]
    )
    p, r = ratio(F.col("p_num"), F.col("p_den")), ratio(F.col("r_num"), F.col("r_den"))
    return wide.select(F.lit(metric).alias("metric"), p.alias("precision"), r.alias("recall")).withColumn(
        "f1", f_one(F.col("precision"), F.col("recall"))
    )


def muc(labelled: DataFrame) -> DataFrame:
    cells = _overlaps(_drop_single_predictions(labelled))
    return _prf_of(_link_score(cells, "pred", "gold"), _link_score(cells, "gold", "pred"), "muc")


def b_cubed(labelled: DataFrame, keep_singletons: bool = False) -> DataFrame:
    """Squared overlaps over cluster size. Without ``keep_singletons`` clusters of
    one mention are skipped on both sides, as the usual scorer does."""
    cells = _overlaps(labelled if keep_singletons else _drop_single_predictions(labelled))

    def side(mine: str, other: str) -> DataFrame:
        sizes = cells.groupBy("doc", other).agg(F.sum("n").alias("_other"))
        joined = cells.filter(F.col(mine) > 0).join(sizes, ["doc", other])
        counted = (F.col(other) > 0) & (F.lit(keep_singletons) | (F.col("_other") > 1))
        per = joined.groupBy("doc", mine).agg(
            F.sum("n").alias("_size"), F.sum(F.when(counted, F.col("n") * F.col("n")).otherwise(0)).alias("_hit")
        )
        per = per if keep_singletons else per.filter("_size > 1")
        return per.agg(
            F.coalesce(F.sum(F.col("_hit") / F.col("_size")), F.lit(0.0)).alias("num"), F.coalesce(F.sum("_size"), F.lit(0)).cast("double").alias("den")
        )

    return _prf_of(side("pred", "gold"), side("gold", "pred"), "b_cubed")


def ceaf_overlaps(labelled: DataFrame, keep_singletons: bool = False) -> DataFrame:
    """doc, gold, pred, phi = 2 |P & G| / (|P| + |G|) for the clusters that share
    mentions. Predicted clusters of one mention are dropped, gold ones kept."""
    rows = labelled if keep_singletons else _drop_single_predictions(labelled)
    cells = _overlaps(rows)
    gold = cells.filter("gold > 0").groupBy("doc", "gold").agg(F.sum("n").alias("_g"))
    pred = cells.filter("pred > 0").groupBy("doc", "pred").agg(F.sum("n").alias("_p"))
    return (
        cells.filter("gold > 0 AND pred > 0").join(gold, ["doc", "gold"]).join(pred, ["doc", "pred"])
        .select("doc", "gold", "pred", (2 * F.col("n") / (F.col("_g") + F.col("_p"))).alias("phi"))
    )


def ceaf_matching(labelled: DataFrame, keep_singletons: bool = False, tolerance: float = 1e-7) -> Matching:
    """The best one-to-one choice of the overlapping clusters by phi, from rounds over
    all documents at once; ``left`` and ``right`` of its pairs are doc|gold and doc|pred."""
    edges = ceaf_overlaps(labelled, keep_singletons)
    return best_matching(edges.select(F.concat_ws("|", "doc", "gold").alias("left"), F.concat_ws("|", "doc", "pred").alias("right"), F.col("phi").alias("value")), tolerance)


def ceaf_e(labelled: DataFrame, keep_singletons: bool = False, tolerance: float = 1e-7) -> DataFrame:
    """Total phi of the best one-to-one choice over the number of clusters of either
    side; a larger choice than that plus ``tolerance`` per cluster does not exist."""
    total = ceaf_matching(labelled, keep_singletons, tolerance).total
    rows = labelled if keep_singletons else _drop_single_predictions(labelled)

    def side(cluster: str) -> DataFrame:
        count = rows.filter(F.col(cluster) > 0).select("doc", cluster).distinct().agg(F.count("*").cast("double").alias("den"))
        return count.select(F.lit(total).alias("num"), "den")

    return _prf_of(side("pred"), side("gold"), "ceaf_e")


def conll_average(labelled: DataFrame) -> DataFrame:
    labelled = cut_lineage(labelled)
    scores = muc(labelled).unionByName(b_cubed(labelled)).unionByName(ceaf_e(labelled))
    return average_scores(scores)


def average_scores(scores: DataFrame) -> DataFrame:
    return scores.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def pr_curve(rows: DataFrame) -> DataFrame:
    """(score, label) -> one row per distinct score, from the highest down, with
    precision, recall and f1 of predicting that score and above. Rows are counted
    per score first."""
    points = rows.groupBy("score").agg(F.count("*").alias("_n"), F.sum((F.col("label") == 1).cast("long")).alias("_y"))
    seen = order.running_totals_by_range(points, [F.desc("score")], {"n": F.col("_n"), "tp": F.col("_y")})
    positives = points.agg(F.coalesce(F.sum("_y"), F.lit(0)).alias("v")).first()["v"]
    return (
        seen.withColumn("precision", F.col("tp") / F.col("n"))
        .withColumn("recall", ratio(F.col("tp").cast("double"), F.lit(float(positives))))
        .withColumn("f1", f_one(F.col("precision"), F.col("recall")))
        .withColumn("gain", ratio(F.col("_y").cast("double"), F.lit(float(positives))))
        .drop("_n", "_y")
    )


def average_precision(curve: DataFrame) -> DataFrame:
    return curve.agg(
        F.sum(F.col("gain") * F.col("precision")).alias("average_precision"), F.max("f1").alias("best_f1"),
        F.max_by("score", F.struct(F.round("f1", 9), "score")).alias("threshold"),
    )


def class_scores(rows: DataFrame) -> DataFrame:
    """(pred, label) classes -> per class tp, fp, fn and scores, by counting each
    decision once for its prediction and once for its label."""
    cells = rows.groupBy("pred", "label").agg(F.count("*").alias("_n"))
    hit = F.col("pred") == F.col("label")
    as_pred = cells.select(F.col("pred").alias("cls"), F.when(hit, F.col("_n")).otherwise(0).alias("tp"), F.when(hit, 0).otherwise(F.col("_n")).alias("fp"), F.lit(0).alias("fn"))
    as_label = cells.filter(~hit).select(F.col("label").alias("cls"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.col("_n").alias("fn"))
    sums = as_pred.unionByName(as_label).groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f_one(F.col("precision"), F.col("recall")))


def f1_averages(rows: DataFrame) -> DataFrame:
    """micro, macro and weighted (by true count) scores."""
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    support = F.col("tp") + F.col("fn")
    return class_scores(rows).agg(
        ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"), F.avg("f1").alias("macro_f1"),
        ratio(F.sum(F.col("f1") * support), F.sum(support).cast("double")).alias("weighted_f1"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
    )


def document_macro_scores(labelled: DataFrame) -> DataFrame:
    """Mean of the per-document pairwise scores over documents with gold links."""
    sums = _pair_sums(_cells(labelled), "doc")
    docs = with_prf(sums.select("doc", *[(F.col(c) / 2).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")]))
    return docs.filter("tp + fn > 0").agg(
        F.count("*").alias("n_docs"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")]
    )
