"""Vocabularies, cluster ids, confusion tables and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corefold.functions import text as X
from corefold.operators import order
from corefold.operators.matching import choose_in_order


def build_vocab(words: DataFrame, specials: Sequence[str] = (X.NULL_TEXT,)) -> DataFrame:
    """(word, doc, idx) -> word, n, id: ids in order of first sighting after the
    special words, which take the first ids with count 0."""
    seen = words.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("doc", "idx")).alias("_first"))
    numbered = order.number_by_range(seen, ["_first.doc", "_first.idx", "word"], "id", start=len(specials)).select("word", "n", "id")
    spark = words.sparkSession
    head = spark.createDataFrame([(w, 0, i) for i, w in enumerate(specials)], "word string, n long, id long")
    return head.unionByName(numbered)


def build_role_vocab(arguments: DataFrame) -> DataFrame:
    """Distinct event_type.role sorted by event type, then role; NULL text is 0."""
    roles = arguments.select("e_type", "role").distinct()
    numbered = order.number_by_range(roles, ["e_type", "role"], "id", start=1)
    named = numbered.select(F.concat_ws(".", "e_type", "role").alias("name"), "id")
    null = arguments.sparkSession.createDataFrame([(X.NULL_TEXT, 0)], "name string, id long")
    return null.unionByName(named)


def build_ontology(entity_words: DataFrame, event_words: DataFrame, arguments: DataFrame) -> DataFrame:
    """kind, id, name: the three vocabularies side by side."""
    entities = build_vocab(entity_words).select(F.lit("entity").alias("kind"), "id", F.col("word").alias("name"))
    events = build_vocab(event_words).select(F.lit("event").alias("kind"), "id", F.col("word").alias("name"))
    roles = build_role_vocab(arguments).select(F.lit("argument").alias("kind"), "id", "name")
    return entities.unionByName(events).unionByName(roles)


def build_feature_vocab(mentions: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, value, id: per feature in order of first sighting; numbers map to
    themselves."""
    melted = mentions.select(
        "doc", "idx", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])).alias("_f")
    ).select("doc", "idx", "_f.*")
    seen = melted.groupBy("feature", "value").agg(F.min(F.struct("doc", "idx")).alias("_first"))
    numeric = F.col("value").rlike("^[0-9]+$")
    words = order.number_by_range(seen.filter(~numeric), ["_first.doc", "_first.idx", "value"], "id", start=1, keys=["feature"]).select("feature", "value", "id")
    return words.unionByName(seen.filter(numeric).select("feature", "value", F.col("value").cast("long").alias("id")))


def type_frequency(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def assign_cluster_ids(mentions: DataFrame, singles_get_ids: bool = True) -> DataFrame:
    """Global ids from 1 for the annotated clusters in document order; mentions
    outside any get an id of their own or 0. One number space for all kinds."""
    in_cluster = F.col("cluster") > 0
    keyed = mentions.withColumn(
        "_key", F.when(in_cluster, F.struct(F.lit(0).alias("single"), F.col("cluster").alias("n"))).otherwise(F.struct(F.lit(1).alias("single"), F.col("idx").alias("n")))
    )
    wanted = keyed if singles_get_ids else keyed.filter(in_cluster)
    heads = wanted.groupBy("doc", "_key").agg(F.min("idx").alias("_first"))
    numbered = order.number_by_range(heads, ["doc", "_first"], "cluster_id", start=1)
    return (
        keyed.join(numbered.drop("_first"), ["doc", "_key"], "left")
        .withColumn("cluster_id", F.coalesce("cluster_id", F.lit(0))).drop("_key")
    )


def cluster_stats(mentions: DataFrame) -> DataFrame:
    """Mentions, clusters and documents per kind; counted per (kind, doc) first."""
    clusters = mentions.groupBy("kind", "doc", "cluster").agg(F.count("*").alias("n"))
    docs = clusters.groupBy("kind", "doc").agg(F.sum("n").alias("n"), F.sum((F.col("cluster") > 0).cast("long")).alias("c"))
    return docs.groupBy("kind").agg(F.sum("n").alias("n_mentions"), F.sum("c").alias("n_clusters"), F.count("*").alias("n_docs"))


def clusters_min_size(mentions: DataFrame, n: int = 2) -> DataFrame:
    """doc, cluster, size of the clusters with at least ``n`` members."""
    return mentions.filter("cluster > 0").groupBy("doc", "cluster").agg(F.count("*").alias("size")).filter(F.col("size") >= n)


def trigger_types_by_dataset(rows: DataFrame) -> DataFrame:
    """(dataset, trigger, type) -> the sorted distinct types of each trigger."""
    return rows.distinct().groupBy("trigger", "dataset").agg(F.array_sort(F.collect_list("type")).alias("types"))


def type_confusion(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Counts type1 x type2 over the triggers that both datasets have, and shares
    per type1. Triggers are counted per type before they meet."""
    counted = rows.groupBy("dataset", "trigger", "type").agg(F.count("*").alias("_n"))
    a = counted.filter(F.col("dataset") == first).select("trigger", F.col("type").alias("type1"), F.col("_n").alias("_a"))
    b = counted.filter(F.col("dataset") == second).select("trigger", F.col("type").alias("type2"), F.col("_n").alias("_b"))
    table = a.join(b, "trigger").groupBy("type1", "type2").agg(F.count("*").alias("n"))
    totals = table.groupBy("type1").agg(F.sum("n").alias("_t"))
    return table.join(totals, "type1").withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def confusion_order(table: DataFrame) -> DataFrame:
    """Row places by largest share, then each row in turn takes its best column
    that is still free; columns left over follow by name. (axis, name, place)."""
    best = table.groupBy("type1").agg(F.max("share").alias("_best"))
    rows = order.number_by_range(best, [F.desc("_best"), "type1"], "place").drop("_best")
    worth = table.join(rows, "type1").filter("n > 0").select("place", F.col("type2").alias("column"), "n")
    columns = table.select(F.col("type2").alias("column")).distinct()
    chosen = choose_in_order(rows, columns, worth)
    left = columns.join(chosen, "column", "left_anti")
    last = order.number_by_range(left, ["column"], "place", start=rows.count())
    named = chosen.select("column", "place").unionByName(last.select("column", "place"))
    return rows.select(F.lit("row").alias("axis"), F.col("type1").alias("name"), "place").unionByName(
        named.select(F.lit("column").alias("axis"), F.col("column").alias("name"), "place")
    )


def alignment_confusion(aligned: DataFrame) -> DataFrame:
    """(predicted or null, label) counts; a null alignment shows as NULL text."""
    return aligned.groupBy(F.coalesce("predicted", F.lit(X.NULL_TEXT)).alias("predicted"), "label").agg(F.count("*").alias("n"))


def roles_per_event_type(arguments: DataFrame) -> DataFrame:
    """Roles of each event type, numbered in order of first sighting."""
    first = arguments.groupBy("e_type", "role").agg(F.min(F.struct("doc", "e_idx", "a_start")).alias("_first"))
    window = Window.partitionBy("e_type").orderBy("_first", "role")
    return first.withColumn("place", F.row_number().over(window) - 1).drop("_first")


def seed_summary(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population deviation over the seeds of each metric."""
    return results.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))


def first_event_per_sentence(mentions: DataFrame, known_types: DataFrame) -> DataFrame:
    known = mentions.join(known_types.select("type_name"), "type_name", "left_semi")
    row = F.struct("idx", "type_name", "tok")
    return known.groupBy("doc", "sent").agg(F.min_by(row, "idx").alias("_r")).select("doc", "sent", "_r.*")


def top_classes(rows: DataFrame, column: str, n: int) -> DataFrame:
    best = rows.groupBy(column).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), column).limit(n)
    return rows.join(best.select(column), column, "left_semi")


def score_by_cluster_count(results: DataFrame) -> DataFrame:
    return results.groupBy("n_clusters", "metric").agg(F.avg("value").alias("value"))


