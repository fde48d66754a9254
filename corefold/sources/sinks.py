"""Writers of the normalised tables and of the exchange formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def write_normalised(documents: DataFrame, events: DataFrame, entities: DataFrame, prefix: str) -> None:
    """documents and mentions as parquet; mentions are partitioned by split and
    kind, so the mixed table is their union by name."""
    documents.write.mode("overwrite").parquet(f"{prefix}/documents")
    mixed = events.withColumn("kind", F.lit("event")).unionByName(entities.withColumn("kind", F.lit("entity")), allowMissingColumns=True)
    mixed.write.mode("overwrite").partitionBy("split", "kind").parquet(f"{prefix}/mentions")


def conll_brackets(tokens: DataFrame, mentions: DataFrame) -> DataFrame:
    """Adds the bracketed cluster column: one-token mentions, then opening ones by
    end descending, then closing ones by start descending; - where there is none."""
    linked = mentions.filter("cluster > 0").select("doc", "m_start", "m_end", F.col("cluster").cast("string").alias("c"))
    single = linked.filter("m_start = m_end").select("doc", F.col("m_start").alias("tid"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("far"), F.concat(F.lit("("), "c", F.lit(")")).alias("mark"), "c")
    wide = linked.filter("m_start < m_end")
    opens = wide.select("doc", F.col("m_start").alias("tid"), F.lit(1).alias("part"), (-F.col("m_end")).alias("far"), F.concat(F.lit("("), "c").alias("mark"), "c")
    closes = wide.select("doc", F.col("m_end").alias("tid"), F.lit(2).alias("part"), (-F.col("m_start")).alias("far"), F.concat("c", F.lit(")")).alias("mark"), "c")
    marks = single.unionByName(opens).unionByName(closes).groupBy("doc", "tid").agg(F.array_sort(F.collect_list(F.struct("part", "far", "c", "mark"))).alias("_m"))
    return (
        tokens.join(marks, ["doc", "tid"], "left")
        .withColumn("clusters", F.coalesce(F.array_join(F.transform("_m", lambda m: m["mark"]), "|"), F.lit("-"))).drop("_m")
    )


def conll_lines(bracketed: DataFrame) -> DataFrame:
    """topic, doc, place, line: token lines between document markers."""
    subtopic = F.concat(F.col("topic"), F.lit("_"), F.when(F.col("doc").cast("string").contains("plus"), "1").otherwise("0"))
    token = F.concat_ws("\t", "topic", subtopic, F.col("doc").cast("string"), F.col("sent").cast("string"), F.col("tid").cast("string"), "tok", F.col("flag").cast("string"), "clusters")
    lines = bracketed.select("topic", "doc", F.col("tid").alias("place"), token.alias("line"))
    docs = bracketed.select("topic", "doc").distinct()
    begin = docs.select("topic", "doc", F.lit(-1).cast("long").alias("place"), F.concat(F.lit("#begin document "), F.col("doc").cast("string")).alias("line"))
    end = docs.select("topic", "doc", F.lit(2**62).cast("long").alias("place"), F.lit("#end document").alias("line"))
    return begin.unionByName(lines).unionByName(end)


def write_conll(lines: DataFrame, path: str) -> None:
    """One folder per topic. Range partitioning keeps documents in order and lets a
    large one span several files, in file order."""
    ordered = lines.repartitionByRange("topic", "doc", "place").sortWithinPartitions("topic", "doc", "place")
    ordered.select("topic", F.col("line").alias("value")).write.mode("overwrite").partitionBy("topic").text(path)


def standoff_lines(mentions: DataFrame, arguments: DataFrame) -> DataFrame:
    """doc, line: T lines with running ids and character spans for all mentions, E
    lines for events with their roles. ``mentions`` carry t_no, e_no (events), c_from,
    c_end (exclusive), type, text."""
    t_line = F.format_string("T%d %s %d %d %s", "t_no", "type", "c_from", "c_end", "text")
    named = arguments.join(mentions.select("doc", F.col("idx").alias("a_idx"), F.col("t_no").alias("_a")), ["doc", "a_idx"])
    roles = named.groupBy("doc", F.col("e_idx").alias("idx")).agg(
        F.array_sort(F.collect_list(F.struct("a_start", F.format_string("%s:T%d", "role_name", "_a").alias("r")))).alias("_r")
    )
    events = mentions.filter("kind = 'event'").join(roles, ["doc", "idx"], "left")
    listed = F.array_join(F.transform(F.coalesce("_r", F.array().cast("array<struct<a_start:bigint,r:string>>")), lambda s: s["r"]), " ")
    e_line = F.rtrim(F.concat(F.format_string("E%d %s:T%d ", "e_no", "type", "t_no"), listed))
    return mentions.select("doc", t_line.alias("line")).unionByName(events.select("doc", e_line.alias("line")))


def write_standoff(lines: DataFrame, path: str, tagged: bool = True) -> None:
    """Lines with the document in front (``tagged``), or one folder per document."""
    if tagged:
        lines.select(F.concat_ws("\t", F.col("doc").cast("string"), "line").alias("value")).write.mode("overwrite").text(path)
    else:
        lines.select("doc", F.col("line").alias("value")).repartition("doc").write.mode("overwrite").partitionBy("doc").text(path)


def write_pair_predictions(pairs: DataFrame, texts: DataFrame, path: str) -> None:
    """TSV: doc, text of i, text of j, label, score with two digits."""
    a = texts.select("doc", F.col("idx").alias("i"), F.col("text").alias("a"))
    b = texts.select("doc", F.col("idx").alias("j"), F.col("text").alias("b"))
    rows = pairs.join(a, ["doc", "i"]).join(b, ["doc", "j"]).select("doc", "a", "b", "label", F.format_string("%.2f", "score").alias("score"))
    rows.write.mode("overwrite").option("quote", "").csv(path, sep="\t")


def write_model_tables(tables: dict[str, DataFrame], path: str, fmt: str = "json") -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").format(fmt).save(f"{path}/{name}")


def export_dialogue_coref(sentences: DataFrame, mentions: DataFrame, labels: DataFrame, path: str) -> None:
    """One JSON line per document whose text labels meet its visual labels: its
    sentences, clusters, pronouns with candidate and correct noun phrases, and label
    ids. ``mentions`` carry label and mtype, ``labels`` is (doc, label, label_id).

    A line holds a document whole: that is the format."""
    shared = mentions.select("doc", "label").distinct().join(labels, ["doc", "label"])
    docs = shared.select("doc").distinct()
    ids = shared.groupBy("doc").agg(F.array_sort(F.collect_set("label_id")).alias("object_detection"))
    text = sentences.join(docs, "doc", "left_semi").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("sent", "words"))).alias("_s"))
    span = F.array("m_start", "m_end")
    kept = mentions.join(docs, "doc", "left_semi")
    clusters = (
        kept.filter("cluster > 0").groupBy("doc", "cluster").agg(F.array_sort(F.collect_list(span)).alias("_c"))
        .groupBy("doc").agg(F.array_sort(F.collect_list("_c")).alias("clusters"))
    )
    pronouns = kept.filter("mtype = 'pronoun'").select("doc", F.col("idx").alias("p_idx"), span.alias("_p"), F.col("cluster").alias("_pc"))
    near = pronouns.select("*", F.explode(F.sequence(F.greatest(F.col("p_idx") - 5, F.lit(0)), F.col("p_idx"))).alias("idx"))
    phrases = kept.filter("mtype <> 'pronoun'").select("doc", "idx", span.alias("_n"), F.col("cluster").alias("_nc"))
    met = near.join(phrases, ["doc", "idx"])
    right = F.when((F.col("_pc") > 0) & (F.col("_pc") == F.col("_nc")), F.col("_n"))
    info = (
        met.groupBy("doc", "p_idx", "_p").agg(F.array_sort(F.collect_list("_n")).alias("_all"), F.array_sort(F.collect_list(right)).alias("_ok"))
        .groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.col("_p").alias("current_pronoun"), F.col("_all").alias("candidate_NPs"), F.col("_ok").alias("correct_NPs")))).alias("pronoun_info"))
    )
    empty = "array<array<array<bigint>>>"
    rows = text.join(clusters, "doc", "left").join(info, "doc", "left").join(ids, "doc").select(
        F.to_json(
            F.struct(
                F.col("doc").cast("string").alias("doc_key"), F.transform("_s", lambda s: s["words"]).alias("sentences"),
                F.coalesce("clusters", F.array().cast(empty)).alias("clusters"), "pronoun_info", "object_detection",
            )
        ).alias("value")
    )
    rows.write.mode("overwrite").text(path)
