"""Documents to a training corpus in five stages, each one operator of corefold.llm.

A stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of
documents; the last adds what it encodes. Extra columns travel along untouched.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corefold.llm import byte_bpe, common, decontamination, language, line_dedup, near_duplicates

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what is in no language: null texts and texts without a letter. The
    predicted language replaces ``lang``. The model learns from rows not held out."""
    model = language.train(docs.filter(~language.held_out()))
    aside = {c: f"__own_{c}" for c in ("lang_pred", "score") if c in docs.columns}
    found = language.predict(docs.withColumnsRenamed(aside), model).filter(F.col("lang_pred") != "und")
    found = found.withColumn("lang", F.col("lang_pred")).drop("lang_pred", "score")
    return found.withColumnsRenamed({own: c for c, own in aside.items()}).select(*docs.columns)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that repeat an earlier one; every document stays."""
    return line_dedup.dedup(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest doc_id, one without
    doc_id only where no other has one. A document is its doc_id and text, so rows that
    share a doc_id, or have none, stand and fall by their own text. Five words a
    shingle, similarity 0.8."""
    # 63 bits, as components() keeps the numbers above for rows without a key.
    rows = docs.withColumn("__row", F.shiftright(F.xxhash64("doc_id", "text"), 1))
    groups = near_duplicates.components(rows, key="__row").select(F.col("doc_id").alias("__row"), "component_id").distinct()
    own = rows.groupBy("__row").agg(F.count("*").alias("__n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("__id"))
    placed = own.join(groups, "__row")
    first = placed.groupBy("component_id").agg(F.min(F.struct("__id", "__row"))["__row"].alias("__first"))
    # Most rows stand alone: those that go or repeat are named and sent to the texts, which stay where they are.
    stays = F.col("__row") == F.col("__first")
    aside = placed.join(first, "component_id").filter(~stays | (F.col("__n") > 1)).select("__row", stays.alias("__stays"))
    aside = common.broadcast_if_small(common.written(aside, "near-copies"))
    alone = rows.join(aside, "__row", "left_anti")
    once = rows.join(aside.filter("__stays"), "__row", "left_semi").dropDuplicates(["doc_id", "text"])
    return alone.unionByName(once).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a benchmark covers a twentieth or more, each by its
    own text: others with the same doc_id, or with none, stay."""
    found = decontamination.find(docs, common.table(spark, sf_dir, "benchmark"), with_key=True)
    bad = found.filter(decontamination.contaminated()).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    k1, k2 = common.row_key("doc_id", "text")
    return docs.withColumns({"__k1": k1, "__k2": k2}).join(bad, ["__k1", "__k2"], "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens, ids and round_trip, whether the ids decode to the text's bytes;
    where the caller has a column of that name, the added one is called bpe_... ."""
    made = ("n_tokens", "ids", "decoded", "round_trip")
    aside = {c: f"__own_{c}" for c in made if c in docs.columns}
    encoded = byte_bpe.encode(docs.withColumnsRenamed(aside), VOCABULARY, public_tokenizers.PATTERN)
    back = byte_bpe.decode(encoded, VOCABULARY, public_tokenizers.PATTERN)
    whole = back.withColumn("round_trip", F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).drop("decoded")
    return whole.withColumnsRenamed({c: f"bpe_{c}" for c in aside}).withColumnsRenamed({own: c for c, own in aside.items()})


STAGES = [
    ("language_id", identify_language), ("line_dedup", deduplicate_lines), ("near_duplicates", remove_near_duplicates), ("decontamination", decontaminate), ("byte_bpe", encode),
]

#: Predictions, edit distances and tokenizers have no SQL; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
