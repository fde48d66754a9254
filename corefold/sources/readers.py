"""Readers of the annotation and feature files. Each gives plain tables; write
them to parquet once and work from there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corefold.operators import order
from corefold.operators.media import BOX

SPAN = "array<array<string>>"
MENTION_SCHEMA = """doc_id string, subtopic string, m_id string, sentence_id long, tokens_ids array<bigint>, tokens string, event_type string,
    entity_type string, arguments array<struct<start: bigint, end: bigint, role: string, text: string, tokens: string, entity_type: string>>, cluster_id long,
    singleton boolean, head_lemma string, pos_tag string, word_class string"""
IE_SCHEMA = f"doc_id string, sent_id string, tokens array<string>, token_ids array<string>, graph struct<triggers: {SPAN}, entities: {SPAN}, roles: {SPAN}>"
SENTENCE_SCHEMA = """sentence_id string, image string, words array<string>,
    `golden-entity-mentions` array<struct<start: bigint, end: bigint, text: string, `entity-type`: string, cluster: string>>,
    `golden-event-mentions` array<struct<trigger: struct<start: bigint, end: bigint, text: string>, event_type: string, cluster: string,
        arguments: array<struct<start: bigint, end: bigint, role: string, text: string, `entity-type`: string>>>>"""
ACE_SCHEMA = """doc_id string, sent_id string, tokens array<string>,
    entity_mentions array<struct<id: string, text: string, start: bigint, end: bigint, entity_type: string>>,
    event_mentions array<struct<id: string, event_type: string, trigger: struct<text: string, start: bigint, end: bigint>,
        arguments: array<struct<entity_id: string, text: string, role: string>>>>"""
DIALOGUE_SCHEMA = """doc_key string, sentences array<array<string>>, clusters array<array<array<bigint>>>,
    pronoun_info array<struct<current_pronoun: array<bigint>, candidate_NPs: array<array<bigint>>, correct_NPs: array<array<bigint>>>>,
    object_detection array<bigint>"""


def read_token_documents(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """JSON maps doc -> [[sent, token id, token, flag(, tag)]], one map per line or
    one per file. A document may be spread over several maps."""
    lines = spark.read.text(path, wholetext=whole_file)
    maps = lines.select(F.from_json("value", f"map<string,{SPAN}>").alias("_m"))
    rows = maps.select(F.explode("_m").alias("doc", "_t")).select("doc", F.explode("_t").alias("_t"))
    field = lambda i: F.get("_t", F.lit(i))
    return rows.select(
        "doc", field(0).cast("long").alias("sent"), field(1).cast("long").alias("tid"), field(2).alias("tok"),
        (F.lower(field(3)) == "true").alias("flag"), field(4).alias("tag"),
    )


def read_mentions(spark: SparkSession, path: str, kind: str, array_file: bool = False) -> DataFrame:
    """JSON mention records, one per line or one array per file. Spans come from
    the token ids; texts from ``text`` or ``tokens``, whichever an argument has."""
    raw = spark.read.schema(MENTION_SCHEMA).json(path, multiLine=array_file)
    arguments = F.transform(
        "arguments",
        lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"), a["role"].alias("role"), F.coalesce(a["text"], a["tokens"]).alias("text"), a["entity_type"].alias("entity_type")),
    )
    return raw.withColumn("arguments", arguments).withColumn("kind", F.lit(kind)).withColumn(
        "m_start", F.coalesce(F.array_min("tokens_ids"), F.lit(-1))
    ).withColumn("m_end", F.coalesce(F.array_max("tokens_ids"), F.lit(-1)))


def read_ie_sentences(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Information-extraction output, one sentence per line. triggers, entities:
    doc, sent, n, start, end (half open), type, score; roles: doc, sent, trigger,
    entity, role, score by number in the sentence."""
    raw = spark.read.schema(IE_SCHEMA).json(path)

    def spans(field: str) -> DataFrame:
        rows = raw.select(F.col("doc_id").alias("doc"), F.col("sent_id").alias("sent"), F.posexplode(f"graph.{field}").alias("n", "_s"))
        part = lambda i: F.get("_s", F.lit(i))
        return rows.select(
            "doc", "sent", "n", part(0).cast("long").alias("start"), part(1).cast("long").alias("end"), part(2).alias("type"), part(3).cast("double").alias("score")
        )

    roles = spans("roles").select("doc", "sent", F.col("start").alias("trigger"), F.col("end").alias("entity"), F.col("type").alias("role"), "score")
    return {"sentences": raw.select(F.col("doc_id").alias("doc"), F.col("sent_id").alias("sent"), "tokens"), "triggers": spans("triggers"), "entities": spans("entities"), "roles": roles}


def read_sentence_annotations(spark: SparkSession, path: str, inclusive: bool, array_file: bool = False) -> dict[str, DataFrame]:
    """Gold sentences: entities and events with inclusive or half-open ends, as
    inclusive token spans of the sentence, and the events' arguments."""
    raw = spark.read.schema(SENTENCE_SCHEMA).json(path, multiLine=array_file)
    cut = 0 if inclusive else 1
    entities = raw.select("sentence_id", F.explode("golden-entity-mentions").alias("_m")).select(
        "sentence_id", F.col("_m.start").alias("m_start"), (F.col("_m.end") - cut).alias("m_end"), F.col("_m.text").alias("text"),
        F.col("_m.entity-type").alias("type"), F.col("_m.cluster").alias("cluster"),
    )
    events = raw.select("sentence_id", F.posexplode("golden-event-mentions").alias("n", "_m"))
    triggers = events.select(
        "sentence_id", "n", F.col("_m.trigger.start").alias("m_start"), (F.col("_m.trigger.end") - cut).alias("m_end"), F.col("_m.trigger.text").alias("text"),
        F.col("_m.event_type").alias("type"), F.col("_m.cluster").alias("cluster"),
    )
    arguments = events.select("sentence_id", "n", F.explode("_m.arguments").alias("_a")).select(
        "sentence_id", "n", F.col("_a.start").alias("a_start"), (F.col("_a.end") - cut).alias("a_end"), F.col("_a.role").alias("role"), F.col("_a.entity-type").alias("entity_type")
    )
    return {"entities": entities, "events": triggers, "arguments": arguments}


def read_ace_sentences(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Sentences with mentions whose ids read <cluster>-<n>. Mentions carry the
    cluster key, empty where a cluster has one mention only."""
    raw = spark.read.schema(ACE_SCHEMA).json(path)
    key = F.regexp_replace("m_id", "-[^-]*$", "")
    entities = raw.select("doc_id", "sent_id", F.explode("entity_mentions").alias("_m")).select(
        "doc_id", "sent_id", F.lit("entity").alias("kind"), F.col("_m.id").alias("m_id"), F.col("_m.start").alias("start"), F.col("_m.end").alias("end"), F.col("_m.entity_type").alias("type")
    )
    events = raw.select("doc_id", "sent_id", F.explode("event_mentions").alias("_m"))
    triggers = events.select(
        "doc_id", "sent_id", F.lit("event").alias("kind"), F.col("_m.id").alias("m_id"), F.col("_m.trigger.start").alias("start"), F.col("_m.trigger.end").alias("end"), F.col("_m.event_type").alias("type")
    )
    arguments = events.select("doc_id", F.col("_m.id").alias("m_id"), F.explode("_m.arguments").alias("_a")).select("doc_id", "m_id", "_a.entity_id", "_a.role")
    mentions = entities.unionByName(triggers).withColumn("_key", key)
    sizes = mentions.groupBy("doc_id", "kind", "_key").agg(F.count("*").alias("_n"))
    keyed = mentions.join(sizes, ["doc_id", "kind", "_key"]).withColumn("cluster_key", F.when(F.col("_n") > 1, F.col("_key")).otherwise("")).drop("_n", "_key")
    return {"mentions": keyed, "arguments": arguments}


def _stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)


def read_standoff(spark: SparkSession, path: str, tagged: bool = False) -> dict[str, DataFrame]:
    """Stand-off lines: ``T id type start end text``, ``E id type:trigger role:id``
    and ``* EntityCoref|EventCoref id id``. The document is the file name, or with
    ``tagged`` the part of each line before a tab."""
    if tagged:
        parts = F.split("value", "\t", 2)
        lines = spark.read.text(path).select(F.get(parts, F.lit(0)).alias("doc"), F.get(parts, F.lit(1)).alias("line"))
    else:
        lines = spark.read.text(path).select(_stem().alias("doc"), F.col("value").alias("line"))
    words = lines.filter(F.length(F.trim("line")) > 0).select("doc", F.split("line", r"[ \t]+").alias("w"))
    word = lambda i: F.get("w", F.lit(i))
    kind = F.substring(word(0), 1, 1)
    mentions = words.filter(kind == "T").select(
        "doc", word(0).alias("m_id"), word(1).alias("type"), word(2).cast("long").alias("c_from"), (word(3).cast("long") - 1).alias("c_to"),
        F.array_join(F.slice("w", F.lit(5), F.size("w")), " ").alias("text"),
    )
    event = words.filter(kind == "E").select("doc", word(0).alias("e_id"), F.split(word(1), ":").alias("_t"), F.slice("w", F.lit(3), F.size("w")).alias("_r"))
    events = event.select("doc", "e_id", F.get("_t", F.lit(0)).alias("type"), F.get("_t", F.lit(1)).alias("trigger"))
    roles = event.select("doc", "e_id", F.explode("_r").alias("_r")).select(
        "doc", "e_id", F.substring_index("_r", ":", 1).alias("role"), F.substring_index("_r", ":", -1).alias("m_id")
    )
    sets = words.filter(kind == "*").select("doc", word(1).alias("kind"), F.slice("w", F.lit(3), F.size("w")).alias("_m"))
    coreference = sets.select("doc", "kind", F.array_join("_m", " ").alias("set"), F.explode("_m").alias("m_id"))
    return {"mentions": mentions, "events": events, "roles": roles, "coreference": coreference}


def non_empty_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the files that have at least one non-blank line."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    return lines.select(F.col("_metadata.file_path").alias("file")).distinct()


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """``doc caption words``."""
    words = F.split("value", " ")
    return spark.read.text(path).select(F.get(words, F.lit(0)).alias("doc"), F.slice(words, F.lit(2), F.size(words)).alias("words"))


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """``doc sentence cluster phrase words offset``."""
    words = F.split("value", " ")
    return spark.read.text(path).select(
        F.get(words, F.lit(0)).alias("doc"), F.get(words, F.lit(1)).cast("long").alias("sent"), F.get(words, F.lit(2)).alias("cluster"),
        F.array_join(F.slice(words, F.lit(4), F.size(words) - 4), " ").alias("phrase"), F.element_at(words, -1).cast("long").alias("offset"),
    )


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """``doc cluster x_min y_min x_max y_max``."""
    words = F.split("value", " ")
    return spark.read.text(path).select(
        F.get(words, F.lit(0)).alias("doc"), F.get(words, F.lit(1)).alias("cluster"), *[F.get(words, F.lit(i + 2)).cast("double").alias(c) for i, c in enumerate(BOX)]
    )


def read_word_vectors(spark: SparkSession, path: str, dim: int, vocabulary: DataFrame) -> DataFrame:
    """``word v1 .. vdim``; the word is all before the last ``dim`` fields. Words
    outside the vocabulary are dropped before their numbers are parsed."""
    words = F.split("value", " ")
    rows = spark.read.text(path).select(words.alias("_w"))
    named = rows.select(F.array_join(F.slice("_w", F.lit(1), F.size("_w") - dim), " ").alias("word"), F.slice("_w", -dim, dim).alias("_v"))
    return named.join(vocabulary.select("word"), "word", "left_semi").select("word", F.col("_v").cast("array<double>").alias("emb"))


def read_frame_features(spark: SparkSession, path: str, dim: int = 400, frame_column: str = "frame", doc_column: str | None = None) -> DataFrame:
    """CSV with a header; the last ``dim`` columns are the frame vector. The frame
    number is a column, since the row order of a file is not kept."""
    raw = spark.read.csv(path, header=True)
    vector = F.array(*[F.col(f"`{c}`").cast("double") for c in raw.columns[-dim:]])
    doc = F.col(doc_column) if doc_column else _stem()
    return raw.select(doc.alias("doc"), F.col(frame_column).cast("long").alias("frame"), vector.alias("emb"))


def read_dialogue_coref(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Dialogue coreference lines: spans (doc, m_start, m_end, cluster) with a new
    singleton cluster per candidate noun phrase that no cluster has, candidates
    (pronoun, candidate, label) and the visual label ids."""
    raw = spark.read.schema(DIALOGUE_SCHEMA).json(path)
    start, end = F.get("_s", F.lit(0)), F.get("_s", F.lit(1))
    clustered = (
        raw.select(F.col("doc_key").alias("doc"), F.posexplode("clusters").alias("cluster", "_c")).select("doc", "cluster", F.explode("_c").alias("_s"))
        .select("doc", start.alias("m_start"), end.alias("m_end"), F.col("cluster").cast("long").alias("cluster"))
    )
    info = raw.select(F.col("doc_key").alias("doc"), F.size("clusters").alias("_n"), F.explode("pronoun_info").alias("_p"))
    pairs = info.select(
        "doc", "_n", F.get("_p.current_pronoun", F.lit(0)).alias("p_start"), F.get("_p.current_pronoun", F.lit(1)).alias("p_end"),
        F.col("_p.correct_NPs").alias("_ok"), F.explode("_p.candidate_NPs").alias("_s"),
    )
    candidates = pairs.select("doc", "p_start", "p_end", start.alias("m_start"), end.alias("m_end"), F.array_contains("_ok", F.col("_s")).alias("label"))
    unseen = (
        pairs.select("doc", "_n", start.alias("m_start"), end.alias("m_end")).distinct()
        .join(clustered, ["doc", "m_start", "m_end"], "left_anti")
    )
    singles = order.number_rows(unseen, ["doc"], ["m_start", "m_end"], order.blocks_of(F.col("m_start"), 65536), "_k").select(
        "doc", "m_start", "m_end", (F.col("_n") + F.col("_k")).alias("cluster")
    )
    labels = raw.select(F.col("doc_key").alias("doc"), F.explode("object_detection").alias("label"))
    return {"spans": clustered.unionByName(singles), "candidates": candidates, "labels": labels}
