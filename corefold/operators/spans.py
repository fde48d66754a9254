"""Tokens, spans and the normalised mention table.

Columns by convention: doc, sent, pos (in sentence), tid (in document), tok;
mentions carry idx (order in the document), m_start and m_end (both inclusive)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corefold.functions import text as X
from corefold.functions.vectors import let, pad_or_truncate
from corefold.operators import order
from corefold.session import cut_lineage


def doc_token_offset(sentences: DataFrame) -> DataFrame:
    """doc, sent, n -> base: tokens of the earlier sentences of the document."""
    return order.running_total(
        sentences, ["doc"], ["sent"], order.blocks_of(F.col("sent"), 4096), F.col("n"), "base"
    )


def mention_span(token_ids: Column) -> tuple[Column, Column]:
    """First and last token of a list; -1 for an empty one."""
    return (
        F.coalesce(F.array_min(token_ids), F.lit(-1)),
        F.coalesce(F.array_max(token_ids), F.lit(-1)),
    )


def token_ids(start: Column, end: Column, inclusive: bool = True) -> Column:
    last = end if inclusive else end - 1
    return F.when(last >= start, F.sequence(start, last)).otherwise(F.array().cast("array<bigint>"))


def covered_tokens(mentions: DataFrame, *carry: str) -> DataFrame:
    """One row per (mention, token it covers): doc, tid and the carried columns."""
    return mentions.select(
        "doc", *carry, F.explode(token_ids(F.col("m_start"), F.col("m_end"))).alias("tid")
    )


def span_text(mentions: DataFrame, tokens: DataFrame, *keys: str) -> DataFrame:
    """Tokens of each span joined by a space; keyed by doc and ``keys``."""
    covered = covered_tokens(mentions, *keys)
    words = covered.join(tokens.select("doc", "tid", "tok"), ["doc", "tid"])
    listed = words.groupBy("doc", *keys).agg(
        F.array_sort(F.collect_list(F.struct("tid", "tok"))).alias("_w")
    )
    return listed.select(
        "doc", *keys, F.array_join(F.transform("_w", lambda s: s["tok"]), " ").alias("text")
    )


def mention_mask(tokens: DataFrame, mentions: DataFrame) -> DataFrame:
    marked = covered_tokens(mentions).distinct().withColumn("flag", F.lit(True))
    return tokens.join(marked, ["doc", "tid"], "left").withColumn("flag", F.coalesce("flag", F.lit(False)))


def char_offsets(tokens: DataFrame) -> DataFrame:
    """c_start, c_end of each token when the words of a sentence are joined by
    one blank."""
    placed = order.running_total(
        tokens, ["doc", "sent"], ["pos"], order.blocks_of(F.col("pos"), 65536),
        F.length("raw") + 1, "c_start",
    )
    return placed.withColumn("c_end", F.col("c_start") + F.length("raw") - 1)


def char_to_token_span(intervals: DataFrame, tokens: DataFrame, bucket: int = 64) -> DataFrame:
    """(m_id, doc, sent, c_from, c_to) -> first and last overlapping token that is
    not punctuation; intervals without one are dropped.

    Both sides are keyed by the character buckets they touch, so the overlap test
    runs inside (doc, sent, bucket)."""

    def buckets(lo: str, hi: str) -> Column:
        return F.explode(
            F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.greatest(lo, hi) / bucket))
        ).alias("_b")

    left = intervals.select("m_id", "doc", "sent", "c_from", "c_to", buckets("c_from", "c_to"))
    right = tokens.filter(~F.col("raw").isin(X.SPAN_PUNCTUATION)).select(
        "doc", "sent", "tid", "c_start", "c_end", buckets("c_start", "c_end")
    )
    return (
        left.join(right, ["doc", "sent", "_b"])
        .filter((F.col("c_to") >= F.col("c_start")) & (F.col("c_end") >= F.col("c_from")))
        .groupBy("m_id", "doc", "sent")
        .agg(F.min("tid").alias("m_start"), F.max("tid").alias("m_end"))
    )


def merge_trigger_entities(entities: DataFrame, triggers: DataFrame) -> DataFrame:
    """Entities marked ``Event`` on the span of a trigger take the event's id."""
    marked = triggers.select("doc", "c_from", "c_to", F.col("event_id").alias("_event"))
    return (
        entities.join(marked, ["doc", "c_from", "c_to"], "left")
        .withColumn(
            "resolved_id",
            F.when((F.col("type") == "Event") & F.col("_event").isNotNull(), F.col("_event")).otherwise(F.col("m_id")),
        )
        .drop("_event")
    )


def attach_arguments(events: DataFrame, roles: DataFrame, entities: DataFrame) -> DataFrame:
    """Arguments as an array under each event; roles whose entity is not among
    the sentence's entities are ignored. An event has few roles."""
    known = entities.select("doc", "sent", F.col("idx").alias("a_idx"), F.col("m_start").alias("_s"), F.col("m_end").alias("_e"))
    listed = (
        roles.join(known, ["doc", "sent", "a_idx"])
        .groupBy("doc", "e_idx")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("_s").alias("start"), F.col("_e").alias("end"), "role"))).alias("arguments"))
        .withColumnRenamed("e_idx", "idx")
    )
    empty = F.array().cast("array<struct<start:bigint,end:bigint,role:string>>")
    return events.join(listed, ["doc", "idx"], "left").withColumn("arguments", F.coalesce("arguments", empty))


def disambiguate_role_names(arguments: DataFrame) -> DataFrame:
    window = Window.partitionBy("doc", "e_idx", "role").orderBy("a_start", "a_idx")
    return (
        arguments.withColumn("_n", F.row_number().over(window))
        .withColumn("role_name", F.when(F.col("_n") > 1, F.concat("role", F.col("_n").cast("string"))).otherwise(F.col("role")))
        .drop("_n")
    )


def lemma_lookup(mentions: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Lemma by (token, tag) from a lookup table, else the token itself."""
    return mentions.join(lemmas.withColumnRenamed("lemma", "_lemma"), ["tok", "tag"], "left").withColumn(
        "head_lemma", F.coalesce("_lemma", "tok")
    ).drop("_lemma")


def demote_unknown_type(mentions: DataFrame, known_types: DataFrame) -> DataFrame:
    known = known_types.select("type_name").distinct().withColumn("_known", F.lit(True))
    unknown = F.col("_known").isNull()
    return (
        mentions.join(known, "type_name", "left")
        .withColumn("m_start", F.when(unknown, -1).otherwise(F.col("m_start")))
        .withColumn("m_end", F.when(unknown, -1).otherwise(F.col("m_end")))
        .withColumn("cluster", F.when(unknown, 0).otherwise(F.col("cluster")))
        .withColumn("type_name", F.when(unknown, X.NULL_TEXT).otherwise(F.col("type_name")))
        .drop("_known")
    )


def dedupe_mentions_by_span(mentions: DataFrame, input_order: str = "idx") -> DataFrame:
    """The later mention wins on an equal (doc, span)."""
    row = F.struct(*mentions.columns)
    return mentions.groupBy("doc", "m_start", "m_end").agg(F.max_by(row, F.col(input_order)).alias("_r")).select("_r.*")


def filter_docs_with(rows: DataFrame, kept: DataFrame, keys: Sequence[str] = ("doc",)) -> DataFrame:
    return rows.join(kept.select(*keys), list(keys), "left_semi")


def filter_visual_mentions(mentions: DataFrame, crosswalk: DataFrame, labels: DataFrame) -> DataFrame:
    """Mentions with a mapped type among the visual labels of their document."""
    allowed = labels.select("doc", "label").distinct().join(crosswalk, "label").select("doc", "type").distinct()
    return mentions.join(allowed, ["doc", "type"], "left_semi")


def remove_nested_mentions(mentions: DataFrame) -> DataFrame:
    """Drops mentions inside another one of their document and cluster.

    A span lies in another one that starts no later and ends no earlier, so the
    running maximum of the ends decides it without pairing the mentions; equal
    spans remove each other."""
    keys = ["doc", "cluster", "m_start"]
    ends = mentions.groupBy(*keys, "m_end").agg(F.count("*").alias("_twins"))
    starts = ends.groupBy(*keys).agg(F.max("m_end").alias("_longest"))
    reach = order.running_max(
        starts, ["doc", "cluster"], ["m_start"], order.blocks_of(F.col("m_start"), 65536), F.col("_longest"), "_reach"
    )
    outer = ends.join(reach, keys).filter(
        (F.coalesce("_reach", F.lit(-1)) < F.col("m_end"))
        & (F.col("_longest") == F.col("m_end"))
        & (F.col("_twins") == 1)
    )
    return mentions.join(outer.select(*keys, "m_end"), [*keys, "m_end"], "left_semi")


def srl_slots(arguments: DataFrame, role_slot: DataFrame, slots: Sequence[str] = ("arg_0", "arg_1")) -> DataFrame:
    """Span of the first argument per slot, (-1, -1) where there is none."""
    mapped = arguments.join(role_slot, "role", "left")
    place = F.struct("a_start", "a_idx")

    def first(field: str, slot: str) -> Column:
        chosen = F.when(F.col("slot") == slot, F.col(field))
        rank = F.when(F.col("slot") == slot, place)
        return F.coalesce(F.min_by(chosen, rank), F.lit(-1))

    return mapped.groupBy("doc", "e_idx").agg(
        *[first(f, s).alias(f"{s}_{name}") for s in slots for f, name in (("a_start", "start"), ("a_end", "end"))]
    )


def build_role_to_slot(roles: DataFrame) -> DataFrame:
    """(ord, event, role): roles of an event numbered in order, digits dropped;
    the first sighting of a role anywhere fixes its slot."""
    window = Window.partitionBy("event").orderBy("ord")
    return (
        roles.withColumn("role", F.regexp_replace("role", "[0-9]", ""))
        .withColumn("_n", F.row_number().over(window) - 1)
        .groupBy("role")
        .agg(F.min_by("_n", "ord").alias("_n"))
        .select("role", F.concat(F.lit("arg_"), F.col("_n").cast("string")).alias("slot"))
    )


def substitute_proper_mention(mentions: DataFrame) -> DataFrame:
    """Replaces a mention by the first proper one of its cluster; a pronoun falls
    back to the first nominal one. Cluster 0 stays."""
    place = F.struct("m_start", "idx")

    def first(kind: str) -> Column:
        here = F.col("mtype") == kind
        return F.min_by(F.when(here, F.struct("idx", "tok")), F.when(here, place))

    chosen = (
        mentions.filter("cluster > 0")
        .groupBy("doc", "cluster")
        .agg(first("proper").alias("_proper"), first("nominal").alias("_nominal"))
    )
    own = F.struct("idx", "tok")
    best = F.coalesce(
        F.col("_proper"), F.when(F.col("mtype") == "pronoun", F.col("_nominal")), own
    )
    return (
        mentions.join(chosen, ["doc", "cluster"], "left")
        .withColumn("_best", best)
        .withColumn("sub_idx", F.col("_best.idx"))
        .withColumn("sub_tok", F.col("_best.tok"))
        .drop("_best", "_proper", "_nominal")
    )


def neighbour_mentions(mentions: DataFrame, fields: Sequence[str] = ("tok", "lemma", "type")) -> DataFrame:
    """Fields of the previous and the next mention by idx, null at the ends.

    Two joins on (doc, idx +- 1) rather than a window over the whole document."""
    out = mentions
    for side, step in (("left", 1), ("right", -1)):
        other = mentions.select("doc", (F.col("idx") + step).alias("idx"), *[F.col(f).alias(f"{side}_{f}") for f in fields])
        out = out.join(other, ["doc", "idx"], "left")
    return out


def neighbour_tokens(mentions: DataFrame, tokens: DataFrame) -> DataFrame:
    """Token left of the span, skipping one punctuation, and token right of it."""
    words = tokens.select("doc", "tid", "tok", "cls")

    def at(name: str, place: Column, frame: DataFrame) -> DataFrame:
        side = words.select("doc", F.col("tid").alias("_at"), F.col("tok").alias(f"_{name}"), F.col("cls").alias(f"_{name}_cls"))
        return frame.withColumn("_at", place).join(side, ["doc", "_at"], "left").drop("_at")

    out = at("l1", F.col("m_start") - 1, mentions)
    out = at("l2", F.col("m_start") - 2, out)
    out = at("r1", F.col("m_end") + 1, out)
    left = F.when(F.col("_l1_cls") == ".", F.col("_l2")).otherwise(F.col("_l1"))
    return (
        out.withColumn("left_tok", F.coalesce(left, F.lit(X.NULL_TEXT)))
        .withColumn("right_tok", F.coalesce("_r1", F.lit(X.NULL_TEXT)))
        .drop("_l1", "_l2", "_r1", "_l1_cls", "_l2_cls", "_r1_cls")
    )


def topic_key(doc: Column) -> tuple[Column, Column]:
    topic = F.substring_index(doc, "_", 1)
    subtopic = F.concat(topic, F.lit("_"), F.when(doc.contains("plus"), "1").otherwise("0"))
    return topic, subtopic


FOLD_SENTENCES = 100_000  # documents up to this length are folded in one row


def split_into_segments(sentences: DataFrame, width: int, fold_up_to: int = FOLD_SENTENCES) -> DataFrame:
    """(doc, sent, n) -> seg: greedy windows of at most ``width`` pieces that end at
    a sentence. ``oversize`` marks a sentence longer than the window.

    Documents of up to ``fold_up_to`` sentences are folded over their sentence
    lengths; longer ones go through pointer doubling, so that no document has to
    fit one row."""
    rows = sentences.select("doc", F.col("sent").cast("long").alias("sent"), F.col("n").cast("long").alias("n"))
    sizes = rows.groupBy("doc").agg(F.count("*").alias("_size"))
    long_docs = sizes.filter(F.col("_size") > fold_up_to).select("doc")
    folded = _segments_by_fold(rows.join(sizes.filter(F.col("_size") <= fold_up_to), "doc", "left_semi"), width)
    if long_docs.isEmpty():
        return folded
    return folded.unionByName(_segments_by_doubling(rows.join(long_docs, "doc", "left_semi"), width))


def _segments_by_fold(rows: DataFrame, width: int) -> DataFrame:
    lists = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("sent", "n"))).alias("_s"))
    start = F.struct(
        F.lit(0).cast("long").alias("seg"), F.lit(0).cast("long").alias("used"), F.lit(True).alias("fresh"),
        F.array().cast("array<struct<sent:bigint,seg:bigint,oversize:boolean>>").alias("out"),
    )

    def step(acc: Column, s: Column) -> Column:
        fits = (acc["used"] + s["n"] <= width) | acc["fresh"]  # an empty sentence opens a segment as well
        seg = F.when(fits, acc["seg"]).otherwise(acc["seg"] + 1)
        used = F.when(fits, acc["used"] + s["n"]).otherwise(s["n"])
        row = F.struct(s["sent"].alias("sent"), seg.alias("seg"), (s["n"] > width).alias("oversize"))
        return F.struct(seg.alias("seg"), used.alias("used"), F.lit(False).alias("fresh"), F.array_append(acc["out"], row).alias("out"))

    return lists.select("doc", F.explode(F.aggregate("_s", start, step)["out"]).alias("_r")).select("doc", "_r.*")


def _segments_by_doubling(rows: DataFrame, width: int) -> DataFrame:
    placed = order.running_total(rows, ["doc"], ["sent"], order.blocks_of(F.col("sent"), 4096), F.col("n"), "at")
    placed = cut_lineage(order.number_rows(placed, ["doc"], ["sent"], order.blocks_of(F.col("sent"), 4096), "i"))
    # the sentence that holds the first piece past the window starts the next one
    holders = placed.select(
        "doc", F.col("i").alias("next"), F.col("at").alias("_from"), (F.col("at") + F.col("n")).alias("_to"),
        F.explode(F.sequence(F.floor(F.col("at") / width), F.floor((F.col("at") + F.col("n") - 1) / width))).alias("_b"),
    )
    jump = (
        placed.withColumn("_cut", F.col("at") + width)
        .withColumn("_b", F.floor(F.col("_cut") / width))
        .join(holders, ["doc", "_b"])
        .filter((F.col("_from") <= F.col("_cut")) & (F.col("_cut") < F.col("_to")))
        .select("doc", "i", F.greatest(F.col("next"), F.col("i") + 1).alias("next"))
    )
    jump = cut_lineage(jump)
    heads = placed.filter("i = 0").select("doc", "i")
    while True:
        reached = heads.join(jump, ["doc", "i"]).select("doc", F.col("next").alias("i"))
        more = cut_lineage(heads.unionByName(reached).distinct())
        jump = cut_lineage(
            jump.join(jump.select("doc", F.col("i").alias("next"), F.col("next").alias("_n")), ["doc", "next"])
            .select("doc", "i", F.col("_n").alias("next"))
        )
        heads = more
        if jump.isEmpty():
            break
    first = heads.withColumn("_head", F.lit(1))
    marked = placed.join(first, ["doc", "i"], "left").withColumn("_head", F.coalesce("_head", F.lit(0)))
    numbered = order.running_total(
        marked, ["doc"], ["i"], order.blocks_of(F.col("i"), 4096), F.col("_head").cast("long"), "_seg", inclusive=True
    )
    return numbered.select("doc", "sent", (F.col("_seg") - 1).alias("seg"), (F.col("n") > width).alias("oversize"))


def piece_alignment(tokens: DataFrame) -> DataFrame:
    """(doc, tid, n_pieces) -> p_start, p_end of each token, -1 where it has none."""
    placed = order.running_total(
        tokens, ["doc"], ["tid"], order.blocks_of(F.col("tid"), 65536), F.col("n_pieces"), "_at"
    )
    some = F.col("n_pieces") > 0
    return (
        placed.withColumn("p_start", F.when(some, F.col("_at")).otherwise(-1))
        .withColumn("p_end", F.when(some, F.col("_at") + F.col("n_pieces") - 1).otherwise(-1))
        .drop("_at")
    )


def pieces_of_tokens(aligned: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    return aligned.filter("p_start >= 0").select(
        "doc", F.explode(F.sequence("p_start", "p_end")).alias("piece"), "tid", *carry
    )


def enumerate_candidate_spans(tokens: DataFrame, width: int) -> DataFrame:
    """All spans of up to ``width`` tokens inside one sentence: no join needed,
    the end of the sentence bounds the end of the span."""
    last = F.least(F.col("tid") + width - 1, "sent_end")
    return tokens.select("doc", "sent", F.col("tid").alias("m_start"), F.explode(F.sequence("tid", last)).alias("m_end"))


def select_validated_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.filter(F.col("flag"))


ANCHOR_WORDS = 8


def phrase_positions(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """First word position at which each phrase occurs in each text.

    (doc, words), (phrase_id, phrase). The hash of the first words of a phrase (up
    to eight) is its anchor; texts give one hash per position and anchor length,
    and only the positions whose anchor is wanted meet the whole phrase."""
    words = F.split("phrase", " ")
    size = F.least(F.lit(ANCHOR_WORDS), F.size(words))
    wanted = phrases.select(
        "phrase_id", words.alias("_p"), size.alias("_a"),
        F.xxhash64(F.slice(F.transform(words, lambda w: F.xxhash64(w)), F.lit(1), size)).alias("anchor"),
    )

    def grams(hashes: Column, n: int) -> Column:
        last = F.size(hashes) - n
        return F.when(
            last >= 0,
            F.transform(
                F.sequence(F.lit(0), last),
                lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(hashes, i + 1, n)).alias("anchor")),
            ),
        ).otherwise(F.array().cast("array<struct<pos:int,anchor:bigint>>"))

    sizes = [r["_a"] for r in wanted.select("_a").distinct().limit(ANCHOR_WORDS).collect()]
    every = let(
        F.transform("words", lambda w: F.xxhash64(w)), lambda h: F.concat(*[grams(h, n) for n in sizes or [1]])
    )
    hits = (
        texts.select("doc", F.explode(every).alias("_g")).select("doc", "_g.*")
        .join(wanted, "anchor").select("doc", "phrase_id", "pos", "_p")
    )
    found = hits.join(texts, "doc").filter(F.slice("words", F.col("pos") + 1, F.size("_p")) == F.col("_p"))
    return found.groupBy("doc", "phrase_id").agg(F.min("pos").alias("pos"))


def segment_to_sentence(texts: DataFrame) -> DataFrame:
    """(doc, text) -> numbered non-empty lines; ``part`` keeps the raw position."""
    parts = texts.select("doc", F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "").alias("_p"))
    return parts.select("doc", F.posexplode("_p").alias("sent", "line"))


def mask_mentions(tokens: DataFrame, mentions: DataFrame, feature: str) -> DataFrame:
    """Masked token views, one per document and value of ``feature``.

    The view of a mention hides the tokens from its start on and the spans of
    earlier mentions whose feature differs. Before its start that depends on the
    feature value alone, so the views are stored per value (doc, value, tid, tok)
    and a mention reads its own up to ``m_start`` (see ``mention_view``)."""
    covered = mentions.select("doc", feature, F.explode(F.sequence("m_start", "m_end")).alias("tid"))
    held = covered.groupBy("doc", "tid").agg(F.min(feature).alias("_lo"), F.max(feature).alias("_hi"))
    values = mentions.select("doc", F.col(feature).alias("value")).distinct()
    hidden = (F.col("_lo") != F.col("value")) | (F.col("_hi") != F.col("value"))
    return (
        tokens.select("doc", "tid", "tok").join(held, ["doc", "tid"], "left").join(values, "doc")
        .select("doc", "value", "tid", F.when(F.coalesce(hidden, F.lit(False)), "<mask>").otherwise(F.col("tok")).alias("tok"))
    )


def mention_view(views: DataFrame, mentions: DataFrame, feature: str) -> DataFrame:
    """The masked document of each of the given (few) mentions."""
    chosen = mentions.select("doc", "idx", "m_start", F.col(feature).alias("value"))
    return views.join(chosen, ["doc", "value"]).select(
        "doc", "idx", "tid", F.when(F.col("tid") >= F.col("m_start"), "<mask>").otherwise(F.col("tok")).alias("tok")
    )


def span_token_map(mentions: DataFrame, width: int | None = None, max_token: int | None = None) -> DataFrame:
    """Sparse (span, offset, token). For a model of fixed size, spans are cut to
    ``width`` tokens and those that reach past token ``max_token`` are dropped."""
    kept = mentions if max_token is None else mentions.filter(F.col("m_end") <= max_token)
    last = F.col("m_end") if width is None else F.least("m_end", F.col("m_start") + width - 1)
    return kept.select("doc", "idx", F.posexplode(F.sequence("m_start", last)).alias("off", "tid"))


def event_argument_map(
    arguments: DataFrame, mentions: DataFrame, max_events: int | None = None, max_roles: int | None = None, max_mentions: int | None = None
) -> DataFrame:
    """Event row and role number -> mention index; with limits, what lies within a
    model's fixed sizes."""

    def below(rows: DataFrame, column: str, limit: int | None) -> DataFrame:
        return rows if limit is None else rows.filter(F.col(column) < limit)

    numbered = below(mentions, "idx", max_mentions).select("doc", F.col("idx").alias("a_idx"))
    roles = Window.partitionBy("doc", "e_idx").orderBy("a_start", "a_idx")
    events = mentions.filter("kind = 'event'").select("doc", F.col("idx").alias("e_idx"), "m_start")
    ranked = order.number_rows(events, ["doc"], ["m_start", "e_idx"], order.blocks_of(F.col("m_start"), 65536), "event_row").drop("m_start")
    return (
        below(arguments.withColumn("role_no", F.row_number().over(roles) - 1), "role_no", max_roles)
        .join(below(ranked, "event_row", max_events), ["doc", "e_idx"]).join(numbered, ["doc", "a_idx"])
        .select("doc", "event_row", "role_no", "a_idx", "role")
    )


def densify_roles(arguments: DataFrame, events: DataFrame) -> DataFrame:
    """Every event gets every role seen with its type; the last value wins and a
    missing one is NULL text."""
    roles = arguments.select("e_type", "role").distinct()
    values = arguments.groupBy("doc", "e_idx", "role").agg(F.max_by("a_lemma", F.struct("a_start", "a_idx")).alias("_v"))
    return (
        events.join(roles, "e_type")
        .join(values, ["doc", "e_idx", "role"], "left")
        .withColumn("value", F.coalesce("_v", F.lit(X.NULL_TEXT)))
        .drop("_v")
    )


def readable_clusters(members: DataFrame, tokens_text: DataFrame) -> DataFrame:
    """``[a,b],[c]`` per document: cluster texts by first mention.

    Rendering one document into one cell is the operator; its input rows are
    already grouped per cluster before they meet."""
    texts = members.join(tokens_text, ["doc", "idx"])
    clusters = texts.groupBy("doc", "cluster").agg(
        F.min("idx").alias("_first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"]), ",").alias("_c"),
    )
    return clusters.groupBy("doc").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_first", "_c"))),
                lambda s: F.concat(F.lit("["), s["_c"], F.lit("]")),
            ),
            ",",
        ).alias("clusters")
    )


def padded(a: Column, length: int, pad) -> Column:
    return pad_or_truncate(a, length, F.lit(pad))
