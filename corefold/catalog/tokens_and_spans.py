"""Queries on tokens, spans and the normalised mention table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corefold.catalog.registry import query
from corefold.functions import text as X
from corefold.functions import vectors as V
from corefold.operators import spans as S


@query("prj01_doc_token_offset", "SELECT doc, sent, n, base FROM placed")
def _(t):
    return S.doc_token_offset(t.sentences()).select("doc", "sent", "n", "base")


@query(
    "prj02_mention_span",
    """SELECT conv_id AS doc, turn AS sent, coalesce(list_min(ids), -1)::BIGINT AS m_start, coalesce(list_max(ids), -1)::BIGINT AS m_end FROM (
       SELECT doc AS conv_id, sent AS turn, list_transform(list_filter(list_zip(words, range(len(words))), lambda p: length(p[1]) >= 12), lambda p: p[2]) AS ids
       FROM sentences)""",
)
def _(t):
    long_words = F.filter(
        F.transform("words", lambda w, i: F.when(F.length(w) >= 12, i)), lambda i: i.isNotNull()
    )
    start, end = S.mention_span(long_words)
    return t.sentences().select("doc", "sent", start.alias("m_start"), end.alias("m_end"))


@query(
    "prj03_token_ids_from_span",
    """SELECT doc, idx, array_to_string(range(m_start, m_end + 1), ',') AS ids, array_to_string(range(m_start, m_end), ',') AS ids_half_open FROM mentions""",
)
def _(t):
    ids = F.array_join(S.token_ids(F.col("m_start"), F.col("m_end")).cast("array<string>"), ",")
    half = F.array_join(S.token_ids(F.col("m_start"), F.col("m_end"), inclusive=False).cast("array<string>"), ",")
    return t.mentions().select("doc", "idx", ids.alias("ids"), half.alias("ids_half_open"))


@query(
    "prj04_span_text",
    """SELECT m.doc, m.idx, string_agg(t.tok, ' ' ORDER BY t.tid) AS text FROM mentions m JOIN tokens t
       ON m.doc = t.doc AND t.tid BETWEEN m.m_start AND m.m_end GROUP BY ALL""",
)
def _(t):
    return S.span_text(t.mentions(), t.tokens(), "idx")


@query(
    "prj05_mention_mask",
    """SELECT t.doc, t.tid, EXISTS (SELECT 1 FROM mentions m WHERE m.doc = t.doc AND t.tid BETWEEN m.m_start AND m.m_end) AS flag FROM tokens t""",
)
def _(t):
    return S.mention_mask(t.tokens(), t.mentions()).select("doc", "tid", "flag")


CHAR_SQL = """char_tokens AS (SELECT *, c_start + length(raw) - 1 AS c_end FROM (SELECT *, coalesce(sum(length(raw) + 1) OVER (
    PARTITION BY doc, sent ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c_start FROM tokens)),
    intervals AS (SELECT m.doc, m.sent, m.idx AS m_id, c.c_start + 2 AS c_from, c.c_end + 3 + m.type * 4 AS c_to
      FROM mentions m JOIN char_tokens c ON m.doc = c.doc AND m.m_start = c.tid)"""


def _intervals(t, placed):
    at = placed.select("doc", F.col("tid").alias("m_start"), "c_start", "c_end")
    return t.mentions().join(at, ["doc", "m_start"]).select(
        "doc", "sent", F.col("idx").alias("m_id"), (F.col("c_start") + 2).alias("c_from"),
        (F.col("c_end") + 3 + F.col("type") * 4).alias("c_to"),
    )


@query(
    "prj06_char_to_token_span",
    f"""WITH {CHAR_SQL} SELECT i.doc, i.sent, i.m_id, min(t.tid) AS m_start, max(t.tid) AS m_end FROM intervals i JOIN char_tokens t
        ON i.doc = t.doc AND i.sent = t.sent AND NOT (i.c_to < t.c_start OR t.c_end < i.c_from)
        WHERE t.raw NOT IN (',', '.', '?', '''', '"', '!') GROUP BY ALL""",
)
def _(t):
    placed = S.char_offsets(t.tokens())
    return S.char_to_token_span(_intervals(t, placed), placed)


@query(
    "prj07_merge_trigger_entities",
    """SELECT e.doc, 'T' || e.idx AS m_id, CASE WHEN e.mtype = 'proper' AND g.idx IS NOT NULL THEN 'E' || g.idx ELSE 'T' || e.idx END AS resolved_id
       FROM mentions e LEFT JOIN mentions g ON e.doc = g.doc AND e.m_start = g.m_start AND e.m_end = g.m_end AND g.kind = 'event'""",
)
def _(t):
    m = t.mentions()
    spans = m.select("doc", "idx", "kind", "mtype", F.col("m_start").alias("c_from"), F.col("m_end").alias("c_to"))
    entities = spans.select(
        "doc", "c_from", "c_to", F.concat(F.lit("T"), "idx").alias("m_id"),
        F.when(F.col("mtype") == "proper", "Event").otherwise("Person").alias("type"),
    )
    triggers = spans.filter("kind = 'event'").select("doc", "c_from", "c_to", F.concat(F.lit("E"), "idx").alias("event_id"))
    return S.merge_trigger_entities(entities, triggers).select("doc", "m_id", "resolved_id")


@query(
    "prj08_attach_arguments",
    """SELECT m.doc, m.idx, coalesce(string_agg(a.a_start || ':' || a.a_end || ':' || a.role, ';' ORDER BY a.a_start, a.a_end, a.role), '') AS arguments
       FROM mentions m LEFT JOIN arguments a ON m.doc = a.doc AND m.idx = a.e_idx WHERE m.kind = 'event' GROUP BY m.doc, m.idx""",
)
def _(t):
    m = t.mentions()
    events = m.filter("kind = 'event'").select("doc", "idx")
    entities = m.filter("kind = 'entity'")
    full = S.attach_arguments(events, t.arguments().select("doc", "sent", "e_idx", "a_idx", "role"), entities)
    shown = F.transform("arguments", lambda a: F.concat_ws(":", a["start"].cast("string"), a["end"].cast("string"), a["role"]))
    return full.select("doc", "idx", F.array_join(shown, ";").alias("arguments"))


@query(
    "prj09_disambiguate_role_names",
    """SELECT doc, e_idx, a_idx, CASE WHEN n > 1 THEN role || n ELSE role END AS role_name FROM (SELECT *, row_number() OVER (
       PARTITION BY doc, e_idx, role ORDER BY a_start, a_idx) AS n FROM arguments)""",
)
def _(t):
    return S.disambiguate_role_names(t.arguments()).select("doc", "e_idx", "a_idx", "role_name")


@query(
    "prj10_clean_description_id",
    """SELECT page_id, replace(translate(url, ',.''":;?!<>~%$|/@#^*', ''), ' ', '_') AS desc_id, list_last(string_split(url, 'ref=')) AS ref,
       translate(url, ',.''":;?!<>~%$|/@#^*', '') AS plain_id FROM pages""",
)
def _(t):
    return t.read("pages").select(
        "page_id", X.clean_description_id(F.col("url"), "_").alias("desc_id"),
        F.element_at(F.split("url", "ref="), -1).alias("ref"), X.clean_description_id(F.col("url")).alias("plain_id"),
    )


@query("prj11_lowercase_tokens", "SELECT doc, tid, lower(regexp_replace(raw, '[^A-Za-z]', '', 'g')) AS tok FROM tokens")
def _(t):
    return t.tokens().select("doc", "tid", F.lower(F.regexp_replace("raw", "[^A-Za-z]", "")).alias("tok"))


@query(
    "prj12_head_lemma_lookup",
    """WITH lex AS (SELECT tok, tag, min(lemma) AS lemma FROM mentions WHERE mtype = 'nominal' GROUP BY ALL)
       SELECT m.doc, m.idx, coalesce(l.lemma, m.tok) AS head_lemma FROM mentions m LEFT JOIN lex l ON m.tok = l.tok AND m.tag = l.tag""",
)
def _(t):
    m = t.mentions()
    lexicon = m.filter("mtype = 'nominal'").groupBy("tok", "tag").agg(F.min("lemma").alias("lemma"))
    return S.lemma_lookup(m, lexicon).select("doc", "idx", "head_lemma")


@query(
    "prj13_mention_type",
    """SELECT doc, tid, CASE WHEN tag IN ('PRP', 'PRP$') THEN 'pronoun' WHEN tag IN ('NNP', 'NNPS') THEN 'proper' ELSE 'nominal' END AS mtype FROM tokens""",
)
def _(t):
    return t.tokens().select("doc", "tid", X.mention_type(F.col("tag")).alias("mtype"))


PLURALS = "('they', 'them', 'their', 'we', 'us', 'our', 'these', 'those')"


@query(
    "prj14_number",
    f"""SELECT doc, tid, CASE WHEN tag IN ('NNS', 'NNPS') THEN 'plural' WHEN tag = 'CD' AND tok IN ('one', '1') THEN 'singular' WHEN tag = 'CD' THEN 'plural'
        WHEN tok IN {PLURALS} THEN 'plural' ELSE 'singular' END AS number_loader,
        CASE WHEN tag IN ('PRP', 'PRP$') THEN CASE WHEN tok IN {PLURALS} THEN 'plural' ELSE 'singular' END WHEN tag IN ('NNS', 'NNPS') THEN 'plural'
        WHEN tag = 'CD' THEN tok ELSE 'singular' END AS number_coref FROM tokens""",
)
def _(t):
    tok, tag = F.col("tok"), F.col("tag")
    return t.tokens().select(
        "doc", "tid", X.number_of_loader(tok, tag).alias("number_loader"), X.number_of_coreference(tok, tag).alias("number_coref")
    )


@query("prj15_word_class", "SELECT doc, tid, CASE WHEN cls IN ('NOUN', 'VERB', 'ADJ') THEN cls ELSE 'OTHER' END AS word_class FROM tokens")
def _(t):
    return t.tokens().select("doc", "tid", X.word_class(F.col("cls")).alias("word_class"))


@query("prj16_type_leaf", "SELECT doc, idx, list_last(string_split(type_name, '.')) AS leaf FROM mentions")
def _(t):
    return t.mentions().select("doc", "idx", X.type_leaf(F.col("type_name")).alias("leaf"))


@query(
    "prj17_demote_unknown_type",
    """SELECT doc, idx, CASE WHEN type = 2 THEN -1 ELSE m_start END AS m_start, CASE WHEN type = 2 THEN -1 ELSE m_end END AS m_end,
       CASE WHEN type = 2 THEN 0 ELSE cluster END AS cluster, CASE WHEN type = 2 THEN '###NULL###' ELSE type_name END AS type_name FROM mentions""",
)
def _(t):
    known = t.spark.createDataFrame([("Contact.Meet",), ("Conflict.Attack",)], "type_name string")
    return S.demote_unknown_type(t.mentions(), known).select("doc", "idx", "m_start", "m_end", "cluster", "type_name")


@query(
    "prj18_dedupe_mentions_by_span",
    """WITH r AS (SELECT doc, idx, (m_start // 40) * 40 AS m_start, (m_start // 40) * 40 + 39 AS m_end, tok FROM mentions)
       SELECT doc, m_start, m_end, max(idx) AS idx, arg_max(tok, idx) AS tok FROM r GROUP BY doc, m_start, m_end""",
)
def _(t):
    coarse = t.mentions().select(
        "doc", "idx", (F.floor(F.col("m_start") / 40) * 40).alias("m_start"), (F.floor(F.col("m_start") / 40) * 40 + 39).alias("m_end"), "tok"
    )
    return S.dedupe_mentions_by_span(coarse)


@query(
    "prj19_pad_or_truncate",
    """SELECT doc, sent, array_to_string((list_transform(words, lambda w: length(w)) || list_transform(range(12), lambda i: -1))[1:12], ',') AS lengths FROM sentences""",
)
def _(t):
    sizes = F.transform("words", lambda w: F.length(w))
    return t.sentences().select("doc", "sent", F.array_join(S.padded(sizes, 12, -1).cast("array<string>"), ",").alias("lengths"))


@query(
    "prj20_one_hot",
    """SELECT doc, idx, i - 1 AS k, round(CASE WHEN length(tok) - 8 < 4 THEN (length(tok) - 8 = i - 1)::INT::DOUBLE ELSE 0.25 END, 6) AS v
       FROM mentions, (SELECT unnest(range(1, 5)) AS i)""",
)
def _(t):
    hot = V.one_hot(F.length("tok") - 8, 4)
    return t.mentions().select("doc", "idx", F.posexplode(hot).alias("k", "v"))


@query(
    "prj21_filter_docs_with_features",
    "SELECT doc, idx FROM mentions WHERE doc IN (SELECT doc FROM log) AND doc IN (SELECT doc FROM segments WHERE label = 'error' AND t1 - t0 > 60000)",
)
def _(t):
    labelled = t.segments().filter((F.col("label") == "error") & (F.col("t1") - F.col("t0") > 60000))
    kept = S.filter_docs_with(t.mentions().select("doc", "idx"), t.log())
    return S.filter_docs_with(kept, labelled)


@query(
    "prj22_filter_visual_mentions",
    """SELECT m.doc, m.idx FROM mentions m WHERE EXISTS (SELECT 1 FROM (SELECT doc, label FROM segments WHERE t1 - t0 > 120000) s JOIN crosswalk c ON s.label = c.label
       WHERE s.doc = m.doc AND c.type = m.type)""",
)
def _(t):
    labels = t.segments().filter(F.col("t1") - F.col("t0") > 120000)
    return S.filter_visual_mentions(t.mentions(), t.crosswalk(), labels).select("doc", "idx")


NESTED = """SELECT doc, idx, type AS cluster, (m_start // 7) * 7 AS m_start, (m_start // 7) * 7 + length(tok) - 8 + type * 9 AS m_end FROM mentions"""


@query(
    "prj23_remove_nested_mentions",
    f"""WITH n AS ({NESTED}) SELECT doc, idx, cluster, m_start, m_end FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE a.doc = b.doc AND a.cluster = b.cluster
        AND a.idx <> b.idx AND a.m_start >= b.m_start AND a.m_end <= b.m_end)""",
)
def _(t):
    start = F.floor(F.col("m_start") / 7) * 7
    rows = t.mentions().select(
        "doc", "idx", F.col("type").alias("cluster"), start.alias("m_start"),
        (start + F.length("tok") - 8 + F.col("type") * 9).alias("m_end"),
    )
    return S.remove_nested_mentions(rows)


SLOTS = [("Agent", "arg_0"), ("Patient", "arg_1")]


@query(
    "prj24_srl_slots",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY doc, e_idx, role ORDER BY a_start, a_idx) AS n FROM arguments)
       SELECT doc, e_idx, coalesce(max(a_start) FILTER (role = 'Agent' AND n = 1), -1) AS arg_0_start, coalesce(max(a_end) FILTER (role = 'Agent' AND n = 1), -1) AS arg_0_end,
       coalesce(max(a_start) FILTER (role = 'Patient' AND n = 1), -1) AS arg_1_start, coalesce(max(a_end) FILTER (role = 'Patient' AND n = 1), -1) AS arg_1_end
       FROM r GROUP BY doc, e_idx""",
)
def _(t):
    slots = t.spark.createDataFrame(SLOTS, "role string, slot string")
    return S.srl_slots(t.arguments(), slots)


@query(
    "prj25_build_role_to_slot",
    """WITH o AS (SELECT e_type AS event, role || (a_idx % 3) AS role, min(doc * 1000000 + e_idx * 1000 + a_idx) AS ord FROM arguments GROUP BY ALL),
       n AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY ord) - 1 AS n FROM o)
       SELECT regexp_replace(role, '[0-9]', '', 'g') AS role, 'arg_' || arg_min(n, ord) AS slot FROM n GROUP BY 1""",
)
def _(t):
    ordered = t.arguments().groupBy(
        F.col("e_type").alias("event"), F.concat("role", (F.col("a_idx") % 3).cast("string")).alias("role")
    ).agg(F.min(F.col("doc") * 1000000 + F.col("e_idx") * 1000 + F.col("a_idx")).alias("ord"))
    return S.build_role_to_slot(ordered)


@query(
    "prj26_substitute_proper_mention",
    """WITH f AS (SELECT doc, type, arg_min(idx, idx) FILTER (mtype = 'proper') AS pi, arg_min(tok, idx) FILTER (mtype = 'proper') AS pt,
         arg_min(idx, idx) FILTER (mtype = 'nominal') AS ni, arg_min(tok, idx) FILTER (mtype = 'nominal') AS nt FROM mentions WHERE type > 0 GROUP BY doc, type)
       SELECT m.doc, m.idx, CASE WHEN pi IS NOT NULL THEN pi WHEN m.mtype = 'pronoun' AND ni IS NOT NULL THEN ni ELSE m.idx END AS sub_idx,
         CASE WHEN pi IS NOT NULL THEN pt WHEN m.mtype = 'pronoun' AND ni IS NOT NULL THEN nt ELSE m.tok END AS sub_tok
       FROM mentions m LEFT JOIN f ON m.doc = f.doc AND m.type = f.type""",
)
def _(t):
    m = t.mentions().withColumn("cluster", F.col("type"))
    return S.substitute_proper_mention(m).select("doc", "idx", "sub_idx", "sub_tok")


@query(
    "prj27_neighbour_mentions",
    """SELECT doc, idx, coalesce(lag(tok) OVER w, '###NULL###') AS left_tok, coalesce(lead(tok) OVER w, '###NULL###') AS right_tok,
       lag(type) OVER w AS left_type, lead(lemma) OVER w AS right_lemma FROM mentions WINDOW w AS (PARTITION BY doc ORDER BY idx)""",
)
def _(t):
    n = S.neighbour_mentions(t.mentions())
    null = F.lit(X.NULL_TEXT)
    return n.select(
        "doc", "idx", F.coalesce("left_tok", null).alias("left_tok"), F.coalesce("right_tok", null).alias("right_tok"), "left_type", "right_lemma"
    )


@query(
    "prj28_neighbour_tokens",
    """SELECT m.doc, m.idx, coalesce(CASE WHEN a.cls = '.' THEN b.tok ELSE a.tok END, '###NULL###') AS left_tok, coalesce(c.tok, '###NULL###') AS right_tok
       FROM mentions m LEFT JOIN tokens a ON a.doc = m.doc AND a.tid = m.m_start - 1 LEFT JOIN tokens b ON b.doc = m.doc AND b.tid = m.m_start - 2
       LEFT JOIN tokens c ON c.doc = m.doc AND c.tid = m.m_end + 1""",
)
def _(t):
    return S.neighbour_tokens(t.mentions(), t.tokens()).select("doc", "idx", "left_tok", "right_tok")


@query(
    "prj31_topic_key",
    """SELECT doc_id, string_split(source || '_' || lang, '_')[1] AS topic,
       string_split(source || '_' || lang, '_')[1] || '_' || (CASE WHEN contains(source || '_' || lang, '_e') THEN '1' ELSE '0' END) AS subtopic FROM documents""",
)
def _(t):
    name = F.replace(F.concat_ws("_", "source", "lang"), F.lit("_e"), F.lit("_plus"))
    topic, subtopic = S.topic_key(name)
    return t.read("documents").select("doc_id", topic.alias("topic"), subtopic.alias("subtopic"))


SEGMENT_WIDTH = 510


@query(
    "prj32_split_into_segments",
    f"""WITH RECURSIVE s AS (SELECT doc, sent, n, row_number() OVER (PARTITION BY doc ORDER BY sent) AS i FROM placed),
        g AS (SELECT doc, sent, n, i, 0::BIGINT AS seg, n AS used FROM s WHERE i = 1
          UNION ALL SELECT s.doc, s.sent, s.n, s.i, CASE WHEN g.used + s.n <= {SEGMENT_WIDTH} THEN g.seg ELSE g.seg + 1 END,
          CASE WHEN g.used + s.n <= {SEGMENT_WIDTH} THEN g.used + s.n ELSE s.n END FROM g JOIN s ON s.doc = g.doc AND s.i = g.i + 1)
        SELECT doc, sent, seg, n > {SEGMENT_WIDTH} AS oversize FROM g""",
)
def _(t):
    return S.split_into_segments(t.sentences(), SEGMENT_WIDTH)


PIECES = "CASE WHEN length(tok) = 0 THEN 0 ELSE (length(tok) + 3) // 4 END"


@query(
    "prj33_piece_alignment",
    f"""SELECT doc, tid, CASE WHEN n > 0 THEN a ELSE -1 END AS p_start, CASE WHEN n > 0 THEN a + n - 1 ELSE -1 END AS p_end FROM (
        SELECT doc, tid, {PIECES} AS n, coalesce(sum({PIECES}) OVER (PARTITION BY doc ORDER BY tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM tokens)""",
)
def _(t):
    return S.piece_alignment(_pieces(t)).select("doc", "tid", "p_start", "p_end")


def _pieces(t):
    return t.tokens().withColumn("n_pieces", F.ceil(F.length("tok") / 4))


@query(
    "prj33_piece_to_token",
    f"""SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY tid, i) - 1 AS piece, tid FROM (
        SELECT doc, tid, unnest(range({PIECES})) AS i FROM tokens)""",
)
def _(t):
    return S.pieces_of_tokens(S.piece_alignment(_pieces(t)))


@query(
    "prj34_enumerate_candidate_spans",
    "SELECT a.doc, a.sent, a.tid AS m_start, b.tid AS m_end FROM tokens a JOIN tokens b ON a.doc = b.doc AND a.sent = b.sent AND b.tid BETWEEN a.tid AND a.tid + 3",
)
def _(t):
    return S.enumerate_candidate_spans(t.tokens(), 4)


@query(
    "prj35_select_validated_tokens",
    "SELECT doc, tid FROM tokens t WHERE EXISTS (SELECT 1 FROM mentions m WHERE m.doc = t.doc AND t.tid BETWEEN m.m_start AND m.m_end)",
)
def _(t):
    return S.select_validated_tokens(S.mention_mask(t.tokens(), t.mentions())).select("doc", "tid")


@query(
    "prj36_locate_phrase",
    r"""WITH d AS (SELECT doc_id AS doc, regexp_split_to_array(text, '[ \n\t\r]+') AS words FROM documents),
        b AS (SELECT item_id AS phrase_id, regexp_split_to_array(text, '[ \n\t\r]+') AS words FROM benchmark),
        p AS (SELECT DISTINCT phrase_id, words[1:4] AS head, words FROM b),
        w AS (SELECT doc, words, unnest(range(0, len(words))) AS pos FROM d),
        h AS (SELECT w.doc, p.phrase_id, w.pos, p.words AS pw, w.words FROM w JOIN p ON w.words[w.pos + 1 : w.pos + 4] = p.head)
        SELECT doc, phrase_id, min(pos) AS pos FROM h WHERE words[pos + 1 : pos + len(pw)] = pw GROUP BY ALL""",
)
def _(t):
    blanks = r"[ \n\t\r]+"
    texts = t.read("documents").select(F.col("doc_id").alias("doc"), F.split("text", blanks).alias("words"))
    phrases = t.read("benchmark").select(F.col("item_id").alias("phrase_id"), F.regexp_replace("text", blanks, " ").alias("phrase"))
    return S.phrase_positions(texts, phrases)


@query(
    "prj37_segment_to_sentence",
    r"""SELECT doc, generate_subscripts(p, 1) - 1 AS sent, unnest(p) AS line FROM (
        SELECT doc_id AS doc, list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '') AS p FROM documents)""",
)
def _(t):
    return S.segment_to_sentence(t.read("documents").select(F.col("doc_id").alias("doc"), "text"))


@query(
    "prj38_mask_mentions",
    """WITH v AS (SELECT DISTINCT doc, type FROM mentions)
       SELECT t.doc, v.type AS value, t.tid, CASE WHEN EXISTS (SELECT 1 FROM mentions m WHERE m.doc = t.doc AND m.type <> v.type AND t.tid BETWEEN m.m_start AND m.m_end)
       THEN '<mask>' ELSE t.tok END AS tok FROM tokens t JOIN v ON t.doc = v.doc""",
)
def _(t):
    return S.mask_mentions(t.tokens(), t.mentions(), "type")


@query(
    "prj39_span_token_map",
    "SELECT m.doc, m.idx, (t.tid - m.m_start)::BIGINT AS off, t.tid FROM mentions m JOIN tokens t ON m.doc = t.doc AND t.tid BETWEEN m.m_start AND least(m.m_end, m.m_start + 1) WHERE m.m_end <= 300",
)
def _(t):
    return S.span_token_map(t.mentions(), 2, 300)


@query("prj39_span_token_map_whole", "SELECT m.doc, m.idx, (t.tid - m.m_start)::BIGINT AS off, t.tid FROM mentions m JOIN tokens t ON m.doc = t.doc AND t.tid BETWEEN m.m_start AND m.m_end")
def _(t):
    return S.span_token_map(t.mentions())


@query(
    "prj40_event_argument_map",
    """WITH e AS (SELECT doc, idx, row_number() OVER (PARTITION BY doc ORDER BY m_start, idx) - 1 AS event_row FROM mentions WHERE kind = 'event'),
       r AS (SELECT *, row_number() OVER (PARTITION BY doc, e_idx ORDER BY a_start, a_idx) - 1 AS role_no FROM arguments)
       SELECT r.doc, e.event_row, r.role_no, r.a_idx, r.role FROM r JOIN e ON r.doc = e.doc AND r.e_idx = e.idx
       WHERE e.event_row < 20 AND r.role_no < 3 AND r.a_idx < 80""",
)
def _(t):
    return S.event_argument_map(t.arguments(), t.mentions(), 20, 3, 80)


@query(
    "prj40_event_argument_map_whole",
    """WITH e AS (SELECT doc, idx, row_number() OVER (PARTITION BY doc ORDER BY m_start, idx) - 1 AS event_row FROM mentions WHERE kind = 'event'),
       r AS (SELECT *, row_number() OVER (PARTITION BY doc, e_idx ORDER BY a_start, a_idx) - 1 AS role_no FROM arguments)
       SELECT r.doc, e.event_row, r.role_no, r.a_idx, r.role FROM r JOIN e ON r.doc = e.doc AND r.e_idx = e.idx""",
)
def _(t):
    return S.event_argument_map(t.arguments(), t.mentions())


@query(
    "prj41_densify_roles",
    """WITH r AS (SELECT DISTINCT e_type, role FROM arguments), l AS (SELECT doc, e_idx, role, arg_max(a_lemma, a_start) AS v FROM arguments GROUP BY ALL)
       SELECT m.doc, m.idx AS e_idx, m.type_name AS e_type, r.role, coalesce(l.v, '###NULL###') AS value FROM mentions m JOIN r ON m.type_name = r.e_type
       LEFT JOIN l ON l.doc = m.doc AND l.e_idx = m.idx AND l.role = r.role WHERE m.kind = 'event'""",
)
def _(t):
    events = t.mentions().filter("kind = 'event'").select("doc", F.col("idx").alias("e_idx"), F.col("type_name").alias("e_type"))
    return S.densify_roles(t.arguments(), events)


@query(
    "prj45_readable_clusters",
    """WITH c AS (SELECT m.doc, m.cluster, min(m.idx) AS first, string_agg(m.tok, ',' ORDER BY m.idx) AS c FROM mentions m WHERE cluster > 0 GROUP BY ALL)
       SELECT doc, string_agg('[' || c || ']', ',' ORDER BY first) AS clusters FROM c GROUP BY doc""",
)
def _(t):
    m = t.mentions().filter("cluster > 0")
    return S.readable_clusters(m.select("doc", "idx", "cluster"), m.select("doc", "idx", F.col("tok").alias("text")))
