"""Round trips through the file formats: the tables are written in the format and
read back by the reader under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from corefold.catalog.estimators import TEXT, fitted_text
from corefold.catalog.pairs_and_media import SHAPE, _boxes, BOXES, shape
from corefold.catalog.counts_and_scores import SCORED, _rounded, scored_candidates
from corefold.catalog.registry import query
from corefold.operators import counts as C
from corefold.operators import media as M
from corefold.operators import order
from corefold.operators import spans as S
from corefold.session import fresh_path
from corefold.sources import readers as R
from corefold.sources import sinks as W


def _json_lines(rows, path):
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)


@query("src01_read_token_documents", "SELECT doc::VARCHAR AS doc, sent, tid, tok, length(tok) >= 8 AS flag, tag FROM tokens")
def _(t):
    path = fresh_path(t.spark, "token-documents")
    flag = (F.length("tok") >= 8).cast("string")
    rows = t.tokens().groupBy("doc", "sent").agg(
        F.array_sort(F.collect_list(F.array(F.lpad(F.col("tid").cast("string"), 12, "0"), F.col("sent").cast("string"), F.col("tid").cast("string"), "tok", flag, "tag"))).alias("_t")
    )
    maps = rows.select(F.to_json(F.create_map(F.col("doc").cast("string"), F.transform("_t", lambda a: F.slice(a, 2, 5)))).alias("value"))
    maps.write.text(path)
    return R.read_token_documents(t.spark, path)


def _mention_records(t, kind):
    m = t.mentions().filter(F.col("kind") == kind)
    args = t.arguments().groupBy("doc", F.col("e_idx").alias("idx")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("a_start").alias("start"), F.col("a_end").alias("end"), "role", F.col("a_tok").alias("text")))).alias("arguments")
    )
    m = m.join(args, ["doc", "idx"], "left") if kind == "event" else m
    type_name = F.col("type_name").alias("event_type") if kind == "event" else F.col("entity_type")
    return m.select(
        F.col("doc").cast("string").alias("doc_id"), F.col("idx").cast("string").alias("m_id"), F.col("sent").alias("sentence_id"),
        F.sequence("m_start", "m_end").alias("tokens_ids"), F.col("tok").alias("tokens"), type_name, *(["arguments"] if kind == "event" else []),
        F.col("cluster").alias("cluster_id"),
    )


@query(
    "src02_read_mentions",
    """SELECT m.doc::VARCHAR AS doc_id, m.idx::VARCHAR AS m_id, m.m_start, m.m_end, m.kind, coalesce(m.ev, m.en) AS type_name, m.cluster AS cluster_id, coalesce(a.n, 0) AS n_arguments, coalesce(a.x, '') AS texts
       FROM (SELECT *, CASE WHEN kind = 'event' THEN type_name END AS ev, CASE WHEN kind = 'entity' THEN entity_type END AS en FROM mentions) m
       LEFT JOIN (SELECT doc, e_idx, count(*) AS n, string_agg(a_tok, ',' ORDER BY a_start) AS x FROM arguments GROUP BY ALL) a ON a.doc = m.doc AND a.e_idx = m.idx""",
)
def _(t):
    read = []
    for kind in ("event", "entity"):
        path = fresh_path(t.spark, f"{kind}-mentions")
        _json_lines(_mention_records(t, kind), path)
        read.append(R.read_mentions(t.spark, path, kind))
    both = read[0].unionByName(read[1])
    return both.select(
        "doc_id", "m_id", "m_start", "m_end", "kind", F.coalesce("event_type", "entity_type").alias("type_name"), "cluster_id",
        F.coalesce(F.size("arguments"), F.lit(0)).alias("n_arguments"), F.coalesce(F.array_join(F.transform("arguments", lambda a: a["text"]), ","), F.lit("")).alias("texts"),
    )


def _sentence_mentions(t, kind):
    """Mentions with their places inside the sentence (half-open end)."""
    start = t.tokens().groupBy("doc", "sent").agg(F.min("tid").alias("_base"))
    m = t.mentions().filter(F.col("kind") == kind).join(start, ["doc", "sent"])
    n = order.number_rows(m, ["doc", "sent"], ["idx"], order.blocks_of(F.col("idx"), 65536), "n")
    return n.withColumn("s", F.col("m_start") - F.col("_base")).withColumn("e", F.col("m_end") - F.col("_base") + 1)


LOCAL = """loc AS (SELECT m.*, m.m_start - p.base AS s, m.m_end - p.base + 1 AS e, row_number() OVER (PARTITION BY m.doc, m.sent, m.kind ORDER BY m.idx) - 1 AS n FROM mentions m JOIN placed p ON m.doc = p.doc AND m.sent = p.sent)"""


@query(
    "src03_read_ie_sentences",
    f"""WITH {LOCAL} SELECT 'trigger' AS part, doc::VARCHAR AS doc, sent::VARCHAR AS sent, s AS a, e AS b, type_name AS name FROM loc WHERE kind = 'event'
        UNION ALL SELECT 'entity', doc::VARCHAR, sent::VARCHAR, s, e, entity_type FROM loc WHERE kind = 'entity'
        UNION ALL SELECT 'role', g.doc::VARCHAR, g.sent::VARCHAR, x.n, y.n, g.role FROM arguments g JOIN loc x ON x.doc = g.doc AND x.idx = g.e_idx JOIN loc y ON y.doc = g.doc AND y.idx = g.a_idx""",
)
def _(t):
    path = fresh_path(t.spark, "ie-sentences")
    events, entities = _sentence_mentions(t, "event"), _sentence_mentions(t, "entity")

    def spans(rows, name, out):
        entry = F.array(F.col("s").cast("string"), F.col("e").cast("string"), F.col(name), F.lit("0.5"))
        return rows.groupBy("doc", "sent").agg(F.array_sort(F.collect_list(F.struct("n", entry.alias("v")))).alias("_v")).select(
            "doc", "sent", F.transform("_v", lambda x: x["v"]).alias(out)
        )

    roles = (
        t.arguments().join(events.select("doc", F.col("idx").alias("e_idx"), F.col("n").alias("_e")), ["doc", "e_idx"])
        .join(entities.select("doc", F.col("idx").alias("a_idx"), F.col("n").alias("_a")), ["doc", "a_idx"])
        .groupBy("doc", "sent").agg(F.collect_list(F.array(F.col("_e").cast("string"), F.col("_a").cast("string"), "role", F.lit("0.5"))).alias("roles"))
    )
    rows = (
        t.sentences().select("doc", "sent", "words")
        .join(spans(events, "type_name", "triggers"), ["doc", "sent"], "left").join(spans(entities, "entity_type", "entities"), ["doc", "sent"], "left")
        .join(roles, ["doc", "sent"], "left")
        .select(F.col("doc").cast("string").alias("doc_id"), F.col("sent").cast("string").alias("sent_id"), F.col("words").alias("tokens"), F.struct("triggers", "entities", "roles").alias("graph"))
    )
    _json_lines(rows, path)
    read = R.read_ie_sentences(t.spark, path)
    pick = lambda name, a, b, c, part: read[name].select(F.lit(part).alias("part"), "doc", "sent", F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("name"))
    return pick("triggers", "start", "end", "type", "trigger").unionByName(pick("entities", "start", "end", "type", "entity")).unionByName(pick("roles", "trigger", "entity", "role", "role"))


@query(
    "src04_read_sentence_annotations",
    f"""WITH {LOCAL} SELECT doc || '_' || sent AS sentence_id, kind AS part, s AS m_start, e - 1 AS m_end, CASE WHEN kind = 'event' THEN type_name ELSE entity_type END AS type FROM loc
        UNION ALL SELECT g.doc || '_' || g.sent, 'argument', y.s, y.e - 1, g.role FROM arguments g JOIN loc y ON y.doc = g.doc AND y.idx = g.a_idx""",
)
def _(t):
    path = fresh_path(t.spark, "sentence-annotations")
    events, entities = _sentence_mentions(t, "event"), _sentence_mentions(t, "entity")
    entity = F.struct(F.col("s").alias("start"), F.col("e").alias("end"), F.col("tok").alias("text"), F.col("entity_type").alias("entity-type"))
    golden = entities.groupBy("doc", "sent").agg(F.collect_list(entity).alias("golden-entity-mentions"))
    argument = F.struct(F.col("s").alias("start"), F.col("e").alias("end"), "role", F.col("tok").alias("text"), F.col("entity_type").alias("entity-type"))
    args = (
        t.arguments().select("doc", "e_idx", "role", F.col("a_idx").alias("idx")).join(entities.select("doc", "idx", "s", "e", "tok", "entity_type"), ["doc", "idx"])
        .groupBy("doc", F.col("e_idx").alias("idx")).agg(F.collect_list(argument).alias("arguments"))
    )
    event = F.struct(F.struct(F.col("s").alias("start"), F.col("e").alias("end"), F.col("tok").alias("text")).alias("trigger"), F.col("type_name").alias("event_type"), "arguments")
    triggers = events.join(args, ["doc", "idx"], "left").groupBy("doc", "sent").agg(F.collect_list(event).alias("golden-event-mentions"))
    rows = t.sentences().join(golden, ["doc", "sent"], "left").join(triggers, ["doc", "sent"], "left").select(
        F.concat_ws("_", "doc", "sent").alias("sentence_id"), "words", "`golden-entity-mentions`", "`golden-event-mentions`"
    )
    rows.select(F.to_json(F.struct("sentence_id", "words", "`golden-entity-mentions`", "`golden-event-mentions`")).alias("value")).write.text(path)
    read = R.read_sentence_annotations(t.spark, path, inclusive=False)
    part = lambda name, label, cols: read[name].select("sentence_id", F.lit(label).alias("part"), *[F.col(c).alias(o) for c, o in zip(cols, ("m_start", "m_end", "type"))])
    return (
        part("entities", "entity", ("m_start", "m_end", "type")).unionByName(part("events", "event", ("m_start", "m_end", "type")))
        .unionByName(part("arguments", "argument", ("a_start", "a_end", "role")))
    )


@query(
    "src05_read_ace_sentences",
    """WITH m AS (SELECT doc, kind, lemma || '-x' AS k, idx FROM mentions), s AS (SELECT *, count(*) OVER (PARTITION BY doc, kind, k) AS n FROM m)
       SELECT doc::VARCHAR AS doc_id, kind, k || '-' || idx AS m_id, CASE WHEN n > 1 THEN k ELSE '' END AS cluster_key FROM s""",
)
def _(t):
    path = fresh_path(t.spark, "ace-sentences")
    m = t.mentions().withColumn("m_id", F.concat(F.col("lemma"), F.lit("-x-"), F.col("idx")))
    entity = F.struct(F.col("m_id").alias("id"), F.col("tok").alias("text"), F.col("m_start").alias("start"), (F.col("m_end") + 1).alias("end"), "entity_type")
    entities = m.filter("kind = 'entity'").groupBy("doc", "sent").agg(F.collect_list(entity).alias("entity_mentions"))
    trigger = F.struct(F.col("tok").alias("text"), F.col("m_start").alias("start"), (F.col("m_end") + 1).alias("end"))
    event = F.struct(F.col("m_id").alias("id"), F.col("type_name").alias("event_type"), trigger.alias("trigger"))
    events = m.filter("kind = 'event'").groupBy("doc", "sent").agg(F.collect_list(event).alias("event_mentions"))
    rows = t.sentences().join(entities, ["doc", "sent"], "left").join(events, ["doc", "sent"], "left").select(
        F.col("doc").cast("string").alias("doc_id"), F.col("sent").cast("string").alias("sent_id"), F.col("words").alias("tokens"), "entity_mentions", "event_mentions"
    )
    _json_lines(rows, path)
    return R.read_ace_sentences(t.spark, path)["mentions"].select("doc_id", "kind", "m_id", "cluster_key")


def _standoff(t):
    """The mentions with the running ids and character spans of the export."""
    chars = S.char_offsets(t.tokens()).select("doc", F.col("tid").alias("m_start"), "c_start", "c_end")
    m = t.mentions().join(chars, ["doc", "m_start"])
    m = m.withColumn("t_no", F.col("idx") + 1).withColumn("type", F.when(F.col("kind") == "event", F.element_at(F.split("type_name", "\\."), -1)).otherwise(F.col("entity_type")))
    numbered = order.number_rows(m.filter("kind = 'event'").select("doc", "idx"), ["doc"], ["idx"], order.blocks_of(F.col("idx"), 65536), "e_no", start=1)
    full = m.join(numbered, ["doc", "idx"], "left").withColumn("c_from", F.col("c_start")).withColumn("c_end", F.col("c_end") + 1).withColumn("text", F.col("tok"))
    return full, S.disambiguate_role_names(t.arguments())


STANDOFF = """ct AS (SELECT *, c_start + length(raw) AS c_end FROM (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc, sent ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c_start FROM tokens)),
    so AS (SELECT m.*, c.c_start, c.c_end, m.idx + 1 AS t_no, CASE WHEN m.kind = 'event' THEN list_last(string_split(m.type_name, '.')) ELSE m.entity_type END AS stype,
      row_number() OVER (PARTITION BY m.doc, m.kind ORDER BY m.idx) AS e_no FROM mentions m JOIN ct c ON c.doc = m.doc AND c.tid = m.m_start),
    rn AS (SELECT *, CASE WHEN n > 1 THEN role || n ELSE role END AS role_name FROM (SELECT *, row_number() OVER (PARTITION BY doc, e_idx, role ORDER BY a_start, a_idx) AS n FROM arguments)),
    ln AS (SELECT doc, 'T' || t_no || ' ' || stype || ' ' || c_start || ' ' || c_end || ' ' || tok AS line FROM so
      UNION ALL SELECT so.doc, rtrim('E' || so.e_no || ' ' || so.stype || ':T' || so.t_no || ' ' || coalesce(r.r, '')) FROM so LEFT JOIN (SELECT doc, e_idx, string_agg(role_name || ':T' || (a_idx + 1), ' ' ORDER BY a_start) AS r FROM rn GROUP BY ALL) r
        ON r.doc = so.doc AND r.e_idx = so.idx WHERE so.kind = 'event')"""


@query("snk04_write_standoff", f"WITH {STANDOFF} SELECT doc::VARCHAR AS doc, line FROM ln")
def _(t):
    path = fresh_path(t.spark, "standoff")
    W.write_standoff(W.standoff_lines(*_standoff(t)), path)
    return t.spark.read.text(path).select(F.substring_index("value", "\t", 1).alias("doc"), F.substring_index("value", "\t", -1).alias("line"))


@query(
    "src06_read_standoff",
    f"""WITH {STANDOFF} SELECT 'mention' AS part, doc::VARCHAR AS doc, 'T' || t_no AS id, stype AS a, tok AS b, c_start AS c_from, c_end - 1 AS c_to FROM so
        UNION ALL SELECT 'event', doc::VARCHAR, 'E' || e_no, stype, 'T' || t_no, NULL, NULL FROM so WHERE kind = 'event'
        UNION ALL SELECT 'role', r.doc::VARCHAR, 'E' || so.e_no, r.role_name, 'T' || (r.a_idx + 1), NULL, NULL FROM rn r JOIN so ON so.doc = r.doc AND so.idx = r.e_idx""",
)
def _(t):
    path = fresh_path(t.spark, "standoff")
    W.write_standoff(W.standoff_lines(*_standoff(t)), path)
    read = R.read_standoff(t.spark, path, tagged=True)
    none = F.lit(None).cast("long")
    mentions = read["mentions"].select(F.lit("mention").alias("part"), "doc", F.col("m_id").alias("id"), F.col("type").alias("a"), F.col("text").alias("b"), "c_from", "c_to")
    events = read["events"].select(F.lit("event").alias("part"), "doc", F.col("e_id").alias("id"), F.col("type").alias("a"), F.col("trigger").alias("b"), none.alias("c_from"), none.alias("c_to"))
    roles = read["roles"].select(F.lit("role").alias("part"), "doc", F.col("e_id").alias("id"), F.col("role").alias("a"), F.col("m_id").alias("b"), none.alias("c_from"), none.alias("c_to"))
    return mentions.unionByName(events).unionByName(roles)


@query(
    "src07_read_captions_and_phrases",
    """SELECT doc::VARCHAR AS doc, sent, lemma AS cluster, tok AS phrase, m_start AS "offset", (SELECT len(words) FROM sentences s WHERE s.doc = m.doc AND s.sent = m.sent) AS n_words FROM mentions m""",
)
def _(t):
    captions, phrases = fresh_path(t.spark, "captions"), fresh_path(t.spark, "phrases")
    t.sentences().select(F.concat_ws(" ", F.concat_ws("_", "doc", "sent"), F.array_join("words", " ")).alias("value")).write.text(captions)
    t.mentions().select(F.concat_ws(" ", "doc", "sent", "lemma", "tok", "m_start").alias("value")).write.text(phrases)
    sizes = R.read_captions(t.spark, captions).select(
        F.substring_index("doc", "_", 1).alias("doc"), F.substring_index("doc", "_", -1).cast("long").alias("sent"), F.size("words").alias("n_words")
    )
    return R.read_phrases(t.spark, phrases).join(sizes, ["doc", "sent"])


@query("src07_read_boxes", f"WITH {BOXES} SELECT doc::VARCHAR AS doc, box::VARCHAR AS cluster, x0, y0, x1, y1 FROM boxes")
def _(t):
    path = fresh_path(t.spark, "boxes")
    _boxes(t).select(F.concat_ws(" ", "doc", "box", *M.BOX).alias("value")).write.text(path)
    return R.read_boxes(t.spark, path)


@query(
    "src08_read_word_vectors",
    f"SELECT 'w ' || vec_id AS word, {SHAPE} FROM vecs WHERE vec_id IN (SELECT m_start FROM mentions)",
)
def _(t):
    path = fresh_path(t.spark, "word-vectors")
    t.embeddings().select(F.concat_ws(" ", F.lit("w"), "vec_id", F.array_join(F.col("emb").cast("array<string>"), " ")).alias("value")).write.text(path)
    vocabulary = t.mentions().select(F.concat_ws(" ", F.lit("w"), "m_start").alias("word")).distinct()
    return R.read_word_vectors(t.spark, path, 64, vocabulary).select("word", *shape())


@query("src09_read_frame_features", f"SELECT doc::VARCHAR AS doc, fidx AS frame, {SHAPE} FROM frames")
def _(t):
    path = fresh_path(t.spark, "frames")
    wide = t.frames().select(F.col("doc").alias("video"), F.col("fidx").alias("frame"), *[F.col("emb")[i].alias(f"f{i}") for i in range(64)])
    wide.write.option("header", True).csv(path)
    return R.read_frame_features(t.spark, path, dim=64, doc_column="video").select("doc", "frame", *shape())


@query("src10_feature_key", "SELECT source || '_' || lang AS doc, doc_id AS row FROM documents")
def _(t):
    from corefold.functions import text as X

    keyed = t.read("documents").select(F.concat_ws("_", "source", "lang", "doc_id").alias("feat_id"))
    return keyed.select(X.feature_document(F.col("feat_id")).alias("doc"), X.feature_row(F.col("feat_id")).alias("row"))


DIALOGUE = """sl AS (SELECT DISTINCT doc, label FROM segments WHERE t1 - t0 > 40000), dm AS (SELECT m.*, CASE type WHEN 0 THEN 'click' WHEN 1 THEN 'purchase' ELSE 'signup' END AS label FROM mentions m),
    dk AS (SELECT DISTINCT dm.doc FROM dm JOIN sl ON dm.doc = sl.doc AND dm.label = sl.label),
    cg AS (SELECT doc, cluster, list([m_start, m_end] ORDER BY m_start, m_end) AS c FROM dm WHERE cluster > 0 AND doc IN (SELECT doc FROM dk) GROUP BY ALL),
    cn AS (SELECT doc, cluster, row_number() OVER (PARTITION BY doc ORDER BY c) - 1 AS n, count(*) OVER (PARTITION BY doc) AS total FROM cg),
    cd AS (SELECT DISTINCT p.doc, n.m_start, n.m_end, n.cluster FROM dm p JOIN dm n ON p.doc = n.doc AND n.idx BETWEEN p.idx - 5 AND p.idx WHERE p.mtype = 'pronoun' AND n.mtype <> 'pronoun' AND p.doc IN (SELECT doc FROM dk)),
    sg AS (SELECT doc, m_start, m_end, row_number() OVER (PARTITION BY doc ORDER BY m_start, m_end) - 1 AS k FROM cd WHERE cluster = 0)"""


def _dialogue(t):
    path = fresh_path(t.spark, "dialogue")
    ids = t.spark.createDataFrame([("click", 0), ("purchase", 1), ("signup", 2), ("view", 3), ("error", 4)], "label string, label_id long")
    labels = t.segments().filter("t1 - t0 > 40000").select("doc", "label").distinct().join(ids, "label")
    named = t.mentions().withColumn("label", F.when(F.col("type") == 0, "click").when(F.col("type") == 1, "purchase").otherwise("signup"))
    W.export_dialogue_coref(t.sentences(), named, labels, path)
    return path


@query(
    "src11_read_dialogue_coref",
    f"""WITH {DIALOGUE} SELECT dm.doc::VARCHAR AS doc, dm.m_start, dm.m_end, cn.n AS cluster FROM dm JOIN cn ON dm.doc = cn.doc AND dm.cluster = cn.cluster
        UNION ALL SELECT sg.doc::VARCHAR, m_start, m_end, coalesce((SELECT max(total) FROM cn WHERE cn.doc = sg.doc), 0) + k FROM sg""",
)
def _(t):
    return R.read_dialogue_coref(t.spark, _dialogue(t))["spans"]


@query(
    "snk07_export_dialogue_coref",
    f"""WITH {DIALOGUE} SELECT dk.doc::VARCHAR AS doc_key, (SELECT count(*) FROM sentences s WHERE s.doc = dk.doc) AS n_sentences, (SELECT count(*) FROM cn WHERE cn.doc = dk.doc) AS n_clusters,
        (SELECT count(DISTINCT sl.label) FROM sl JOIN dm ON dm.doc = sl.doc AND dm.label = sl.label WHERE sl.doc = dk.doc) AS n_labels FROM dk""",
)
def _(t):
    raw = t.spark.read.schema(R.DIALOGUE_SCHEMA).json(_dialogue(t))
    return raw.select("doc_key", F.size("sentences").alias("n_sentences"), F.size("clusters").alias("n_clusters"), F.size("object_detection").alias("n_labels"))


@query(
    "snk01_write_normalised",
    """SELECT doc, idx, CASE WHEN doc % 5 = 0 THEN 'test' ELSE 'train' END AS split, kind, CASE WHEN kind = 'event' THEN type_name END AS event_type, CASE WHEN kind = 'entity' THEN entity_type END AS entity_type FROM mentions""",
)
def _(t):
    path = fresh_path(t.spark, "normalised")
    m = t.mentions().withColumn("split", F.when(F.col("doc") % 5 == 0, "test").otherwise("train"))
    events = m.filter("kind = 'event'").select("doc", "idx", "split", F.col("type_name").alias("event_type"))
    entities = m.filter("kind = 'entity'").select("doc", "idx", "split", "entity_type")
    W.write_normalised(t.tokens().select("doc", "sent", "tid", "tok"), events, entities, path)
    return t.spark.read.parquet(f"{path}/mentions")


BRACKETS = """bm AS (SELECT doc, m_start AS tid, 0 AS part, 0 AS far, cluster::VARCHAR AS c, '(' || cluster || ')' AS mark FROM mentions WHERE cluster > 0 AND m_start = m_end
      UNION ALL SELECT doc, m_start, 1, -m_end, cluster::VARCHAR, '(' || cluster FROM mentions WHERE cluster > 0 AND m_start < m_end
      UNION ALL SELECT doc, m_end, 2, -m_start, cluster::VARCHAR, cluster || ')' FROM mentions WHERE cluster > 0 AND m_start < m_end),
    br AS (SELECT t.doc, t.sent, t.tid, t.tok, length(t.tok) >= 8 AS flag, coalesce(b.m, '-') AS clusters FROM tokens t LEFT JOIN (SELECT doc, tid, string_agg(mark, '|' ORDER BY part, far, c) AS m FROM bm GROUP BY ALL) b ON b.doc = t.doc AND b.tid = t.tid)"""


@query("snk03_conll_brackets", f"WITH {BRACKETS} SELECT doc, tid, clusters FROM br")
def _(t):
    return W.conll_brackets(t.tokens(), t.mentions()).select("doc", "tid", "clusters")


@query(
    "snk02_write_conll",
    f"""WITH {BRACKETS}, tp AS (SELECT *, 'topic' || (doc % 3) AS topic FROM br) SELECT topic, topic || chr(9) || topic || '_0' || chr(9) || doc || chr(9) || sent || chr(9) || tid || chr(9) || tok || chr(9) || (CASE WHEN flag THEN 'true' ELSE 'false' END) || chr(9) || clusters AS line FROM tp
        UNION ALL SELECT DISTINCT topic, '#begin document ' || doc FROM tp UNION ALL SELECT topic, '#end document' FROM (SELECT DISTINCT topic, doc FROM tp)""",
)
def _(t):
    path = fresh_path(t.spark, "conll")
    marked = W.conll_brackets(t.tokens(), t.mentions()).withColumn("flag", F.length("tok") >= 8).withColumn("topic", F.concat(F.lit("topic"), F.col("doc") % 3))
    W.write_conll(W.conll_lines(marked), path)
    return t.spark.read.text(path).select("topic", F.col("value").alias("line"))


@query(
    "snk05_write_pair_predictions",
    f"""WITH {SCORED} SELECT c.doc::VARCHAR AS doc, a.tok AS a, b.tok AS b, (c.score > 0.5)::INT::VARCHAR AS label, printf('%.2f', c.score) AS score FROM cand c JOIN mentions a ON a.doc = c.doc AND a.idx = c.i
        JOIN mentions b ON b.doc = c.doc AND b.idx = c.j""",
)
def _(t):
    path = fresh_path(t.spark, "pair-predictions")
    pairs = scored_candidates(t).filter("i >= 0").withColumn("label", (F.col("score") > 0.5).cast("int"))
    W.write_pair_predictions(pairs, t.mentions().select("doc", "idx", F.col("tok").alias("text")), path)
    return t.spark.read.csv(path, sep="\t", schema="doc string, a string, b string, label string, score string", quote="")


@query("snk06_write_model_tables", f"WITH {TEXT} SELECT src, tgt, round(count, 6) AS count, round(p, 6) AS p FROM (SELECT src, tgt, c AS count, c / sum(c) OVER (PARTITION BY src) AS p FROM (SELECT src, tgt, sum(n / s) AS c FROM (SELECT *, sum(n) OVER (PARTITION BY doc, j) AS s FROM cand) GROUP BY ALL))")
def _(t):
    path = fresh_path(t.spark, "model")
    W.write_model_tables({"translation": fitted_text(t, 1).translation.drop("mode")}, path)
    return _rounded(t.spark.read.schema("src string, tgt string, count double, p double").json(f"{path}/translation"))


@query("prj44_non_empty_files", "SELECT count(DISTINCT bucket) AS n_files FROM (SELECT doc_id % 16 AS bucket FROM documents WHERE n_chars % 7 = 0)")
def _(t):
    path = fresh_path(t.spark, "annotation-files")
    text = F.when(F.col("n_chars") % 7 == 0, F.lit("T1 x 0 1 y")).otherwise("  ")
    rows = t.read("documents").select((F.col("doc_id") % 16).alias("bucket"), text.alias("value"))
    rows.repartition("bucket").write.partitionBy("bucket").text(path)
    return R.non_empty_files(t.spark, path).agg(F.countDistinct("file").alias("n_files"))


@query(
    "prj42_readable_annotations",
    """SELECT a.doc, a.e_idx, a.a_idx, CASE a.role WHEN 'Agent' THEN 'role-0' WHEN 'Patient' THEN 'role-1' END AS role_name, CASE a.entity_type WHEN 'Person' THEN 'type-0' WHEN 'Place' THEN 'type-1' END AS type_name, round(l.duration, 3) AS duration
       FROM arguments a LEFT JOIN (SELECT doc, max(duration) AS duration FROM log GROUP BY doc) l ON l.doc = a.doc""",
)
def _(t):
    roles = t.spark.createDataFrame([(0, "role-0"), (1, "role-1")], "role_id long, role_name string")
    types = t.spark.createDataFrame([(0, "type-0"), (1, "type-1")], "entity_id long, type_name string")
    rows = t.arguments().select(
        "doc", "e_idx", "a_idx", F.when(F.col("role") == "Agent", 0).when(F.col("role") == "Patient", 1).cast("long").alias("role_id"),
        F.when(F.col("entity_type") == "Person", 0).when(F.col("entity_type") == "Place", 1).cast("long").alias("entity_id"),
    )
    durations = t.log().groupBy("doc").agg(F.round(F.max("duration"), 3).alias("duration"))
    return M.role_names(rows, roles, types).join(durations, "doc", "left").drop("role_id", "entity_id")


@query(
    "prj43_synthetic_visual_events",
    """WITH ty AS (SELECT type_name, row_number() OVER (ORDER BY min(struct_pack(d := doc, i := idx))) AS id FROM mentions WHERE kind = 'event' GROUP BY ALL),
       lm AS (SELECT lemma, row_number() OVER (ORDER BY min(struct_pack(d := doc, i := idx))) AS id FROM mentions WHERE kind = 'entity' GROUP BY ALL),
       u AS (SELECT doc, e_idx, e_type, a_lemma, arg_max(role, struct_pack(a := a_start, b := a_idx)) AS role FROM arguments GROUP BY ALL)
       SELECT u.doc, u.e_idx, ty.id AS event_id, lm.id AS argument_id, u.role FROM u JOIN ty ON ty.type_name = u.e_type JOIN lm ON lm.lemma = u.a_lemma""",
)
def _(t):
    m = t.mentions()
    types = C.build_vocab(m.filter("kind = 'event'").select(F.col("type_name").alias("word"), "doc", "idx")).select(F.col("word").alias("e_type"), F.col("id").alias("event_id"))
    words = C.build_vocab(m.filter("kind = 'entity'").select(F.col("lemma").alias("word"), "doc", "idx")).select(F.col("word").alias("a_lemma"), F.col("id").alias("argument_id"))
    unique = t.arguments().groupBy("doc", "e_idx", "e_type", "a_lemma").agg(F.max_by("role", F.struct("a_start", "a_idx")).alias("role"))
    return unique.join(types, "e_type").join(words, "a_lemma").select("doc", "e_idx", "event_id", "argument_id", "role")
