"""Queries on pairs, match rules, frames, boxes and pooled vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from corefold.catalog.registry import query
from corefold.catalog.tables import six_digits
from corefold.functions import text as X
from corefold.functions import vectors as V
from corefold.operators import media as M
from corefold.operators import order
from corefold.operators import pairs as P
from corefold.operators import spans as S
from corefold.plans.mixture import SENT
from corefold.session import broadcast_if_small, written


def shape(vector: str = "emb"):
    """A whole vector as comparable columns: its size and all values in millionths."""
    v = F.col(vector)
    parts = F.transform(v, lambda x: F.floor(x * 1e6 + 0.5 + 1e-4).cast("long").cast("string"))
    return [F.size(v).alias("n"), F.array_join(parts, ",").alias("millionths")]


SHAPE = "len(emb)::BIGINT AS n, array_to_string(list_transform(emb, lambda x: floor(x * 1e6 + 0.5 + 1e-4)::BIGINT), ',') AS millionths"


def mean_sql(keys: str, rows: str) -> str:
    """Mean vector per keys of ``rows``, a query with ``keys`` and emb."""
    return f"""SELECT {keys}, list(x ORDER BY dim) AS emb FROM (SELECT {keys}, dim, avg(x) AS x FROM (
        SELECT {keys}, unnest(emb) AS x, generate_subscripts(emb, 1) AS dim FROM ({rows})) GROUP BY ALL) GROUP BY ALL"""


COSINE = "abs(list_dot_product({0}, {1})) / greatest(1e-100, sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"


@query("jon01_mention_pairs", "SELECT a.doc, a.idx AS i, b.idx AS j FROM mentions a JOIN mentions b ON a.doc = b.doc AND a.idx < b.idx")
def _(t):
    return P.mention_pairs(t.mentions(), block=64)


@query(
    "jon02_antecedent_candidates",
    """SELECT a.doc, a.type, a.idx AS i, b.idx AS j FROM mentions a JOIN mentions b ON a.doc = b.doc AND a.type = b.type AND a.idx < b.idx
       UNION ALL SELECT doc, type, -1, idx FROM mentions""",
)
def _(t):
    return P.antecedent_candidates(t.mentions(), ["doc", "type"], block=64)


@query(
    "jon03_mention_action_pairs",
    "SELECT m.doc, m.idx, s.seg, s.label FROM mentions m JOIN segments s ON m.doc = s.doc",
)
def _(t):
    return P.mention_action_pairs(t.mentions().select("doc", "idx"), t.segments().select("doc", "seg", "label"))


@query(
    "jon04_pair_label",
    """SELECT a.doc, a.idx AS i, b.idx AS j, (a.cluster = b.cluster AND a.cluster <> 0)::BIGINT AS y, (a.cluster = b.cluster)::BIGINT AS y_zero_counts
       FROM mentions a JOIN mentions b ON a.doc = b.doc AND a.lemma = b.lemma AND a.idx < b.idx""",
)
def _(t):
    pairs = P.mention_pairs(t.mentions(), ["doc", "lemma"], ["cluster"])
    a, b = F.col("a_cluster"), F.col("b_cluster")
    return pairs.select("doc", "i", "j", P.pair_label(a, b).alias("y"), P.pair_label(a, b, zero_is_none=False).alias("y_zero_counts"))


@query(
    "jon05_crosswalk_label",
    """SELECT m.doc, m.idx, s.seg, (EXISTS (SELECT 1 FROM crosswalk c WHERE c.type = m.type AND c.label = s.label))::BIGINT AS y
       FROM mentions m JOIN segments s ON m.doc = s.doc WHERE m.kind = 'event'""",
)
def _(t):
    events = t.mentions().filter("kind = 'event'").select("doc", "idx", "type")
    pairs = P.mention_action_pairs(events, t.segments().select("doc", "seg", "label"))
    return P.crosswalk_label(pairs, t.crosswalk()).select("doc", "idx", "seg", "y")


@query(
    "jon06_invert_ontology_map",
    """WITH m AS (SELECT lemma AS coarse, tok AS fine, max(doc * 100000 + idx) AS o FROM mentions GROUP BY ALL) SELECT substr(fine, 2, 4) AS fine, arg_max(coarse, struct_pack(a := g, b := fine)) AS coarse
       FROM (SELECT *, min(o) OVER (PARTITION BY coarse) AS g FROM m) GROUP BY 1""",
)
def _(t):
    words = t.mentions().groupBy(F.col("lemma").alias("coarse"), F.col("tok").alias("fine")).agg(F.max(F.col("doc") * 100000 + F.col("idx")).alias("o"))
    table = words.groupBy("coarse").agg(F.min("o").alias("ord"), F.array_sort(F.collect_set("fine")).alias("fine"))
    return P.invert_map(table.withColumn("fine", F.transform("fine", lambda w: F.substring(w, 2, 4))))


@query(
    "jon07_annotation_time_to_frame",
    "SELECT doc, seg, label, floor(t0 / duration * 100)::BIGINT AS f0, floor(t1 / duration * 100)::BIGINT AS f1 FROM segments",
)
def _(t):
    return M.annotation_frames(t.segments()).select("doc", "seg", "label", "f0", "f1")


@query(
    "jon08_frames_in_segment",
    """SELECT s.doc, s.seg, f.fidx FROM (SELECT *, floor(t0 / duration * 100) AS f0, floor(t1 / duration * 100) AS f1 FROM segments) s
       JOIN plain_frames f ON f.doc = s.doc AND f.frame BETWEEN s.f0 AND s.f1""",
)
def _(t):
    found = M.frames_in_segment(M.annotation_frames(t.segments()), t.frames(with_vectors=False))
    return found.select("doc", "seg", "fidx")


SENTENCE_FRAMES = """SELECT s.doc, s.fidx AS sent, f.fidx, f.emb FROM (SELECT *, floor(t / duration * 100) AS f0, floor(least(t + 40000, duration) / duration * 100) AS f1 FROM log) s
    JOIN frames f ON f.doc = s.doc AND f.frame BETWEEN s.f0 AND s.f1"""


@query("jon09_sentence_frames", f"SELECT doc, sent, {SHAPE} FROM ({mean_sql('doc, sent', SENTENCE_FRAMES)})")
def _(t):
    spoken = t.log().select("doc", F.col("fidx").alias("seg"), F.col("t").alias("t0"), F.least(F.col("t") + 40000, "duration").alias("t1"), "duration")
    members = M.frames_in_segment(M.annotation_frames(spoken), t.frames())
    return M.vector_mean(members, ["doc", "seg"]).select("doc", F.col("seg").alias("sent"), *shape())


@query("jon09_document_mean", f"SELECT doc, {SHAPE} FROM ({mean_sql('doc', 'SELECT doc, emb FROM frames')})")
def _(t):
    return M.vector_mean(t.frames(), ["doc"]).select("doc", *shape())


@query(
    "jon10_keyframe_arguments",
    """WITH k AS (SELECT doc, frame, arg_min(emb, fidx) AS emb FROM frames GROUP BY doc, frame)
       SELECT a.doc, a.e_idx, a.a_idx, CASE a.entity_type WHEN 'Person' THEN 0 WHEN 'Place' THEN 1 ELSE -1 END::BIGINT AS entity_id,
       CASE a.role WHEN 'Agent' THEN 0 WHEN 'Patient' THEN 1 ELSE -1 END::BIGINT AS role_id, round(k.emb[1], 6) AS first
       FROM arguments a LEFT JOIN k ON a.doc = k.doc AND k.frame = a.a_start % 100""",
)
def _(t):
    entity_ids = t.spark.createDataFrame([("Person", 0), ("Place", 1)], "entity_type string, entity_id long")
    role_ids = t.spark.createDataFrame([("Agent", 0), ("Patient", 1)], "role string, role_id long")
    keyed = t.arguments().withColumn("frame", F.col("a_start") % 100)
    return M.keyframe_arguments(keyed, t.frames(), entity_ids, role_ids).select(
        "doc", "e_idx", "a_idx", "entity_id", "role_id", six_digits(F.element_at("emb", 1)).alias("first")
    )


BOXES = """boxes AS (SELECT l_orderkey AS doc, l_linenumber * 1000000 + l_partkey AS box, l_linenumber % 2 AS side, l_quantity AS x0, l_suppkey % 50 + 0.0::DOUBLE AS y0,
    l_quantity + 5 + l_partkey % 20 AS x1, l_suppkey % 50 + 5.0::DOUBLE + l_partkey % 17 AS y1, l_linenumber, l_partkey, l_suppkey FROM lineitem)"""
HULL = """CASE WHEN least(p.x1, g.x1) < greatest(p.x0, g.x0) OR least(p.y1, g.y1) < greatest(p.y0, g.y0) THEN 0 ELSE (least(p.y1, g.y1) - greatest(p.y0, g.y0)) * (least(p.x1, g.x1) - greatest(p.x0, g.x0))
    / ((greatest(p.y1, g.y1) - least(p.y0, g.y0)) * (greatest(p.x1, g.x1) - least(p.x0, g.x0))) END"""


def _boxes(t):
    li = t.read("lineitem")
    return li.select(
        F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("box"),
        (F.col("l_linenumber") % 2).alias("side"), F.col("l_quantity").alias("x0"), (F.col("l_suppkey") % 50).cast("double").alias("y0"),
        (F.col("l_quantity") + 5 + F.col("l_partkey") % 20).alias("x1"), (F.col("l_suppkey") % 50 + 5 + F.col("l_partkey") % 17).cast("double").alias("y1"),
        "l_linenumber", "l_partkey",
    )


@query(
    "jon11_box_overlap_join",
    f"""WITH {BOXES} SELECT p.doc, p.box AS p_box, g.box AS g_box, round({HULL}, 6) AS overlap FROM boxes p JOIN boxes g ON p.doc = g.doc
        WHERE p.side = 1 AND g.side = 0 AND {HULL} > 0.2""",
)
def _(t):
    boxes = _boxes(t)
    found = M.box_overlap_join(boxes.filter("side = 1"), boxes.filter("side = 0"), 0.2, cell=16.0)
    return found.withColumn("overlap", six_digits("overlap"))


@query(
    "fun17_enclosing_box_overlap",
    f"""WITH {BOXES}, r AS (SELECT *, 10.0::DOUBLE AS r0, 40.0::DOUBLE AS r1 FROM boxes) SELECT p.doc, p.box, round({HULL.replace('g.x0', 'p.r0').replace('g.y0', 'p.r0').replace('g.x1', 'p.r1').replace('g.y1', 'p.r1')}, 6) AS overlap FROM r p""",
)
def _(t):
    window = [F.lit(10.0), F.lit(10.0), F.lit(40.0), F.lit(40.0)]
    overlap = M.hull_overlap([F.col(c) for c in M.BOX], window)
    return _boxes(t).select("doc", "box", six_digits(overlap).alias("overlap"))


@query(
    "jon12_phrase_box_join",
    """WITH ph AS (SELECT o_custkey AS doc, o_orderpriority AS cluster, o_orderkey AS ord, o_orderstatus || o_orderkey AS phrase FROM orders),
       l AS (SELECT doc, cluster, arg_max(phrase, ord) AS phrase FROM ph GROUP BY ALL)
       SELECT b.c_custkey AS doc, b.c_name AS box, coalesce(l.phrase, '') AS phrase FROM (SELECT *, CASE c_nationkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE '5-LOW' END AS cluster FROM customer) b
       LEFT JOIN l ON b.c_custkey = l.doc AND b.cluster = l.cluster""",
)
def _(t):
    phrases = t.read("orders").select(
        F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("cluster"), F.col("o_orderkey").alias("ord"),
        F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("phrase"),
    )
    kind = F.col("c_nationkey") % 3
    boxes = t.read("customer").select(
        F.col("c_custkey").alias("doc"), F.col("c_name").alias("box"),
        F.when(kind == 0, "1-URGENT").when(kind == 1, "2-HIGH").otherwise("5-LOW").alias("cluster"),
    )
    return M.phrase_box_join(boxes, phrases).select("doc", "box", "phrase")


DIM = 64
WORDS = "words_v AS (SELECT w.word, v.emb FROM (SELECT DISTINCT tok AS word FROM mentions WHERE cluster > 0) w JOIN vecs v ON v.vec_id = (length(w.word) * 31 + ascii(w.word)) % (SELECT count(*) FROM embeddings))"
TOKEN_V = WORDS + ", token_v AS (SELECT t.doc, t.tid, t.tok, coalesce(w.emb, list_transform(range(64), lambda i: 0::DOUBLE)) AS emb FROM tokens t LEFT JOIN words_v w ON t.tok = w.word)"


def _word_vectors(t):
    words = t.mentions().filter("cluster > 0").select(F.col("tok").alias("word")).distinct()
    keyed = words.withColumn("vec_id", (F.length("word") * 31 + F.ascii("word")) % t._n_vectors())
    return keyed.join(t.embeddings().drop("label"), "vec_id").select("word", "emb")


def _token_vectors(t):
    return M.token_vectors(t.tokens(), _word_vectors(t), DIM)


@query("jon13_token_vectors", f"WITH {TOKEN_V} SELECT doc, tid, {SHAPE} FROM token_v")
def _(t):
    return _token_vectors(t).select("doc", "tid", *shape())


@query(
    "jon14_piece_vectors",
    f"""WITH {TOKEN_V}, p AS (SELECT doc, tid, i, row_number() OVER (PARTITION BY doc ORDER BY tid, i) - 1 AS piece FROM (
        SELECT doc, tid, unnest(range(CASE WHEN length(tok) = 0 THEN 0 ELSE (length(tok) + 3) // 4 END)) AS i FROM tokens)),
        j AS (SELECT p.doc, p.piece, [p.piece::DOUBLE, 1.0::DOUBLE] || v.emb AS emb FROM p JOIN token_v v ON p.doc = v.doc AND p.tid = v.tid)
        SELECT doc, piece, {SHAPE} FROM j""",
)
def _(t):
    pieces = S.pieces_of_tokens(S.piece_alignment(t.tokens().select("doc", "tid", "tok").withColumn("n_pieces", F.ceil(F.length("tok") / 4))), ["tok"])
    pieces = written(pieces, "pieces")
    own = pieces.select("doc", "piece", F.array(F.col("piece").cast("double"), F.lit(1.0)).alias("emb"))
    words = written(M.token_vectors(t.tokens().select("tok").distinct(), _word_vectors(t), DIM), "word-vectors")
    return M.piece_vectors(pieces, broadcast_if_small(words, SENT // DIM), own, ["tok"]).select("doc", "piece", *shape())


MENTION_MEAN = "SELECT m.doc, m.idx, v.emb FROM mentions m JOIN token_v v ON m.doc = v.doc AND v.tid BETWEEN m.m_start AND m.m_end"


@query("jon15_mention_vector_mean", f"WITH {TOKEN_V}, mm AS ({mean_sql('doc, idx', MENTION_MEAN)}) SELECT doc, idx, {SHAPE} FROM mm")
def _(t):
    return M.mention_vector_mean(t.mentions(), _token_vectors(t)).select("doc", "idx", *shape())


@query(
    "jon16_mention_vector_head",
    f"""WITH {TOKEN_V}, mm AS ({mean_sql('doc, idx', MENTION_MEAN)}) SELECT doc, idx, {SHAPE} FROM (
        SELECT m.doc, m.idx, coalesce(w.emb, mm.emb) AS emb FROM mentions m JOIN mm ON m.doc = mm.doc AND m.idx = mm.idx LEFT JOIN words_v w ON w.word = m.tok AND m.tag = 'NN')""",
)
def _(t):
    m = t.mentions()
    means = M.mention_vector_mean(m, _token_vectors(t))
    heads = m.withColumn("lemma", F.when(F.col("tag") == "NN", F.col("tok")))
    return M.mention_vector_head(heads, _word_vectors(t), means).select("doc", "idx", *shape())


@query(
    "jon17_argument_vectors",
    f"""WITH a AS (SELECT a.doc, a.e_idx, a.a_start, v.emb, row_number() OVER (PARTITION BY a.doc, a.e_idx ORDER BY a.a_start) AS n FROM arguments a JOIN vectors v ON a.doc = v.doc AND a.a_idx = v.idx),
        f AS (SELECT doc, e_idx, flatten(list(emb ORDER BY n)) AS emb FROM a WHERE n <= 10 GROUP BY ALL)
        SELECT doc, idx, {SHAPE} FROM (SELECT m.doc, m.idx, (coalesce(f.emb, []::DOUBLE[]) || list_transform(range(640), lambda i: 0::DOUBLE))[1:640] AS emb
        FROM mentions m LEFT JOIN f ON m.doc = f.doc AND m.idx = f.e_idx WHERE m.kind = 'event')""",
)
def _(t):
    events = t.mentions().filter("kind = 'event'").select("doc", "idx")
    return M.argument_vectors(events, t.arguments(), t.vectors(), DIM).select("doc", "idx", *shape())


@query(
    "jon17_argument_slots",
    f"""WITH a AS (SELECT a.doc, a.e_idx, v.emb, row_number() OVER (PARTITION BY a.doc, a.e_idx ORDER BY a.a_start) - 1 AS slot FROM arguments a JOIN vectors v ON a.doc = v.doc AND a.a_idx = v.idx)
        SELECT doc, e_idx, slot, {SHAPE} FROM a""",
)
def _(t):
    return M.argument_slots(t.arguments(), t.vectors()).select("doc", "e_idx", "slot", *shape())


@query(
    "jon18_concat_features",
    f"SELECT doc, idx AS row, {SHAPE} FROM (SELECT v.doc, v.idx, v.emb || f.emb AS emb FROM vectors v JOIN frames f ON v.doc = f.doc AND v.idx = f.fidx)",
)
def _(t):
    left = t.vectors().withColumnRenamed("idx", "row")
    right = t.frames().select("doc", F.col("fidx").alias("row"), "emb")
    return M.concat_features(left, right).select("doc", "row", *shape())


@query(
    "jon19_match_ie_to_gold",
    """SELECT t.doc, t.idx AS t_id, arg_min(g.idx, struct_pack(a := greatest(g.m_start, t.m_start), b := g.idx)) AS gold_idx FROM (
       SELECT doc, idx, greatest(0, m_start - 2) AS m_start, m_start + 1 AS m_end FROM mentions WHERE kind = 'entity') t
       JOIN mentions g ON g.doc = t.doc AND g.kind = 'event' AND g.m_start <= t.m_end AND g.m_end >= t.m_start GROUP BY t.doc, t.idx""",
)
def _(t):
    m = t.mentions()
    found = m.filter("kind = 'entity'").select(
        "doc", F.col("idx").alias("t_id"), F.greatest(F.lit(0), F.col("m_start") - 2).alias("m_start"), (F.col("m_start") + 1).alias("m_end")
    )
    return P.match_ie_to_gold(found, m.filter("kind = 'event'"))


@query(
    "jon20_label_overlap_docs",
    "SELECT DISTINCT m.doc, c.label FROM mentions m JOIN crosswalk c ON m.type = c.type JOIN segments s ON s.doc = m.doc AND s.label = c.label",
)
def _(t):
    text_labels = t.mentions().select("doc", "type").distinct().join(t.crosswalk(), "type").select("doc", "label")
    return text_labels.distinct().join(t.segments().select("doc", "label"), ["doc", "label"], "left_semi")


@query(
    "jon21_split_by_ids",
    """SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'test' ELSE 'train' END AS split FROM orders""",
)
def _(t):
    orders = t.read("orders").select("o_orderkey", "o_custkey")
    ids = t.read("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    test = orders.join(ids, "o_custkey", "left_semi").withColumn("split", F.lit("test"))
    train = orders.join(ids, "o_custkey", "left_anti").withColumn("split", F.lit("train"))
    return test.unionByName(train).select("o_orderkey", "split")


@query(
    "jon21_split_by_ratio",
    """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) - 1 < floor(0.8 * (SELECT count(*) FROM orders)) THEN 'train' ELSE 'test' END AS split FROM orders""",
)
def _(t):
    orders = t.read("orders").select("o_orderkey")
    total = orders.count()
    ranked = order.number_by_range(orders, ["o_orderkey"], "_n")
    return ranked.select("o_orderkey", F.when(F.col("_n") < int(0.8 * total), "train").otherwise("test").alias("split"))


STRING_MATCH = """(a.{t} = b.{t} OR a.{l} = b.{l} OR contains(a.{t}, b.{t}) OR contains(b.{t}, a.{t})
    OR levenshtein(a.{t}, b.{t})::DOUBLE / greatest(length(a.{t}), length(b.{t})) <= {x} OR levenshtein(a.{l}, b.{l})::DOUBLE / greatest(length(a.{l}), length(b.{l})) <= {y})"""


@query(
    "jon22_argument_compatibility",
    f"""WITH p AS (SELECT a.doc, a.idx AS i, b.idx AS j FROM mentions a JOIN mentions b ON a.doc = b.doc AND a.lemma = b.lemma AND a.idx < b.idx AND a.kind = 'event' AND b.kind = 'event'),
        g AS (SELECT a.*, v.emb FROM arguments a JOIN vectors v ON a.doc = v.doc AND a.a_idx = v.idx WHERE a.entity_type = 'Person'),
        h AS (SELECT p.doc, p.i, p.j, b.a_idx, bool_or({STRING_MATCH.format(t='a_tok', l='a_lemma', x=0.5, y=0.5)} OR {COSINE.format('a.emb', 'b.emb')} > 0.4) AS ok
          FROM p JOIN g a ON a.doc = p.doc AND a.e_idx = p.i JOIN g b ON b.doc = p.doc AND b.e_idx = p.j GROUP BY ALL),
        v AS (SELECT doc, i, j, bool_and(ok) AS ok FROM h GROUP BY ALL)
        SELECT p.doc, p.i, p.j, coalesce(v.ok, true) AS compatible FROM p LEFT JOIN v ON p.doc = v.doc AND p.i = v.i AND p.j = v.j""",
)
def _(t):
    events = t.mentions().filter("kind = 'event'")
    pairs = P.mention_pairs(events, ["doc", "lemma"]).select("doc", "i", "j")
    args = t.arguments().join(t.vectors().select("doc", F.col("idx").alias("a_idx"), F.col("emb").alias("a_emb")), ["doc", "a_idx"])
    return P.argument_compatibility(pairs, args).select("doc", "i", "j", "compatible")


NULL_RULE = "SELECT doc, -1 AS i, idx AS j, tag NOT IN ('PRP', 'PRP$') AS matched FROM mentions"


@query(
    "jon23_match_semantic",
    f"""SELECT a.doc, a.idx AS i, b.idx AS j, {COSINE.format('a.emb', 'b.emb')} > 0.1 AND a.number = b.number AS matched FROM mention_vectors a JOIN mention_vectors b
        ON a.doc = b.doc AND a.type = b.type AND a.kind = b.kind AND a.idx < b.idx UNION ALL {NULL_RULE}""",
)
def _(t):
    cand = P.antecedent_candidates(unit_vectors(t), ["doc", "type", "kind"], ["emb", "number", "tag"])
    return cand.select("doc", "i", "j", P.match_semantic(0.1).alias("matched"))


@query(
    "jon24_match_discourse",
    f"""SELECT a.doc, a.idx AS i, b.idx AS j, a.mtype = 'nominal' AND b.mtype = 'pronoun' AS matched FROM mentions a JOIN mentions b
        ON a.doc = b.doc AND a.type = b.type AND a.idx < b.idx UNION ALL {NULL_RULE}""",
)
def _(t):
    cand = P.antecedent_candidates(t.mentions(), ["doc", "type"], ["mtype", "tag"])
    return cand.select("doc", "i", "j", P.match_discourse().alias("matched"))


@query(
    "jon25_match_visual",
    """WITH k AS (SELECT DISTINCT lemma FROM mentions WHERE cluster > 0 AND kind = 'event')
       SELECT a.doc, a.idx AS i, b.idx AS j, a.kind = 'event' AND b.kind = 'event' AND a.number = b.number AND a.lemma IN (SELECT lemma FROM k) AS matched FROM mentions a JOIN mentions b
       ON a.doc = b.doc AND a.type = b.type AND a.idx < b.idx UNION ALL SELECT doc, -1, idx, true FROM mentions""",
)
def _(t):
    m = t.mentions().withColumn("visual", F.col("kind") == "event")
    words = m.filter("cluster > 0 AND visual").select(F.col("lemma").alias("word"))
    cand = P.antecedent_candidates(m, ["doc", "type"], ["visual", "number", "lemma"])
    return P.match_visual(cand, words).select("doc", "i", "j", "matched")


ENTITY_MATCH = STRING_MATCH.format(t="tok", l="lemma", x=0.2, y=0.4)
RIGHT_MATCH = STRING_MATCH.format(t="right_tok", l="right_lemma", x=0.2, y=0.4)
NUMBER_ENTITY = "CASE WHEN a.number <> b.number THEN (a.number = 'plural' AND b.number = 'numeric') OR (a.number = 'numeric' AND b.number = 'plural') ELSE a.number <> 'numeric' OR a.lemma = b.lemma END"
STOP = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in X.stop_words()) + ")"
ENTITY_ROWS = """ent AS (SELECT *, CASE WHEN tag = 'CD' THEN 'numeric' ELSE num0 END AS number, lead(tok) OVER w AS right_tok, lead(lemma) OVER w AS right_lemma, lead(m_start) OVER w AS right_start
    FROM (SELECT * EXCLUDE (number), number AS num0 FROM mentions) WINDOW w AS (PARTITION BY doc ORDER BY idx))"""


def _acronym(x: str) -> str:
    return f"list_aggregate(list_transform(list_filter(string_split({x}.tok, ' '), lambda w: w <> '' AND w NOT IN {STOP}), lambda w: w[1]), 'string_agg', '')"


def _entities(t):
    m = t.mentions().withColumn("number", F.when(F.col("tag") == "CD", "numeric").otherwise(F.col("number")))
    return S.neighbour_mentions(m, ["tok", "lemma", "m_start"]).withColumnRenamed("right_m_start", "right_start")


@query(
    "jon26_match_entity_semantic",
    f"""WITH {ENTITY_ROWS} SELECT a.doc, a.idx AS i, b.idx AS j, CASE WHEN {ENTITY_MATCH} THEN {NUMBER_ENTITY} AND (NOT coalesce(abs(a.right_start - a.m_end) <= 1 AND abs(b.right_start - b.m_end) <= 1, false)
        OR coalesce({RIGHT_MATCH}, false)) ELSE coalesce({_acronym('a')}, '') = translate(b.tok, '.-', '') OR coalesce({_acronym('b')}, '') = translate(a.tok, '.-', '') END AS matched
        FROM ent a JOIN ent b ON a.doc = b.doc AND a.type = b.type AND a.idx < b.idx UNION ALL {NULL_RULE}""",
)
def _(t):
    cols = ["tok", "lemma", "number", "m_end", "right_start", "right_tok", "right_lemma", "tag"]
    cand = P.antecedent_candidates(_entities(t), ["doc", "type"], cols)
    typed = cand.withColumn("a_type", F.col("type")).withColumn("b_type", F.col("type"))
    return typed.select("doc", "i", "j", P.match_entity_semantic().alias("matched"))


@query(
    "jon27_match_entity_discourse",
    f"""WITH {ENTITY_ROWS} SELECT a.doc, a.idx AS i, b.idx AS j, CASE WHEN abs(b.m_start - a.m_end) <= 1 THEN NOT (a.tag = 'PRP$' OR (a.tag = 'JJ' AND a.entity_type <> 'Person')) AND {NUMBER_ENTITY}
        WHEN b.tag = 'CD' THEN {NUMBER_ENTITY} ELSE false END AS matched, a.mtype IN ('proper', 'nominal') AND b.mtype = 'pronoun' AND {NUMBER_ENTITY} AS matched_pronoun
        FROM ent a JOIN ent b ON a.doc = b.doc AND a.type = b.type AND a.idx < b.idx UNION ALL SELECT *, matched FROM ({NULL_RULE})""",
)
def _(t):
    cols = ["lemma", "number", "m_start", "m_end", "tag", "mtype", "entity_type"]
    cand = P.antecedent_candidates(_entities(t), ["doc", "type"], cols)
    typed = cand.withColumn("a_type", F.col("type")).withColumn("b_type", F.col("type"))
    return typed.select(
        "doc", "i", "j", P.match_entity_discourse().alias("matched"), P.match_entity_pronoun().alias("matched_pronoun")
    )


SAME_LEMMA = "mentions a JOIN mentions b ON a.doc = b.doc AND a.lemma = b.lemma AND a.idx < b.idx"


@query(
    "jon28_plurality_compatible",
    f"""SELECT a.doc, a.idx AS i, b.idx AS j, CASE WHEN a.cls = 'NOUN' AND b.cls = 'NOUN' THEN (a.tag LIKE '%S') = (b.tag LIKE '%S') WHEN a.cls = 'NOUN' AND b.cls = 'VERB' THEN NOT a.tag LIKE '%S'
        WHEN b.cls = 'NOUN' AND a.cls = 'VERB' THEN NOT b.tag LIKE '%S' ELSE true END AS ok FROM {SAME_LEMMA}""",
)
def _(t):
    pairs = P.mention_pairs(t.mentions(), ["doc", "lemma"], ["cls", "tag"])
    return pairs.select("doc", "i", "j", X.plurality_compatible(F.col("a_cls"), F.col("a_tag"), F.col("b_cls"), F.col("b_tag")).alias("ok"))


@query(
    "jon29_pos_compatible",
    f"""SELECT a.doc, a.idx AS i, b.idx AS j, substr(a.tag, 1, 2) = substr(b.tag, 1, 2) OR (substr(a.tag, 1, 2) IN ('NN', 'VB', 'PR') AND substr(b.tag, 1, 2) IN ('NN', 'VB', 'PR')) AS ok FROM {SAME_LEMMA}""",
)
def _(t):
    pairs = P.mention_pairs(t.mentions(), ["doc", "lemma"], ["tag"])
    return pairs.select("doc", "i", "j", X.pos_compatible(F.array("a_tag"), F.array("b_tag")).alias("ok"))


@query(
    "jon30_candidate_np_pairs",
    """SELECT b.doc, a.idx AS i, b.idx AS j, (a.cluster = b.cluster AND a.cluster <> 0)::BIGINT AS y FROM mentions b JOIN mentions a ON a.doc = b.doc AND a.idx BETWEEN b.idx - 3 AND b.idx - 1 WHERE b.mtype = 'pronoun'""",
)
def _(t):
    m = t.mentions()
    last = F.greatest(F.col("idx") - 3, F.lit(0))
    listed = m.filter("mtype = 'pronoun' AND idx > 0").select("doc", "idx", F.sequence(last, F.col("idx") - 1).alias("candidates"))
    return P.candidate_pairs(listed, m)


@query(
    "jon31_description_video_map",
    """SELECT list_last(string_split(url, 'page=')) AS video, translate(url, ',.''":;?!<>~%$|/@#^*', '') AS description, count(*) OVER (PARTITION BY list_last(string_split(url, 'page='))) AS same_video FROM pages""",
)
def _(t):
    ids = t.read("pages").select(F.element_at(F.split("url", "page="), -1).alias("video"), X.clean_description_id(F.col("url")).alias("description"))
    back = ids.groupBy("video").agg(F.count("*").alias("same_video"))
    return ids.join(back, "video")


@query(
    "jon32_label_candidate_spans",
    """WITH g AS (SELECT doc, m_start, m_end, max(cluster) AS cluster FROM mentions GROUP BY ALL) SELECT a.doc, a.tid AS m_start, b.tid AS m_end, coalesce(g.cluster, 0) AS cluster
       FROM tokens a JOIN tokens b ON a.doc = b.doc AND a.sent = b.sent AND b.tid BETWEEN a.tid AND a.tid + 1 LEFT JOIN g ON g.doc = a.doc AND g.m_start = a.tid AND g.m_end = b.tid""",
)
def _(t):
    spans = S.enumerate_candidate_spans(t.tokens(), 2).drop("sent")
    return P.label_candidate_spans(spans, t.mentions())


@query(
    "jon33_assemble_mentions",
    """SELECT m.doc, m.idx, m.lemma, m.number, m.mtype, round(list_sum(v.emb), 6) AS total, coalesce(a.n, 0) AS n_arguments, coalesce(a.types, '') AS argument_types,
       m.doc IN (SELECT doc FROM log) AND m.type < 2 AS is_visual FROM mentions m JOIN vectors v ON m.doc = v.doc AND m.idx = v.idx
       LEFT JOIN (SELECT doc, e_idx, count(*) AS n, string_agg(entity_type, ',' ORDER BY a_start) AS types FROM arguments GROUP BY ALL) a ON a.doc = m.doc AND a.e_idx = m.idx WHERE m.kind = 'event'""",
)
def _(t):
    listed = t.arguments().groupBy("doc", F.col("e_idx").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("a_start", "entity_type"))).alias("_a"))
    seen = t.log().select("doc").distinct().withColumn("_seen", F.lit(True))
    events = t.mention_vectors().filter("kind = 'event'").withColumn("total", six_digits(V.vsum(F.col("emb")))).drop("emb")
    events = events.join(listed, ["doc", "idx"], "left").join(seen, "doc", "left")
    types = F.array_join(F.transform("_a", lambda a: a["entity_type"]), ",")
    return events.select(
        "doc", "idx", "lemma", "number", "mtype", "total",
        F.coalesce(F.size("_a"), F.lit(0)).alias("n_arguments"), F.coalesce(types, F.lit("")).alias("argument_types"),
        (F.col("_seen").isNotNull() & (F.col("type") < 2)).alias("is_visual"),
    )


def unit_vectors(t):
    return t.mention_vectors().withColumn("emb", V.unit(F.col("emb")))


VECTOR_PAIRS = "mention_vectors a JOIN mention_vectors b ON a.doc = b.doc AND a.lemma = b.lemma AND a.idx < b.idx"


def _lemma_pairs(t, *carry):
    return P.mention_pairs(t.mention_vectors(), ["doc", "lemma"], list(carry))


@query("fun01_abs_cosine", f"SELECT a.doc, a.idx AS i, b.idx AS j, round({COSINE.format('a.emb', 'b.emb')}, 6) AS c FROM {VECTOR_PAIRS}")
def _(t):
    return _lemma_pairs(t, "emb").select("doc", "i", "j", six_digits(V.abs_cosine(F.col("a_emb"), F.col("b_emb"))).alias("c"))


@query(
    "fun02_edit_ratio",
    f"SELECT a.doc, a.idx AS i, b.idx AS j, round(levenshtein(a.tok, b.tok)::DOUBLE / greatest(length(a.tok), length(b.tok)), 6) AS d FROM {SAME_LEMMA}",
)
def _(t):
    return _lemma_pairs(t, "tok").select("doc", "i", "j", six_digits(X.edit_ratio(F.col("a_tok"), F.col("b_tok"))).alias("d"))


@query(
    "fun03_string_match",
    f"""SELECT a.doc, a.idx AS i, b.idx AS j, {STRING_MATCH.format(t='tok', l='mtype', x=0.5, y=0.5)} AS m, {STRING_MATCH.format(t='tok', l='mtype', x=0.2, y=0.4)} AS m_entity FROM {SAME_LEMMA}""",
)
def _(t):
    cols = [F.col(c) for c in ("a_tok", "b_tok", "a_mtype", "b_mtype")]
    return _lemma_pairs(t, "tok", "mtype").select(
        "doc", "i", "j", X.string_match(*cols).alias("m"), X.string_match(*cols, text_limit=0.2, lemma_limit=0.4).alias("m_entity")
    )


@query(
    "fun04_is_acronym",
    f"""SELECT item_id, coalesce({_acronym('a')}, '') AS short, coalesce({_acronym('a')}, '') = translate(b, '.-', '') AS hit FROM (
        SELECT item_id, lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')) AS tok, substr(lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')), 1, 1) || '.' AS b FROM benchmark) a""",
)
def _(t):
    clean = F.lower(F.regexp_replace("text", "[^A-Za-z ]", ""))
    rows = t.read("benchmark").select("item_id", clean.alias("tok"), F.concat(F.substring(clean, 1, 1), F.lit(".")).alias("b"))
    return rows.select("item_id", X.acronym_of(F.col("tok")).alias("short"), X.is_acronym(F.col("tok"), F.col("b")).alias("hit"))


@query("fun05_number_match", f"WITH {ENTITY_ROWS} SELECT a.doc, a.idx AS i, b.idx AS j, a.number = b.number AS m, {NUMBER_ENTITY} AS m_entity FROM ent a JOIN ent b ON a.doc = b.doc AND a.lemma = b.lemma AND a.idx < b.idx")
def _(t):
    pairs = P.mention_pairs(_entities(t), ["doc", "lemma"], ["number"])
    a, b = F.col("a_number"), F.col("b_number")
    return pairs.select("doc", "i", "j", X.number_match(a, b).alias("m"), X.number_match_entity(a, b, F.col("lemma"), F.col("lemma")).alias("m_entity"))


@query("fun06_is_consecutive", "SELECT a.doc, a.idx AS i, abs(b.m_start - a.m_end) <= 1 AS beside FROM mentions a JOIN mentions b ON a.doc = b.doc AND b.idx = a.idx + 1")
def _(t):
    n = S.neighbour_mentions(t.mentions(), ["m_start"]).filter("right_m_start IS NOT NULL")
    return n.select("doc", F.col("idx").alias("i"), X.is_consecutive(F.col("m_end"), F.col("right_m_start")).alias("beside"))


SOFT = "list_transform(emb, lambda x: exp(x - list_max(emb)) / list_sum(list_transform(emb, lambda y: exp(y - list_max(emb)))))"


@query(
    "fun07_symmetric_kl",
    f"""WITH s AS (SELECT doc, idx, {SOFT} AS p FROM vectors), q AS (SELECT a.doc, a.idx, a.p, b.p AS q FROM s a JOIN s b ON a.doc = b.doc AND b.idx = a.idx + 1)
        SELECT doc, idx, round(list_sum(list_transform(list_zip(p, q), lambda z: z[1] * (ln(z[1]) - ln(z[2])))), 6) AS kl,
        round(list_sum(list_transform(list_zip(p, q), lambda z: (z[1] - z[2]) * (ln(z[1]) - ln(z[2])))), 6) AS sym FROM q""",
)
def _(t):
    rows = t.vectors().select("doc", "idx", V.softmax(F.col("emb")).alias("p"))
    nxt = rows.select("doc", (F.col("idx") - 1).alias("idx"), F.col("p").alias("q"))
    return rows.join(nxt, ["doc", "idx"]).select(
        "doc", "idx", six_digits(V.kl(F.col("p"), F.col("q"))).alias("kl"), six_digits(V.symmetric_kl(F.col("p"), F.col("q"))).alias("sym")
    )


@query(
    "fun08_softmax",
    f"""SELECT vec_id, round({SOFT}[1], 6) AS first, round(list_max({SOFT}), 6) AS top, round(list_max(emb) + ln(list_sum(list_transform(emb, lambda y: exp(y - list_max(emb))))), 6) AS lse FROM vecs""",
)
def _(t):
    soft = V.softmax(F.col("emb"))
    return t.embeddings().select(
        "vec_id", six_digits(F.element_at(soft, 1)).alias("first"), six_digits(F.array_max(soft)).alias("top"), six_digits(V.logsumexp(F.col("emb"))).alias("lse")
    )


@query("fun09_gaussian_posterior", "SELECT doc, fidx, k::BIGINT AS k, round(p, 6) AS p FROM posteriors")
def _(t):
    return t.posteriors().select("doc", "fidx", "k", six_digits("p").alias("p"))


@query("fun10_log_mean_posterior", "SELECT doc, k::BIGINT AS k, round(ln(avg(p)), 6) AS log_p FROM posteriors GROUP BY doc, k")
def _(t):
    return M.log_mean_posterior(t.posteriors()).withColumn("log_p", six_digits("log_p"))


DOT_MAP = "dots AS (SELECT m.doc, m.idx, f.fidx, list_dot_product(m.emb, f.emb) AS s FROM mention_vectors m JOIN frames f ON m.doc = f.doc)"


@query(
    "fun11_matchmap_similarity",
    f"""WITH {DOT_MAP} SELECT a.doc, round(a.s, 6) AS mean, round(b.s, 6) AS mean_max, round(c.s, 6) AS max_mean FROM (SELECT doc, avg(s) AS s FROM dots GROUP BY doc) a
        JOIN (SELECT doc, avg(s) AS s FROM (SELECT doc, idx, max(s) AS s FROM dots GROUP BY ALL) GROUP BY doc) b ON a.doc = b.doc
        JOIN (SELECT doc, avg(s) AS s FROM (SELECT doc, fidx, max(s) AS s FROM dots GROUP BY ALL) GROUP BY doc) c ON a.doc = c.doc""",
)
def _(t):
    tokens, regions = t.vectors(), t.frames().select("doc", "fidx", "emb")
    out = None
    for how in ("mean", "mean_max", "max_mean"):
        one = M.matchmap_similarity(tokens, regions, how).select("doc", six_digits("score").alias(how))
        out = one if out is None else out.join(one, "doc")
    return out


SPAN_TOKENS = "span_v AS (SELECT m.doc, m.idx, v.tid, v.emb FROM mentions m JOIN token_v v ON m.doc = v.doc AND v.tid BETWEEN m.m_start AND m.m_end)"
SIMILAR = f"""sim AS (SELECT doc, i, j, avg(best) AS sim FROM (SELECT a.doc, a.idx AS i, b.idx AS j, b.tid, max({COSINE.format('a.emb', 'b.emb')}) AS best FROM span_v a JOIN span_v b ON a.doc = b.doc
    AND b.idx BETWEEN a.idx + 1 AND a.idx + 4 GROUP BY ALL) GROUP BY ALL)"""


def span_token_vectors(t):
    covered = S.covered_tokens(t.mentions(), "idx")
    return covered.join(_token_vectors(t).select("doc", "tid", "emb").hint("merge"), ["doc", "tid"])  # mentions are many, their files small


@query(
    "fun12_max_abs_cosine_mean",
    f"WITH {TOKEN_V}, {SPAN_TOKENS}, {SIMILAR} SELECT doc, i, j, round(sim, 6) AS sim FROM sim UNION ALL SELECT doc, -1, idx, 1.0::DOUBLE FROM mentions",
)
def _(t):
    m = t.mentions().select("doc", "idx")
    near = m.select("doc", F.col("idx").alias("i"), F.explode(F.sequence(F.col("idx") + 1, F.col("idx") + 4)).alias("j"))
    pairs = near.join(m.withColumnRenamed("idx", "j").hint("merge"), ["doc", "j"], "left_semi").select("doc", "i", "j")
    null = m.select("doc", F.lit(-1).cast("long").alias("i"), F.col("idx").alias("j"))
    return M.max_abs_cosine_mean(pairs.unionByName(null), span_token_vectors(t)).withColumn("sim", six_digits("sim"))


@query(
    "fun13_pair_features",
    f"SELECT a.doc, a.idx AS i, b.idx AS j, (a.lemma = b.lemma)::INT::DOUBLE AS same_lemma, round({COSINE.format('a.emb', 'b.emb')}, 6) AS cosine FROM mention_vectors a JOIN mention_vectors b ON a.doc = b.doc AND a.sent = b.sent AND a.idx < b.idx",
)
def _(t):
    pairs = P.mention_pairs(unit_vectors(t), ["doc", "sent"], ["lemma", "emb"])
    f = V.pair_features(F.col("a_lemma"), F.col("b_lemma"), F.col("a_emb"), F.col("b_emb"))
    return pairs.select("doc", "i", "j", f.alias("f")).select("doc", "i", "j", F.col("f")[0].alias("same_lemma"), six_digits(F.col("f")[1]).alias("cosine"))


@query(
    "fun14_pair_vector",
    f"SELECT doc, i, j, {SHAPE} FROM (SELECT a.doc, a.idx AS i, b.idx AS j, a.emb || b.emb || list_transform(list_zip(a.emb, b.emb), lambda z: z[1] * z[2]) AS emb FROM {VECTOR_PAIRS})",
)
def _(t):
    pairs = _lemma_pairs(t, "emb").select("doc", "i", "j", V.pair_vector(F.col("a_emb"), F.col("b_emb")).alias("emb"))
    return pairs.select("doc", "i", "j", *shape())


@query(
    "fun15_attention_pair_features",
    f"""WITH {DOT_MAP}, att AS (SELECT doc, idx, fidx, exp(s - peak) / sum(exp(s - peak)) OVER (PARTITION BY doc, idx) AS p FROM (SELECT *, max(s) OVER (PARTITION BY doc, idx) AS peak FROM dots))
        SELECT a.doc, a.idx AS i, b.idx AS j, round(max(x.p), 6) AS first, round(max(y.p), 6) AS second, round(max(x.p) * max(y.p), 6) AS product, round(max(x.p * y.p), 6) AS joint
        FROM mentions a JOIN mentions b ON a.doc = b.doc AND b.idx = a.idx + 1 JOIN att x ON x.doc = a.doc AND x.idx = a.idx JOIN att y ON y.doc = b.doc AND y.idx = b.idx AND y.fidx = x.fidx GROUP BY ALL""",
)
def _(t):
    m = t.mentions().select("doc", "idx")
    pairs = m.join(m.select("doc", (F.col("idx") - 1).alias("idx")), ["doc", "idx"]).select("doc", F.col("idx").alias("i"), (F.col("idx") + 1).alias("j"))
    f = M.attention_pair_features(pairs, t.vectors(), t.frames())
    return f.select("doc", "i", "j", *[six_digits(c).alias(c) for c in ("first", "second", "product", "joint")])


@query(
    "fun16_fuse_scores",
    f"""SELECT a.doc, a.idx AS i, b.idx AS j, round(0.5 * {COSINE.format('a.emb', 'b.emb')} + 0.3 * (a.type = b.type)::INT + 0.2 * abs(a.idx - b.idx) / 100.0::DOUBLE, 6) AS fused,
        round(0.5 * {COSINE.format('a.emb', 'b.emb')} + 0.2 * abs(a.idx - b.idx) / 100.0::DOUBLE, 6) AS two_terms FROM {VECTOR_PAIRS}""",
)
def _(t):
    trigger = V.abs_cosine(F.col("a_emb"), F.col("b_emb"))
    visual = (F.col("a_type") == F.col("b_type")).cast("double")
    argument = F.abs(F.col("i") - F.col("j")) / 100.0
    return _lemma_pairs(t, "emb", "type").select(
        "doc", "i", "j", six_digits(M.fuse_scores(trigger, visual, argument, (0.5, 0.3, 0.2))).alias("fused"),
        six_digits(M.fuse_scores(trigger, None, argument, (0.5, 0.2))).alias("two_terms"),
    )


QUERY_V = mean_sql("doc", "SELECT doc, emb FROM vectors")


@query(
    "fun18_enumerate_segments",
    f"""WITH q AS ({QUERY_V}), s AS (SELECT f.doc, f.fidx, list_dot_product(f.emb, q.emb) AS s FROM frames f JOIN q ON f.doc = q.doc),
        w AS (SELECT a.doc, a.fidx AS start, b.fidx AS "end", avg(c.s) AS score FROM s a JOIN s b ON a.doc = b.doc AND b.fidx BETWEEN a.fidx AND a.fidx + 19
          JOIN s c ON c.doc = a.doc AND c.fidx BETWEEN a.fidx AND b.fidx GROUP BY ALL)
        SELECT doc, start, "end", round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY round(score, 9) DESC, start, "end") AS r FROM w WHERE score > 0) WHERE r = 1""",
)
def _(t):
    queries = M.vector_mean(t.vectors(), ["doc"], out="q_emb").withColumn("q", F.lit(0))
    return M.best_segments(t.frames().select("doc", "fidx", "emb"), queries).select("doc", "start", "end", six_digits("score").alias("score"))


@query(
    "fun19_log_rising_factorial",
    "SELECT o_custkey, count(*) AS n, round(lgamma(count(*) + 0.7) - lgamma(0.7), 6) AS v FROM orders GROUP BY o_custkey",
)
def _(t):
    counts = t.read("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return counts.select("o_custkey", "n", six_digits(V.log_rising_factorial(F.lit(0.7), F.col("n"))).alias("v"))


SEG_MEMBERS = """members AS (SELECT s.doc, s.seg, s.label, f.fidx, f.emb, row_number() OVER (PARTITION BY s.doc, s.seg ORDER BY f.fidx) - 1 AS pos, count(*) OVER (PARTITION BY s.doc, s.seg) AS n
    FROM (SELECT *, floor(t0 / duration * 100) AS f0, floor(t1 / duration * 100) AS f1 FROM segments) s JOIN frames f ON f.doc = s.doc AND f.frame BETWEEN s.f0 AND s.f1)"""


def _found(t, *columns):
    frames = t.frames().select("doc", "fidx", "t", "frame", *columns)
    return M.frames_in_segment(M.annotation_frames(t.segments()).select("doc", "seg", "f0", "f1", "label"), frames, "label")


def _members(t, *columns):
    found = _found(t, *columns)
    return order.number_rows(found, ["doc", "seg"], ["fidx"], order.blocks_of(F.col("fidx"), 65536), "pos")


@query("agg13_pool_segments_mean", f"WITH {SEG_MEMBERS}, mm AS ({mean_sql('doc, seg', 'SELECT doc, seg, emb FROM members')}) SELECT doc, seg, {SHAPE} FROM mm")
def _(t):
    return M.pool_segments(_found(t), "mean", frames=t.frames()).select("doc", "seg", *shape())


@query(
    "agg13_pool_segments_resample",
    f"""WITH {SEG_MEMBERS}, fill AS (SELECT doc, seg, pos, n, emb FROM members UNION ALL SELECT doc, seg, unnest(range(n, 4)) AS pos, n, emb FROM members WHERE pos = n - 1 AND n < 4),
        c AS (SELECT doc, seg, pos // (greatest(n, 4) // 4) AS chunk, emb FROM fill WHERE pos < (greatest(n, 4) // 4) * 4), mm AS ({mean_sql('doc, seg, chunk', 'SELECT * FROM c')}) SELECT doc, seg, chunk, {SHAPE} FROM mm""",
)
def _(t):
    return M.pool_segments(_members(t), "resample", 4, t.frames()).select("doc", "seg", "chunk", *shape())


@query("agg13_pool_segments_concat", f"WITH {SEG_MEMBERS} SELECT doc, seg, fidx, row_number() OVER (PARTITION BY doc ORDER BY seg, pos) - 1 AS row FROM members")
def _(t):
    return M.pool_segments(_members(t), "concat").select("doc", "seg", "fidx", "row")


@query(
    "agg14_merge_segments_by_label",
    f"WITH {SEG_MEMBERS} SELECT doc, label, seg, fidx, row FROM (SELECT *, row_number() OVER (PARTITION BY doc, label ORDER BY seg, fidx) - 1 AS row FROM members) WHERE row < 30",
)
def _(t):
    return M.merge_segments_by_label(_members(t), 30).select("doc", "label", "seg", "fidx", "row")


@query("agg14_merge_segments_whole", f"WITH {SEG_MEMBERS} SELECT doc, label, seg, fidx, row_number() OVER (PARTITION BY doc, label ORDER BY seg, fidx) - 1 AS row FROM members")
def _(t):
    return M.merge_segments_by_label(_members(t)).select("doc", "label", "seg", "fidx", "row")


@query(
    "agg15_mean_pool",
    f"""WITH {SEG_MEMBERS}, mm AS ({mean_sql('doc, seg', "SELECT doc, seg, emb FROM members WHERE label <> 'error'")}) SELECT doc, seg, {SHAPE} FROM mm""",
)
def _(t):
    return M.frame_means(_found(t).filter("label <> 'error'"), t.frames(), ["doc", "seg"]).select("doc", "seg", *shape())


@query(
    "agg16_align_mean_actions",
    f"""WITH hit AS (SELECT m.doc, m.idx, f.emb FROM mention_vectors m JOIN frames f ON m.doc = f.doc WHERE list_dot_product(m.emb, f.emb) > 0), mm AS ({mean_sql('doc, idx', 'SELECT * FROM hit')})
        SELECT doc, idx, {SHAPE} FROM (SELECT m.doc, m.idx, coalesce(mm.emb, list_transform(range(64), lambda i: 0::DOUBLE)) AS emb FROM mentions m LEFT JOIN mm ON m.doc = mm.doc AND m.idx = mm.idx)""",
)
def _(t):
    return M.align_mean_actions(t.vectors(), t.frames().select("doc", "fidx", "emb"), DIM).select("doc", "idx", *shape())
