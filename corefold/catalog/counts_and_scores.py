"""Queries on vocabularies, rankings, set operations and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corefold.catalog.pairs_and_media import QUERY_V, _entities
from corefold.catalog.registry import query
from corefold.catalog.tables import six_digits
from corefold.operators import counts as C
from corefold.operators import media as M
from corefold.operators import ranking as R
from corefold.plans import clusters as K
from corefold.plans import scoring as S


def _words(t, kind: str | None = None):
    m = t.mentions()
    m = m if kind is None else m.filter(F.col("kind") == kind)
    return m.select(F.col("lemma").alias("word"), "doc", "idx")


VOCAB = """SELECT lemma AS word, count(*) AS n, row_number() OVER (ORDER BY min(struct_pack(d := doc, i := idx))) AS id FROM {0} GROUP BY lemma"""


@query("agg01_build_vocab", f"SELECT '###NULL###' AS word, 0 AS n, 0 AS id UNION ALL ({VOCAB.format('mentions')})")
def _(t):
    return C.build_vocab(_words(t))


ROLE_VOCAB = "SELECT e_type || '.' || role AS name, row_number() OVER (ORDER BY e_type, role) AS id FROM (SELECT DISTINCT e_type, role FROM arguments)"


@query("agg02_build_role_vocab", f"SELECT '###NULL###' AS name, 0 AS id UNION ALL {ROLE_VOCAB}")
def _(t):
    return C.build_role_vocab(t.arguments())


@query(
    "agg03_build_ontology",
    f"""SELECT k AS kind, 0 AS id, '###NULL###' AS name FROM (VALUES ('entity'), ('event'), ('argument')) v(k)
        UNION ALL SELECT 'entity', id, word FROM ({VOCAB.format("(SELECT * FROM mentions WHERE kind = 'entity')")})
        UNION ALL SELECT 'event', id, word FROM ({VOCAB.format("(SELECT * FROM mentions WHERE kind = 'event')")})
        UNION ALL SELECT 'argument', id, name FROM ({ROLE_VOCAB})""",
)
def _(t):
    return C.build_ontology(_words(t, "entity"), _words(t, "event"), t.arguments())


@query(
    "agg04_build_feature_vocab",
    """WITH f AS (UNPIVOT (SELECT doc, idx, tag, mtype, type::VARCHAR AS type FROM mentions) ON tag, mtype, type INTO NAME feature VALUE value),
       s AS (SELECT feature, value, min(struct_pack(d := doc, i := idx)) AS o FROM f GROUP BY ALL)
       SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY o) AS id FROM s WHERE feature <> 'type' UNION ALL SELECT feature, value, value::BIGINT FROM s WHERE feature = 'type'""",
)
def _(t):
    return C.build_feature_vocab(t.mentions(), ["tag", "mtype", "type"])


@query(
    "agg05_type_frequency",
    "SELECT kind, type, count(*) AS n, (SELECT max(type) + 1 FROM mentions) AS width FROM mentions GROUP BY kind, type",
)
def _(t):
    m = t.mentions().withColumn("key", F.struct("kind", "type"))
    width = t.mentions().agg(F.max("type").alias("w")).first()["w"] + 1
    return C.type_frequency(m, "key").select("key.kind", "key.type", "n", F.lit(width).alias("width"))


CLUSTER_IDS = """WITH k AS (SELECT doc, idx, min(idx) OVER (PARTITION BY doc, CASE WHEN cluster > 0 THEN cluster ELSE -1 - idx END) AS first, cluster FROM mentions)"""


@query("agg06_assign_cluster_ids", f"{CLUSTER_IDS} SELECT doc, idx, dense_rank() OVER (ORDER BY doc, first) AS cluster_id FROM k")
def _(t):
    return C.assign_cluster_ids(t.mentions()).select("doc", "idx", "cluster_id")


@query(
    "agg06_assign_cluster_ids_clusters_only",
    f"{CLUSTER_IDS} SELECT doc, idx, dense_rank() OVER (ORDER BY doc, first) AS cluster_id FROM k WHERE cluster > 0 UNION ALL SELECT doc, idx, 0 FROM k WHERE cluster = 0",
)
def _(t):
    return C.assign_cluster_ids(t.mentions(), singles_get_ids=False).select("doc", "idx", "cluster_id")


@query(
    "agg07_cluster_stats",
    """SELECT kind, count(*) AS n_mentions, count(DISTINCT CASE WHEN cluster > 0 THEN struct_pack(d := doc, c := cluster) END) AS n_clusters, count(DISTINCT doc) AS n_docs
       FROM mentions GROUP BY kind""",
)
def _(t):
    return C.cluster_stats(t.mentions())


@query("agg08_clusters_min_size", "SELECT doc, cluster, count(*) AS size FROM mentions WHERE cluster > 0 GROUP BY ALL HAVING count(*) >= 3")
def _(t):
    return C.clusters_min_size(t.mentions(), 3)


DATASETS = "ds AS (SELECT CASE WHEN doc % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, lemma AS trigger, type_name AS type FROM mentions)"


def _datasets(t):
    return t.mentions().select(
        F.when(F.col("doc") % 2 == 0, "even").otherwise("odd").alias("dataset"), F.col("lemma").alias("trigger"), F.col("type_name").alias("type")
    )


@query("agg09_trigger_types_by_dataset", f"WITH {DATASETS} SELECT trigger, dataset, string_agg(type, ',' ORDER BY type) AS types FROM (SELECT DISTINCT * FROM ds) GROUP BY ALL")
def _(t):
    return C.trigger_types_by_dataset(_datasets(t)).withColumn("types", F.array_join("types", ","))


CONFUSION = f"""{DATASETS}, cf AS (SELECT a.type AS type1, b.type AS type2, count(*) AS n FROM (SELECT DISTINCT trigger, type FROM ds WHERE dataset = 'even') a
    JOIN (SELECT DISTINCT trigger, type FROM ds WHERE dataset = 'odd') b ON a.trigger = b.trigger GROUP BY ALL)"""


@query("agg10_type_confusion", f"WITH {CONFUSION} SELECT type1, type2, n, round(n / sum(n) OVER (PARTITION BY type1), 6) AS share FROM cf")
def _(t):
    return C.type_confusion(_datasets(t), "even", "odd").withColumn("share", six_digits("share"))


def _greedy(cells: str) -> str:
    """The pass itself, a row per step: each takes the best column not yet used."""
    return f"""rw AS (SELECT type1, row_number() OVER (ORDER BY max(share) DESC, type1) - 1 AS place FROM {cells} GROUP BY type1), cl AS (SELECT DISTINCT type2 FROM {cells}),
        pass(k, used) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL
          SELECT k + 1, list_append(used, b.c) FROM (SELECT g.k, g.used, max({{'n': coalesce(x.n, 0), 'c': cl.type2}}) AS b FROM pass g JOIN rw ON rw.place = g.k CROSS JOIN cl
            LEFT JOIN {cells} x ON x.type1 = rw.type1 AND x.type2 = cl.type2 WHERE NOT list_contains(g.used, cl.type2) GROUP BY g.k, g.used)),
        whole AS (SELECT used FROM pass ORDER BY k DESC LIMIT 1), taken AS (SELECT unnest(used) AS name, unnest(range(len(used))) AS place FROM whole)
        SELECT 'row' AS axis, type1 AS name, place FROM rw UNION ALL SELECT 'column', name, place FROM taken
        UNION ALL SELECT 'column', type2, (SELECT count(*) FROM rw) + row_number() OVER (ORDER BY type2) - 1 FROM cl WHERE type2 NOT IN (SELECT name FROM taken)"""


@query("agg11_confusion_order", f"WITH RECURSIVE {CONFUSION}, cs AS (SELECT *, n / sum(n) OVER (PARTITION BY type1) AS share FROM cf), {_greedy('cs')}")
def _(t):
    return C.confusion_order(C.type_confusion(_datasets(t), "even", "odd"))


@query(
    "agg12_alignment_confusion",
    "SELECT CASE WHEN cluster = 0 THEN '###NULL###' ELSE type_name END AS predicted, mtype AS label, count(*) AS n FROM mentions GROUP BY ALL",
)
def _(t):
    aligned = t.mentions().select(F.when(F.col("cluster") > 0, F.col("type_name")).alias("predicted"), F.col("mtype").alias("label"))
    return C.alignment_confusion(aligned)


@query(
    "agg17_roles_per_event_type",
    """SELECT e_type, role, row_number() OVER (PARTITION BY e_type ORDER BY o, role) - 1 AS place FROM (
       SELECT e_type, role, min(struct_pack(d := doc, e := e_idx, a := a_start)) AS o FROM arguments GROUP BY ALL)""",
)
def _(t):
    return C.roles_per_event_type(t.arguments())


SEEDS = "sr AS (SELECT l_linenumber % 4 AS seed, l_returnflag AS metric, avg(l_discount * l_quantity) AS value FROM lineitem GROUP BY ALL)"


@query("agg18_seed_summary", f"WITH {SEEDS} SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM sr GROUP BY metric")
def _(t):
    results = t.read("lineitem").groupBy((F.col("l_linenumber") % 4).alias("seed"), F.col("l_returnflag").alias("metric")).agg(
        F.avg(F.col("l_discount") * F.col("l_quantity")).alias("value")
    )
    return C.seed_summary(results, ["metric"]).select("metric", six_digits("mean").alias("mean"), six_digits("deviation").alias("deviation"))


@query(
    "agg19_first_event_per_sentence",
    """SELECT doc, sent, min(idx) AS idx, arg_min(type_name, idx) AS type_name, arg_min(tok, idx) AS tok FROM mentions WHERE kind = 'event' AND type_name <> 'Contact.Meet' GROUP BY doc, sent""",
)
def _(t):
    known = t.spark.createDataFrame([("Conflict.Attack",), ("Movement.Transport",)], "type_name string")
    return C.first_event_per_sentence(t.mentions().filter("kind = 'event'"), known)


@query(
    "agg20_top_classes",
    "SELECT doc, idx, lemma FROM mentions WHERE lemma IN (SELECT lemma FROM mentions GROUP BY lemma ORDER BY count(*) DESC, lemma LIMIT 8)",
)
def _(t):
    return C.top_classes(t.mentions(), "lemma", 8).select("doc", "idx", "lemma")


@query(
    "agg21_score_by_cluster_count",
    "SELECT l_suppkey % 5 AS n_clusters, l_returnflag AS metric, round(avg(l_discount * l_quantity), 6) AS value FROM lineitem GROUP BY ALL",
)
def _(t):
    results = t.read("lineitem").select(
        (F.col("l_suppkey") % 5).alias("n_clusters"), F.col("l_returnflag").alias("metric"), (F.col("l_discount") * F.col("l_quantity")).alias("value")
    )
    return C.score_by_cluster_count(results).withColumn("value", six_digits("value"))


SCORED = "cand AS (SELECT a.doc, a.idx AS i, b.idx AS j, (length(a.tok) * 7 + length(b.tok) * 3 + a.type) % 11 / 10.0::DOUBLE AS score FROM mentions a JOIN mentions b ON a.doc = b.doc AND a.lemma = b.lemma AND a.idx < b.idx UNION ALL SELECT doc, -1, idx, 0.35::DOUBLE FROM mentions)"


def scored_candidates(t):
    from corefold.operators.pairs import antecedent_candidates

    cand = antecedent_candidates(t.mentions(), ["doc", "lemma"], ["tok", "type"])
    score = (F.length("a_tok") * 7 + F.length("b_tok") * 3 + F.col("a_type")) % 11 / 10.0
    return cand.select("doc", "i", "j", F.when(F.col("i") < 0, 0.35).otherwise(score).alias("score"))


@query("win01_rank_antecedents", f"WITH {SCORED} SELECT doc, j AS idx, i AS antecedent, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc, j ORDER BY score DESC, i) AS r FROM cand) WHERE r = 1")
def _(t):
    return R.rank_antecedents(scored_candidates(t)).withColumn("score", six_digits("score"))


RETRIEVAL = f"""tv AS ({QUERY_V}), fv AS ({QUERY_V.replace('FROM (SELECT doc, emb FROM vectors)', 'FROM (SELECT doc, emb FROM frames)')}),
    sc AS (SELECT a.doc AS q, b.doc AS g, list_dot_product(a.emb, b.emb) AS score FROM tv a CROSS JOIN fv b)"""


def _sides(t):
    text = M.vector_mean(t.vectors(), ["doc"])
    video = M.vector_mean(t.frames(), ["doc"])
    return text, video


def _top(rows, key, order):
    return f"SELECT q, g, round(score, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, {order}) AS r FROM {rows}) WHERE r <= 10"


@query("win02_topk_retrieval", f"WITH {RETRIEVAL} {_top('sc', 'q', 'g')}")
def _(t):
    text, video = _sides(t)
    top = R.retrieve_topk(text.select(F.col("doc").alias("q"), "emb"), video.select(F.col("doc").alias("g"), "emb"), 10, block=64)
    return top.withColumn("score", six_digits("score"))


@query("win02_topk_retrieval_reverse", f"WITH {RETRIEVAL} {_top('(SELECT g AS q, q AS g, score FROM sc)', 'q', 'g')}")
def _(t):
    text, video = _sides(t)
    top = R.retrieve_topk(video.select(F.col("doc").alias("q"), "emb"), text.select(F.col("doc").alias("g"), "emb"), 10)
    return top.withColumn("score", six_digits("score"))


@query("win03_top_pairs_per_doc", f"WITH {SCORED} SELECT doc, i, j, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, j, i) AS rank FROM cand WHERE i >= 0) WHERE rank <= 100")
def _(t):
    pairs = scored_candidates(t).filter("i >= 0")
    return R.top_per_key(pairs, ["doc"], [F.desc("score"), "j", "i"], 100).select("doc", "i", "j", "rank")


@query(
    "win04_top_translations",
    f"""WITH {SCORED}, tr AS (SELECT a.lemma AS src, b.tok AS tgt, sum(c.score) AS count FROM cand c JOIN mentions a ON a.doc = c.doc AND a.idx = c.i JOIN mentions b ON b.doc = c.doc AND b.idx = c.j GROUP BY ALL),
        h AS (SELECT src FROM tr GROUP BY src ORDER BY round(sum(count), 6) DESC, src LIMIT 200), p AS (SELECT tr.*, count / nullif(sum(count) OVER (PARTITION BY src), 0) AS p FROM tr)
        SELECT src, tgt, round(p, 6) AS p, rank FROM (SELECT p.*, row_number() OVER (PARTITION BY src ORDER BY round(p, 6) DESC, tgt) AS rank FROM p WHERE src IN (SELECT src FROM h)) WHERE rank <= 100""",
)
def _(t):
    m = t.mentions()
    named = (
        scored_candidates(t).filter("i >= 0")
        .join(m.select("doc", F.col("idx").alias("i"), F.col("lemma").alias("src")), ["doc", "i"])
        .join(m.select("doc", F.col("idx").alias("j"), F.col("tok").alias("tgt")), ["doc", "j"])
    )
    counts = named.groupBy("src", "tgt").agg(F.sum("score").alias("count"))
    totals = counts.groupBy("src").agg(F.sum("count").alias("_t"))
    table = counts.join(totals, "src").withColumn("p", F.when(F.col("_t") != 0, F.col("count") / F.col("_t"))).drop("_t")
    return R.top_translations(table).select("src", "tgt", six_digits("p").alias("p"), "rank")


@query("win05_top_tables", "SELECT lemma AS \"table\", count(*) AS n FROM mentions GROUP BY lemma ORDER BY n DESC, lemma LIMIT 10")
def _(t):
    return t.mentions().groupBy(F.col("lemma").alias("table")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "table").limit(10)


@query(
    "win06_best_epoch",
    """WITH e AS (SELECT o_orderpriority AS run, o_custkey % 20 AS epoch, round(avg(o_totalprice) / 1000000, 2) AS f1 FROM orders GROUP BY ALL)
       SELECT run, epoch, f1 FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY f1 DESC, epoch DESC) AS r FROM e) WHERE r = 1""",
)
def _(t):
    results = t.read("orders").groupBy(F.col("o_orderpriority").alias("run"), (F.col("o_custkey") % 20).alias("epoch")).agg(
        F.round(F.avg("o_totalprice") / 1000000, 2).alias("f1")
    )
    return R.best_epoch(results)


@query("win07_mention_order", "SELECT doc, m_start, m_end, row_number() OVER (PARTITION BY doc ORDER BY m_start, m_end) - 1 AS place FROM mentions")
def _(t):
    return R.mention_order(t.mentions()).select("doc", "m_start", "m_end", "place")


@query("set01_union_mixed", "SELECT doc, idx, kind, type_name AS event_type, NULL::VARCHAR AS entity_type FROM mentions WHERE kind = 'event' UNION ALL SELECT doc, idx, kind, NULL, entity_type FROM mentions WHERE kind = 'entity'")
def _(t):
    m = t.mentions()
    events = m.filter("kind = 'event'").select("doc", "idx", "kind", F.col("type_name").alias("event_type"))
    entities = m.filter("kind = 'entity'").select("doc", "idx", "kind", "entity_type")
    return events.unionByName(entities, allowMissingColumns=True)


@query("set02_intersect_labels", "SELECT doc, c.label FROM mentions m JOIN crosswalk c ON m.type = c.type INTERSECT SELECT doc, label FROM segments")
def _(t):
    text = t.mentions().select("doc", "type").distinct().join(t.crosswalk(), "type").select("doc", "label")
    return text.intersect(t.segments().select("doc", "label"))


@query("set03_except_ids", "SELECT o_custkey AS id FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
def _(t):
    ids = t.read("orders").select(F.col("o_custkey").alias("id"))
    train = t.read("customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("id"))
    return ids.join(train, "id", "left_anti").distinct()


LABELLED = "labelled AS (SELECT doc, idx, type, cluster AS gold, min(idx) OVER (PARTITION BY doc, lemma, sent // 3) + 1 AS pred FROM mentions)"
SIZED = f"""{LABELLED}, scored AS (SELECT doc, idx, type, gold, CASE WHEN count(*) OVER (PARTITION BY doc, pred) > 1 THEN pred ELSE 0 END AS pred FROM labelled)"""
PAIRS = f"""{LABELLED}, prs AS (SELECT a.doc, a.type AS t1, b.type AS t2, (a.gold = b.gold AND a.gold > 0) AS y, (a.pred = b.pred) AS p FROM labelled a JOIN labelled b ON a.doc = b.doc AND a.idx < b.idx)"""
PRF = """tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
    round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""
COUNTS = "count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn, count(*) FILTER (NOT p AND NOT y) AS tn"


def labelled(t):
    m = t.mentions()
    key = ["doc", "lemma", "part"]
    parted = m.withColumn("part", F.floor(F.col("sent") / 3))
    first = parted.groupBy(*key).agg((F.min("idx") + 1).alias("pred"))
    return parted.join(first, key).select("doc", "idx", "type", F.col("cluster").alias("gold"), "pred")


def _rounded(df):
    return df.select(*[six_digits(c).alias(c) if t == "double" else c for c, t in df.dtypes])


@query("met01_pairwise_prf", f"WITH {PAIRS} SELECT {PRF} FROM (SELECT {COUNTS} FROM prs)")
def _(t):
    return _rounded(S.pairwise_prf(labelled(t)))


@query("met01_binary_prf", f"WITH q AS (SELECT l_returnflag, l_discount > 0.05 AS p, l_tax > 0.03 AS y FROM lineitem) SELECT l_returnflag, {PRF} FROM (SELECT l_returnflag, {COUNTS} FROM q GROUP BY ALL)")
def _(t):
    rows = t.read("lineitem").select("l_returnflag", (F.col("l_discount") > 0.05).cast("int").alias("pred"), (F.col("l_tax") > 0.03).cast("int").alias("label"))
    return _rounded(S.binary_prf(rows, ["l_returnflag"]))


@query("met02_pairwise_by_type", f"WITH {PAIRS} SELECT type, {PRF} FROM (SELECT type, {COUNTS} FROM (SELECT t1 AS type, p, y FROM prs UNION ALL SELECT t2, p, y FROM prs) GROUP BY type)")
def _(t):
    return _rounded(S.pairwise_by_type(labelled(t)))


@query("met03_all_positive_baseline", f"WITH {PAIRS.replace('(a.pred = b.pred) AS p', 'true AS p')} SELECT {PRF} FROM (SELECT {COUNTS} FROM prs)")
def _(t):
    return _rounded(S.all_positive_baseline(labelled(t)))


@query("met04_clusters_for_scoring", f"WITH {SIZED} SELECT 'gold' AS side, doc, gold AS cluster, idx FROM scored WHERE gold > 0 UNION ALL SELECT 'pred', doc, pred, idx FROM scored WHERE pred > 0")
def _(t):
    return S.clusters_for_scoring(labelled(t))


def _muc_side(mine: str, other: str) -> str:
    return f"""(SELECT sum(size - parts) / sum(size - 1) FROM (SELECT count(*) AS size, count(DISTINCT CASE WHEN {other} > 0 THEN {other} END) + count(*) FILTER ({other} = 0) AS parts
        FROM scored WHERE {mine} > 0 GROUP BY doc, {mine}))"""


SCORES = "metric, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1"


@query("met05_muc", f"WITH {SIZED} SELECT {SCORES} FROM (SELECT 'muc' AS metric, {_muc_side('pred', 'gold')} AS p, {_muc_side('gold', 'pred')} AS r)")
def _(t):
    return _rounded(S.muc(labelled(t)))


def _b3_side(mine: str, other: str) -> str:
    return f"""(SELECT sum(hit / size) / sum(size) FROM (SELECT c.doc, c.{mine}, sum(c.n) AS size, sum(CASE WHEN c.{other} > 0 AND o.size > 1 THEN c.n * c.n ELSE 0 END) AS hit
        FROM cells c JOIN (SELECT doc, {other}, sum(n) AS size FROM cells GROUP BY ALL) o ON c.doc = o.doc AND c.{other} = o.{other} WHERE c.{mine} > 0 GROUP BY ALL) WHERE size > 1)"""


CELLS = f"{SIZED}, cells AS (SELECT doc, gold, pred, count(*) AS n FROM scored GROUP BY ALL)"


@query("met06_b_cubed", f"WITH {CELLS} SELECT {SCORES} FROM (SELECT 'b_cubed' AS metric, {_b3_side('pred', 'gold')} AS p, {_b3_side('gold', 'pred')} AS r)")
def _(t):
    return _rounded(S.b_cubed(labelled(t)))


@query(
    "met07_ceaf_overlaps",
    f"""WITH {CELLS} SELECT c.doc, c.gold, c.pred, round(2.0::DOUBLE * c.n / (g.n + p.n), 6) AS phi FROM cells c JOIN (SELECT doc, gold, sum(n) AS n FROM cells GROUP BY ALL) g ON c.doc = g.doc AND c.gold = g.gold
        JOIN (SELECT doc, pred, sum(n) AS n FROM cells GROUP BY ALL) p ON c.doc = p.doc AND c.pred = p.pred WHERE c.gold > 0 AND c.pred > 0""",
)
def _(t):
    return _rounded(S.ceaf_overlaps(labelled(t)))


# Every one-to-one choice of each document's clusters, gold ones in turn: few overlap here.
CEAF = f"""{CELLS}, sz AS (SELECT c.doc, c.gold, c.pred, 2.0::DOUBLE * c.n / (g.n + p.n) AS phi FROM cells c JOIN (SELECT doc, gold, sum(n) AS n FROM cells GROUP BY ALL) g ON c.doc = g.doc AND c.gold = g.gold
        JOIN (SELECT doc, pred, sum(n) AS n FROM cells GROUP BY ALL) p ON c.doc = p.doc AND c.pred = p.pred WHERE c.gold > 0 AND c.pred > 0),
    gl AS (SELECT doc, gold, row_number() OVER (PARTITION BY doc ORDER BY gold) AS k FROM (SELECT DISTINCT doc, gold FROM sz)),
    op AS (SELECT doc, gold, pred, phi FROM sz UNION ALL SELECT DISTINCT doc, gold, NULL, 0 FROM sz),
    mt(doc, k, used, t) AS (SELECT DISTINCT doc, 0::BIGINT, []::BIGINT[], 0::DOUBLE FROM sz UNION ALL
      SELECT mt.doc, mt.k + 1, CASE WHEN op.pred IS NULL THEN used ELSE list_append(used, op.pred) END, t + op.phi FROM mt JOIN gl ON gl.doc = mt.doc AND gl.k = mt.k + 1
        JOIN op ON op.doc = mt.doc AND op.gold = gl.gold WHERE op.pred IS NULL OR NOT list_contains(used, op.pred)),
    ceaf AS (SELECT 'ceaf_e' AS metric, t / (SELECT count(*) FROM (SELECT DISTINCT doc, pred FROM cells WHERE pred > 0)) AS p, t / (SELECT count(*) FROM (SELECT DISTINCT doc, gold FROM cells WHERE gold > 0)) AS r
      FROM (SELECT sum(t) AS t FROM (SELECT max(t) AS t FROM mt GROUP BY doc)))"""


@query("met07_ceaf_e", f"WITH RECURSIVE {CEAF} SELECT {SCORES} FROM ceaf")
def _(t):
    return _rounded(S.ceaf_e(labelled(t)))


@query("met07_ceaf_crossing")
def _(t):
    """Clusters that cross: equal words against stretches of two sentences. The best
    choice, the bound that proves it, and how it was reached."""
    rows = t.mentions().select("doc", "idx", F.col("cluster").alias("gold"), (F.floor(F.col("sent") / 2) + 1).cast("long").alias("pred"))
    found = S.ceaf_matching(rows, tolerance=1e-3)
    return found.pairs.agg(F.count("*").alias("pairs"), six_digits(F.sum("value")).alias("total")).select(
        "pairs", "total", F.lit(round(found.bound, 6)).alias("bound"), F.lit(found.forced).cast("long").alias("forced"), F.lit(found.rounds).cast("long").alias("rounds")
    )


@query(
    "met08_conll_average",
    f"""WITH RECURSIVE {CEAF}, s AS (SELECT {_muc_side('pred', 'gold')} AS p, {_muc_side('gold', 'pred')} AS r UNION ALL SELECT {_b3_side('pred', 'gold')}, {_b3_side('gold', 'pred')} UNION ALL SELECT p, r FROM ceaf)
        SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(2 * p * r / (p + r)), 6) AS f1 FROM s""",
)
def _(t):
    return _rounded(S.conll_average(labelled(t)))


@query(
    "met08_average_of_link_scores",
    f"""WITH {CELLS}, s AS (SELECT {_muc_side('pred', 'gold')} AS p, {_muc_side('gold', 'pred')} AS r UNION ALL SELECT {_b3_side('pred', 'gold')}, {_b3_side('gold', 'pred')})
        SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(2 * p * r / (p + r)), 6) AS f1 FROM s""",
)
def _(t):
    rows = labelled(t)
    return _rounded(S.average_scores(S.muc(rows).unionByName(S.b_cubed(rows))))


@query(
    "met09_recall_at_k",
    f"""WITH {RETRIEVAL}, r AS (SELECT q, g, row_number() OVER (PARTITION BY q ORDER BY score DESC, g) AS r FROM sc)
        SELECT k, round((SELECT count(*) FROM r WHERE q = g AND r <= k) / (SELECT count(*) FROM tv), 6) AS recall FROM (VALUES (1), (5), (10)) v(k)""",
)
def _(t):
    text, video = _sides(t)
    queries = text.select(F.col("doc").alias("q"), "emb")
    top = R.retrieve_topk(queries, video.select(F.col("doc").alias("g"), "emb"), 10)
    truth = text.select(F.col("doc").alias("q"), F.col("doc").alias("g"))
    return _rounded(R.recall_at_k(top, truth, queries.count()))


CURVE = """rows_ AS (SELECT d.n_chars % 97 / 97.0::DOUBLE AS score, l.quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
    pts AS (SELECT score, count(*) AS n, sum(y) AS y FROM rows_ GROUP BY score),
    cv AS (SELECT score, sum(n) OVER w AS n, sum(y) OVER w AS tp, y AS own, (SELECT sum(y) FROM rows_) AS pos FROM pts WINDOW w AS (ORDER BY score DESC))"""


def _curve(t):
    rows = t.read("documents").join(t.read("labels"), "doc_id").select((F.col("n_chars") % 97 / 97.0).alias("score"), F.col("quality").alias("label"))
    return S.pr_curve(rows)


@query("met10_pr_curve", f"WITH {CURVE} SELECT round(score, 6) AS score, n::BIGINT AS n, tp::BIGINT AS tp, round(tp / n, 6) AS precision, round(tp / pos, 6) AS recall, round(2 * tp / (n + pos), 6) AS f1 FROM cv")
def _(t):
    return _rounded(_curve(t).drop("gain"))


@query(
    "met10_average_precision",
    f"""WITH {CURVE} SELECT round(sum(own / pos * tp / n), 6) AS average_precision, round(max(2 * tp / (n + pos)), 6) AS best_f1,
        round(max_by(score, struct_pack(f := round(2 * tp / (n + pos), 9), s := score)), 6) AS threshold FROM cv""",
)
def _(t):
    return _rounded(S.average_precision(_curve(t)))


CLASSES = """cl AS (SELECT l_linenumber % 3 AS pred, (l_quantity::BIGINT + l_linenumber) % 3 AS label FROM lineitem),
    k AS (SELECT c, count(*) FILTER (pred = c AND label = c) AS tp, count(*) FILTER (pred = c AND label <> c) AS fp, count(*) FILTER (pred <> c AND label = c) AS fn FROM cl, (SELECT unnest([0, 1, 2]) AS c) GROUP BY c),
    s AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r, 2 * tp / (2 * tp + fp + fn) AS f FROM k)"""


@query(
    "met11_f1_averages",
    f"""WITH {CLASSES} SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1, round(avg(f), 6) AS macro_f1, round(sum(f * (tp + fn)) / sum(tp + fn), 6) AS weighted_f1,
        round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall FROM s""",
)
def _(t):
    rows = t.read("lineitem").select(
        (F.col("l_linenumber") % 3).alias("pred"), ((F.col("l_quantity").cast("long") + F.col("l_linenumber")) % 3).alias("label")
    )
    return _rounded(S.f1_averages(rows))


@query(
    "met12_document_macro_scores",
    f"""WITH {PAIRS}, d AS (SELECT doc, {COUNTS} FROM prs GROUP BY doc) SELECT count(*) AS n_docs, round(avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END), 6) AS precision,
        round(avg(tp / (tp + fn)), 6) AS recall, round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS f1 FROM d WHERE tp + fn > 0""",
)
def _(t):
    return _rounded(S.document_macro_scores(labelled(t)))


@query("em11_threshold_antecedents", f"WITH {SCORED} SELECT doc, j AS idx, coalesce(max(i) FILTER (r = 1 AND score > 0.55), -1) AS antecedent FROM (SELECT *, row_number() OVER (PARTITION BY doc, j ORDER BY (i >= 0) DESC, score DESC, i) AS r FROM cand) GROUP BY doc, j")
def _(t):
    return K.threshold_antecedents(scored_candidates(t), 0.55)


CHAIN = "chain AS (SELECT doc, idx, coalesce(lag(idx) OVER (PARTITION BY doc, lemma ORDER BY idx), -1) AS antecedent FROM mentions)"


def chains(t):
    """Each mention links to the nearest earlier one of its lemma: long chains."""
    from corefold.operators import order

    numbered = order.number_rows(t.mentions().select("doc", "idx", "lemma"), ["doc", "lemma"], ["idx"], order.blocks_of(F.col("idx"), 65536), "n")
    before = numbered.select("doc", "lemma", (F.col("n") + 1).alias("n"), F.col("idx").alias("_b"))
    return numbered.join(before, ["doc", "lemma", "n"], "left").select("doc", "idx", F.coalesce("_b", F.lit(-1)).alias("antecedent"))


@query("em12_antecedents_to_clusters", f"WITH r AS (SELECT doc, idx, min(idx) OVER (PARTITION BY doc, lemma) AS root FROM mentions) SELECT doc, idx, root, dense_rank() OVER (ORDER BY doc, root) AS cluster_id FROM r")
def _(t):
    return K.antecedents_to_clusters(chains(t))


@query(
    "em13_clusters_to_antecedents",
    "SELECT doc, idx, CASE WHEN f < idx THEN f ELSE -1 END AS antecedent FROM (SELECT doc, idx, min(idx) OVER (PARTITION BY doc, cluster) AS f FROM mentions)",
)
def _(t):
    return K.clusters_to_antecedents(t.mentions())
