"""Queries on the translation models and the mixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from corefold.catalog.counts_and_scores import _rounded
from corefold.catalog.pairs_and_media import COSINE, SHAPE, SOFT, mean_sql, shape, unit_vectors
from corefold.catalog.registry import query
from corefold.catalog.tables import six_digits
from corefold.functions import text as X
from corefold.functions import vectors as V
from corefold.operators import media as M
from corefold.operators import pairs as P
from corefold.operators import ranking as R
from corefold.plans import clusters as K
from corefold.plans import mixture as MX
from corefold.plans import translation as T
from corefold.session import cut_lineage

BLOCK = 32  # small, so that the comparison runs through several blocks
N_CLUSTERS = 10

TEXT = """cand AS MATERIALIZED (SELECT b.doc, b.idx AS j, b.lemma AS tgt, a.lemma AS src, count(*)::DOUBLE AS n, min(a.idx) AS first FROM mentions a JOIN mentions b
    ON a.doc = b.doc AND a.type = b.type AND a.idx < b.idx GROUP BY ALL UNION ALL SELECT doc, idx, lemma, '###NEW###', 1, -1 FROM mentions),
    p0 AS (SELECT DISTINCT src, tgt, 1 / (SELECT count(DISTINCT lemma) FROM mentions) AS p FROM cand)"""


def text_rounds(rounds: int) -> str:
    """Views e0, p1, e1, p2, ...: posteriors and tables of the rounds."""
    views = [TEXT]
    for r in range(rounds + 1):
        views.append(f"e{r} AS MATERIALIZED (SELECT c.*, p.p AS w, n * p.p / sum(n * p.p) OVER (PARTITION BY doc, j) AS post FROM cand c JOIN p{r} p ON c.src = p.src AND c.tgt = p.tgt)")
        views.append(f"p{r + 1} AS MATERIALIZED (SELECT src, tgt, c AS count, c / sum(c) OVER (PARTITION BY src) AS p FROM (SELECT src, tgt, sum(post) AS c FROM e{r} GROUP BY ALL))")
    return ", ".join(views)


def text_candidates(t):
    return T.text_candidates(t.mentions(), ["doc", "type"], block=BLOCK)


def fitted_text(t, rounds):
    return T.fit(text_candidates(t), T.vocab_sizes(t.mentions()), rounds)


@query("em01_init_translation", f"WITH {TEXT} SELECT src, tgt, round(p, 9) AS p FROM p0")
def _(t):
    table = T.init_translation(text_candidates(t), T.vocab_sizes(t.mentions()))
    return table.select("src", "tgt", F.round("p", 9).alias("p"))


@query("em02_e_step_text", f"WITH {text_rounds(1)} SELECT doc, j, src, n, first, round(post, 6) AS post FROM e1")
def _(t):
    model = fitted_text(t, 1)
    return model.posterior().select("doc", "j", "src", "n", "first", six_digits("post").alias("post"))


@query("em03_m_step_text", f"WITH {text_rounds(0)} SELECT src, tgt, round(count, 6) AS count, round(p, 6) AS p FROM p1")
def _(t):
    return _rounded(fitted_text(t, 1).translation.drop("mode"))


MODES = """mm AS (SELECT *, type < 2 AS visual FROM mentions),
    mv AS MATERIALIZED (SELECT doc, idx, type, number, type < 2 AS visual, lemma, sent, list_transform(emb, lambda x: x / greatest(1e-100, sqrt(list_dot_product(emb, emb)))) AS u FROM mention_vectors),
    sem AS MATERIALIZED (SELECT b.doc, b.idx AS j, a.idx AS i, b.lemma AS tgt, a.lemma AS src, b.sent - a.sent AS dist FROM mv a JOIN mv b
      ON a.doc = b.doc AND a.type = b.type AND a.number = b.number AND a.visual = b.visual AND a.idx < b.idx WHERE abs(list_dot_product(a.u, b.u)) > 0.5),
    moded AS (SELECT *, CASE WHEN s IS NOT NULL AND (d IS NULL OR s <= d) THEN 'semantic' WHEN d IS NOT NULL THEN 'discourse' WHEN visual THEN 'visual' ELSE 'semantic' END AS mode FROM (
      SELECT m.*, s0 AS s, CASE WHEN mtype = 'pronoun' AND d0 < idx THEN d0 END AS d FROM (
        SELECT *, min(idx) FILTER (mtype = 'nominal') OVER (PARTITION BY doc, type) AS d0 FROM mm) m
      LEFT JOIN (SELECT doc, j, min(i) AS s0 FROM sem GROUP BY ALL) s ON s.doc = m.doc AND s.j = m.idx)),
    mass AS (SELECT doc, k, sum(p) AS mass FROM posteriors GROUP BY ALL),
    mcand AS MATERIALIZED (SELECT 'semantic' AS mode, s.doc, s.j, s.tgt, s.src, s.dist, count(*)::DOUBLE AS n, min(s.i) AS first, true AS open
        FROM sem s JOIN moded b ON s.doc = b.doc AND s.j = b.idx WHERE b.mode = 'semantic' GROUP BY ALL
      UNION ALL SELECT mode, doc, idx, lemma, '###NEW###', sent, 1, -1, tag <> 'PRP' FROM moded WHERE mode = 'semantic'
      UNION ALL SELECT 'discourse', b.doc, b.idx, b.mtype || '__' || b.number, a.mtype || '__' || a.number, b.sent - a.sent, count(*), min(a.idx), true
        FROM moded b JOIN mm a ON a.doc = b.doc AND a.type = b.type AND a.idx < b.idx AND a.mtype = 'nominal' WHERE b.mode = 'discourse' AND b.mtype = 'pronoun' GROUP BY ALL
      UNION ALL SELECT mode, doc, idx, mtype || '__' || number, '###NEW###', sent, 1, -1, tag <> 'PRP' FROM moded WHERE mode = 'discourse'
      UNION ALL SELECT 'visual', m.doc, m.idx, m.lemma, 'k:' || s.k, m.sent, s.mass, NULL, true FROM moded m JOIN mass s ON m.doc = s.doc WHERE m.mode = 'visual'
      UNION ALL SELECT mode, doc, idx, lemma, '###NEW###', sent, 1, -1, true FROM moded WHERE mode = 'visual'),
    sizes AS (SELECT 'discourse' AS mode, count(DISTINCT mtype || '__' || number) AS v FROM mentions UNION ALL SELECT 'semantic', count(DISTINCT lemma) FROM mentions UNION ALL SELECT 'visual', count(DISTINCT lemma) FROM mentions),
    t0 AS (SELECT DISTINCT c.mode, src, tgt, 1 / s.v AS p FROM mcand c JOIN sizes s ON c.mode = s.mode),
    q0 AS (SELECT mode, dist, 1 / count(*) OVER (PARTITION BY mode) AS p FROM (SELECT DISTINCT mode, dist FROM mcand))"""


def mode_rounds(rounds: int) -> str:
    views = [MODES]
    for r in range(rounds + 1):
        views += [
            f"""w{r} AS MATERIALIZED (SELECT c.*, CASE WHEN open THEN coalesce(t.p, 0) * coalesce(q.p, 0) ELSE 0 END AS w FROM mcand c LEFT JOIN t{r} t ON c.mode = t.mode AND c.src = t.src AND c.tgt = t.tgt
                LEFT JOIN q{r} q ON c.mode = q.mode AND c.dist = q.dist)""",
            f"x{r} AS MATERIALIZED (SELECT *, n * w / greatest(1e-100, sum(n * w) OVER (PARTITION BY doc, j)) AS post FROM w{r})",
            f"""t{r + 1} AS MATERIALIZED (SELECT mode, src, tgt, c AS count, c / greatest(1e-100, sum(c) OVER (PARTITION BY mode, src)) AS p FROM (
                SELECT mode, src, tgt, sum(post) AS c FROM x{r} WHERE open GROUP BY ALL))""",
            f"""q{r + 1} AS MATERIALIZED (SELECT * FROM q{r} WHERE mode <> 'discourse' UNION ALL SELECT mode, dist, c / sum(c) OVER () FROM (
                SELECT mode, dist, sum(post) AS c FROM x{r} WHERE open AND mode = 'discourse' GROUP BY ALL))""",
        ]
    return ", ".join(views)


def semantic_words(t):
    return cut_lineage(T.semantic_matches(t.mention_vectors().withColumn("visual", F.col("type") < 2), block=BLOCK))


def moded(t, semantic=None):
    return T.assign_mode(t.mentions().withColumn("visual", F.col("type") < 2), semantic_words(t) if semantic is None else semantic)


def mode_candidates(t):
    semantic = semantic_words(t)
    return T.mode_candidates(cut_lineage(moded(t, semantic)), semantic, T.cluster_mass(t.posteriors()), block=BLOCK)


def fitted_modes(t, rounds):
    return T.fit(mode_candidates(t), T.mode_vocab_sizes(t.mentions()), rounds, positions=True)


@query("prj29_assign_mode", f"WITH {MODES} SELECT doc, idx, mode FROM moded")
def _(t):
    return moded(t).select("doc", "idx", "mode")


@query(
    "prj29_assign_mode_from_matches",
    f"""WITH f AS (SELECT a.doc, b.idx AS j, a.idx AS i, {COSINE.format('a.emb', 'b.emb')} > 0.1 AND a.number = b.number AS s, a.mtype = 'nominal' AND b.mtype = 'pronoun' AS d
        FROM mention_vectors a JOIN mention_vectors b ON a.doc = b.doc AND a.type = b.type AND a.idx < b.idx)
        SELECT m.doc, m.idx, coalesce((SELECT arg_min(CASE WHEN s THEN 'semantic' ELSE 'discourse' END, i) FROM f WHERE f.doc = m.doc AND f.j = m.idx AND (s OR d)),
        CASE WHEN m.type < 2 THEN 'visual' ELSE 'semantic' END) AS mode FROM mentions m""",
)
def _(t):
    cand = P.antecedent_candidates(unit_vectors(t), ["doc", "type"], ["emb", "number", "tag", "mtype"])
    flags = cand.withColumn("semantic", P.match_semantic(0.1)).withColumn("discourse", P.match_discourse())
    return T.assign_mode_from_matches(flags, F.when(F.col("type") < 2, "visual").otherwise("semantic"))


@query("prj30_mode_feature", f"WITH {MODES} SELECT doc, idx, CASE WHEN mode = 'discourse' THEN mtype || '__' || number ELSE lemma END AS feature FROM moded")
def _(t):
    return moded(t).select("doc", "idx", X.mode_feature(F.col("mode"), F.col("lemma"), F.col("mtype"), F.col("number")).alias("feature"))


@query("em04_e_step_modes", f"WITH {mode_rounds(1)} SELECT mode, doc, j, src, dist, first, round(post, 6) AS post FROM x1 WHERE mode <> 'visual'")
def _(t):
    model = fitted_modes(t, 1)
    post = model.posterior()
    return post.filter("mode <> 'visual'").select("mode", "doc", "j", "src", "dist", "first", six_digits("post").alias("post"))


@query("em05_e_step_visual", f"WITH {mode_rounds(1)} SELECT doc, j, src, round(n, 6) AS n, round(post, 6) AS post FROM x1 WHERE mode = 'visual'")
def _(t):
    model = fitted_modes(t, 1)
    post = model.posterior()
    return _rounded(post.filter("mode = 'visual'").select("doc", "j", "src", "n", "post"))


@query("em06_m_step_modes", f"WITH {mode_rounds(1)} SELECT mode, src, tgt, round(count, 6) AS count, round(p, 6) AS p FROM t2")
def _(t):
    return _rounded(fitted_modes(t, 2).translation.select("mode", "src", "tgt", "count", "p"))


@query("em07_position_probs", f"WITH {mode_rounds(1)} SELECT mode, dist, round(p, 6) AS p FROM q2")
def _(t):
    return _rounded(fitted_modes(t, 2).position)


@query(
    "em08_log_likelihood",
    f"WITH {text_rounds(1)} SELECT round(sum(ln(greatest(m, 1e-100))), 6) AS log_likelihood FROM (SELECT sum(n * w) / sum(n) AS m FROM e1 GROUP BY doc, j)",
)
def _(t):
    model = fitted_text(t, 1)
    return _rounded(model.dealt.log_likelihood(model.translation))


ROUNDS = 10


@query("em09_fit", f"WITH {text_rounds(ROUNDS - 1)} SELECT src, tgt, round(count, 6) AS count, round(p, 6) AS p FROM p{ROUNDS}")
def _(t):
    return _rounded(fitted_text(t, ROUNDS).translation.drop("mode"))


@query(
    "em10_predict_antecedents",
    f"""WITH {text_rounds(ROUNDS)} SELECT doc, j AS idx, first AS antecedent, round(w, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc, j ORDER BY round(w, 12) DESC, first) AS r FROM e{ROUNDS}) WHERE r = 1""",
)
def _(t):
    model = fitted_text(t, ROUNDS)
    rounded = model.translation.withColumn("p", F.round("p", 12))
    return _rounded(T.predict_antecedents(model.dealt, rounded))


@query(
    "em10_predict_antecedents_modes",
    f"""WITH {mode_rounds(ROUNDS)} SELECT doc, j AS idx, first AS antecedent FROM (SELECT *, row_number() OVER (PARTITION BY doc, j ORDER BY round(w, 12) DESC, first) AS r FROM w{ROUNDS} WHERE mode <> 'visual') WHERE r = 1""",
)
def _(t):
    model = fitted_modes(t, ROUNDS)
    scored = model.posterior().filter("mode <> 'visual'")
    ranked = R.rank_antecedents(scored.select("doc", "j", F.col("first").alias("i"), F.round("w", 12).alias("score")))
    return ranked.select("doc", "idx", "antecedent")


VISUAL_ONLY = """vm AS (SELECT * FROM mentions WHERE type < 2), mass AS (SELECT doc, k, sum(p) AS mass FROM posteriors GROUP BY ALL),
    vc AS (SELECT m.doc, m.idx AS j, m.lemma AS tgt, 'k:' || s.k AS src, s.mass AS n FROM vm m JOIN mass s ON m.doc = s.doc UNION ALL SELECT doc, idx, lemma, '###NEW###', 1 FROM vm),
    v0 AS (SELECT src, tgt, c / sum(c) OVER (PARTITION BY src) AS p FROM (SELECT src, tgt, sum(n / t) AS c FROM (SELECT *, sum(n) OVER (PARTITION BY doc, j) AS t FROM vc) GROUP BY ALL)),
    em AS (SELECT substr(src, 3)::INT AS k, tgt AS word, p AS e FROM v0 WHERE src LIKE 'k:%'), e0 AS (SELECT tgt AS word, p AS e0 FROM v0 WHERE src = '###NEW###'),
    fw AS (SELECT p.doc, p.fidx, w.lemma AS word, sum(p.p * em.e) AS x FROM posteriors p JOIN (SELECT DISTINCT doc, lemma FROM vm) w ON p.doc = w.doc JOIN em ON em.word = w.lemma AND em.k = p.k GROUP BY ALL),
    tot AS (SELECT doc, word, sum(x) AS m FROM fw GROUP BY ALL),
    ws AS (SELECT a.doc, a.word AS tgt, b.word AS src, (sum(a.x * b.x) + any_value(e0.e0) * any_value(e0.e0)) / ((any_value(ta.m) + any_value(e0.e0)) * (any_value(tb.m) + any_value(e0.e0))) AS score
      FROM fw a JOIN fw b ON a.doc = b.doc AND a.fidx = b.fidx JOIN tot ta ON ta.doc = a.doc AND ta.word = a.word JOIN tot tb ON tb.doc = b.doc AND tb.word = b.word JOIN e0 ON e0.word = a.word GROUP BY ALL),
    vs AS (SELECT b.doc, b.idx AS j, a.idx AS i, ws.score FROM vm a JOIN vm b ON a.doc = b.doc AND a.type = b.type AND a.number = b.number AND a.idx < b.idx JOIN ws ON ws.doc = b.doc AND ws.tgt = b.lemma AND ws.src = a.lemma
      UNION ALL SELECT m.doc, m.idx, -1, e0.e0 / (tot.m + e0.e0) FROM vm m JOIN e0 ON e0.word = m.lemma JOIN tot ON tot.doc = m.doc AND tot.word = m.lemma)"""


@query(
    "em10_predict_visual_antecedents",
    f"WITH {VISUAL_ONLY} SELECT doc, j AS idx, i AS antecedent, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc, j ORDER BY round(score, 12) DESC, i) AS r FROM vs) WHERE r = 1",
)
def _(t):
    seen = t.mentions().filter("type < 2")
    posteriors = t.posteriors()
    cand = T.visual_candidates(seen, T.cluster_mass(posteriors)).unionByName(T.null_candidates(seen, mode="visual"))
    cand = cand.withColumn("dist", F.lit(0).cast("long"))
    model = T.fit(cand, {"visual": T.vocab_sizes(seen)["text"]}, 1)
    return _rounded(T.visual_antecedents(seen, seen, posteriors, model.translation))


def visual_scores(table: str, later: str, earlier: str) -> str:
    """vs: the scores of visual mentions ``later`` under a table of the rounds, with all
    frames written out."""
    return f"""em AS MATERIALIZED (SELECT substr(src, 3)::INT AS k, tgt AS word, p AS e FROM {table} WHERE mode = 'visual' AND src LIKE 'k:%'),
    e0 AS (SELECT tgt AS word, p AS e0 FROM {table} WHERE mode = 'visual' AND src = '###NEW###'),
    fw AS MATERIALIZED (SELECT p.doc, p.fidx, w.lemma AS word, sum(p.p * em.e) AS x FROM posteriors p JOIN (SELECT DISTINCT doc, lemma FROM {earlier}) w ON p.doc = w.doc JOIN em ON em.word = w.lemma AND em.k = p.k GROUP BY ALL),
    tot AS (SELECT doc, word, sum(x) AS m FROM fw GROUP BY ALL),
    ws AS MATERIALIZED (SELECT a.doc, a.word AS tgt, b.word AS src, (sum(a.x * b.x) + any_value(e0.e0) * any_value(e0.e0)) / ((any_value(ta.m) + any_value(e0.e0)) * (any_value(tb.m) + any_value(e0.e0))) AS score
      FROM fw a JOIN fw b ON a.doc = b.doc AND a.fidx = b.fidx JOIN tot ta ON ta.doc = a.doc AND ta.word = a.word JOIN tot tb ON tb.doc = b.doc AND tb.word = b.word JOIN e0 ON e0.word = a.word GROUP BY ALL),
    vs AS (SELECT b.doc, b.idx AS j, a.idx AS i, ws.score FROM {earlier} a JOIN {later} b ON a.doc = b.doc AND a.type = b.type AND a.number = b.number AND a.idx < b.idx JOIN ws ON ws.doc = b.doc AND ws.tgt = b.lemma AND ws.src = a.lemma
      UNION ALL SELECT m.doc, m.idx, -1, coalesce(e0.e0 / (tot.m + e0.e0), 1) FROM {later} m LEFT JOIN tot ON tot.doc = m.doc AND tot.word = m.lemma LEFT JOIN e0 ON e0.word = m.lemma)"""


def rooted(links: str) -> str:
    """Follows the links of a view (doc, idx, antecedent) to the first mention; ids in
    the order of document and first mention."""
    return f"""rt(doc, idx, root) AS (SELECT doc, idx, idx FROM {links} WHERE antecedent = -1 UNION ALL SELECT l.doc, l.idx, rt.root FROM rt JOIN {links} l ON l.doc = rt.doc AND l.antecedent = rt.idx),
        ids AS (SELECT doc, idx, root, dense_rank() OVER (ORDER BY doc, root) AS cluster_id FROM rt)"""


BEST = "row_number() OVER (PARTITION BY doc, j ORDER BY round(score, 12) DESC, i) AS r"


@query(
    "em10_predict_all_modes",
    f"""WITH RECURSIVE {mode_rounds(ROUNDS)}, late AS (SELECT * FROM moded WHERE mode = 'visual'), early AS (SELECT * FROM moded WHERE visual), {visual_scores(f't{ROUNDS}', 'late', 'early')},
        lk AS MATERIALIZED (SELECT doc, j AS idx, i AS antecedent FROM (SELECT *, {BEST} FROM (SELECT doc, j, first AS i, w AS score FROM w{ROUNDS} WHERE mode <> 'visual' UNION ALL SELECT doc, j, i, score FROM vs)) WHERE r = 1),
        {rooted('lk')} SELECT m.mode, ids.doc, ids.idx, lk.antecedent, ids.cluster_id FROM ids JOIN lk ON lk.doc = ids.doc AND lk.idx = ids.idx JOIN moded m ON m.doc = ids.doc AND m.idx = ids.idx""",
)
def _(t):
    semantic = semantic_words(t)
    mentions = cut_lineage(moded(t, semantic))
    candidates = T.mode_candidates(mentions, semantic, T.cluster_mass(t.posteriors()), block=BLOCK)
    model = T.fit(candidates, T.mode_vocab_sizes(t.mentions()), ROUNDS, positions=True)
    links = cut_lineage(T.amodal_antecedents(model, mentions, t.posteriors()))
    clusters = K.antecedents_to_clusters(links).select("doc", "idx", "cluster_id")
    return links.join(clusters, ["doc", "idx"]).join(mentions.select("doc", "idx", "mode"), ["doc", "idx"]).select("mode", "doc", "idx", "antecedent", "cluster_id")


JOINT = """mm AS (SELECT *, type < 2 AS visual FROM mentions),
    mv AS MATERIALIZED (SELECT doc, idx, number, lemma, list_transform(emb, lambda x: x / greatest(1e-100, sqrt(list_dot_product(emb, emb)))) AS u FROM mention_vectors),
    jm AS MATERIALIZED (SELECT b.doc, b.idx AS j, a.idx AS i, b.lemma AS tgt, a.lemma AS src FROM mv a JOIN mv b ON a.doc = b.doc AND a.number = b.number AND a.idx < b.idx WHERE abs(list_dot_product(a.u, b.u)) > 0.5),
    mass AS (SELECT doc, k, sum(p) AS mass FROM posteriors GROUP BY ALL),
    cand AS MATERIALIZED (SELECT 'text' AS mode, doc, j, tgt, src, count(*)::DOUBLE AS n, min(i) AS first FROM jm GROUP BY ALL UNION ALL SELECT 'text', doc, idx, lemma, '###NEW###', 1, -1 FROM mm
      UNION ALL SELECT 'visual', m.doc, m.idx, m.lemma, 'k:' || s.k, s.mass, NULL FROM mm m JOIN mass s ON m.doc = s.doc WHERE m.visual),
    t0 AS (SELECT DISTINCT mode, src, tgt, 1 / (SELECT count(DISTINCT lemma) FROM mentions) AS p FROM cand)"""


def joint_rounds(rounds: int) -> str:
    views = [JOINT]
    for r in range(rounds + 1):
        views += [
            f"w{r} AS MATERIALIZED (SELECT c.*, t.p AS w, n * t.p / sum(n * t.p) OVER (PARTITION BY doc, j) AS post FROM cand c JOIN t{r} t ON c.mode = t.mode AND c.src = t.src AND c.tgt = t.tgt)",
            f"t{r + 1} AS MATERIALIZED (SELECT mode, src, tgt, c / sum(c) OVER (PARTITION BY mode, src) AS p FROM (SELECT mode, src, tgt, sum(post) AS c FROM w{r} GROUP BY ALL))",
        ]
    return ", ".join(views)


def joint_model(t, rounds):
    vectors = t.mention_vectors().withColumn("visual", F.col("type") < 2)
    semantic = cut_lineage(T.semantic_matches(vectors, block=BLOCK, keys=("doc", "number")))
    mentions = t.mentions().withColumn("visual", F.col("type") < 2)
    size = T.vocab_sizes(mentions)["text"]
    return mentions, T.fit(T.joint_candidates(mentions, semantic, T.cluster_mass(t.posteriors())), {"text": size, "visual": size}, rounds)


@query("em02_joint_posterior", f"WITH {joint_rounds(1)} SELECT mode, doc, j, src, round(n, 6) AS n, round(post, 6) AS post FROM w1")
def _(t):
    """Text and visual partners of a mention share one normaliser."""
    return _rounded(joint_model(t, 1)[1].posterior().select("mode", "doc", "j", "src", "n", "post"))


@query(
    "em10_predict_joint",
    f"""WITH RECURSIVE {joint_rounds(ROUNDS)}, fr AS (SELECT p.doc, p.fidx, w.lemma, sum(p.p * t.p) AS s FROM posteriors p JOIN (SELECT DISTINCT doc, lemma FROM mm WHERE visual) w ON p.doc = w.doc
          JOIN t{ROUNDS} t ON t.mode = 'visual' AND t.src = 'k:' || p.k AND t.tgt = w.lemma GROUP BY ALL),
        al AS (SELECT doc, j, CASE WHEN first = -1 THEN 1 ELSE 2 END AS kind, first AS partner, w AS score FROM w{ROUNDS} WHERE mode = 'text'
          UNION ALL SELECT m.doc, m.idx, 0, fr.fidx, fr.s FROM mm m JOIN fr ON fr.doc = m.doc AND fr.lemma = m.lemma WHERE m.visual),
        ch AS MATERIALIZED (SELECT doc, j AS idx, kind, partner FROM (SELECT *, row_number() OVER (PARTITION BY doc, j ORDER BY round(score, 12) DESC, kind, partner) AS r FROM al) WHERE r = 1),
        lk AS MATERIALIZED (SELECT doc, idx, kind, CASE WHEN kind > 0 THEN partner WHEN f < idx THEN f ELSE -1 END AS antecedent FROM (SELECT *, min(idx) FILTER (kind = 0) OVER (PARTITION BY doc, kind, partner) AS f FROM ch)),
        {rooted('lk')} SELECT ids.doc, ids.idx, lk.kind, ch.partner, lk.antecedent, ids.cluster_id FROM ids JOIN lk ON lk.doc = ids.doc AND lk.idx = ids.idx JOIN ch ON ch.doc = ids.doc AND ch.idx = ids.idx""",
)
def _(t):
    mentions, model = joint_model(t, ROUNDS)
    chosen = cut_lineage(T.joint_antecedents(model, mentions, t.posteriors(), block=BLOCK))
    links = cut_lineage(T.joint_links(chosen))
    clusters = K.antecedents_to_clusters(links).select("doc", "idx", "cluster_id")
    return chosen.select("doc", "idx", "kind", "partner").join(links, ["doc", "idx"]).join(clusters, ["doc", "idx"])


@query(
    "em14_visual_cluster_link",
    """WITH s AS (SELECT m.doc, m.idx, f.fidx, list_dot_product(m.emb, f.emb) AS s FROM mention_vectors m JOIN frames f ON m.doc = f.doc),
       b AS (SELECT doc, idx, fidx, s FROM (SELECT *, row_number() OVER (PARTITION BY doc, idx ORDER BY s DESC, fidx) AS r FROM s) WHERE r = 1),
       u AS (SELECT l.doc, l.idx, coalesce(b.s > 0.3, false) AS v, CASE WHEN coalesce(b.s > 0.3, false) THEN b.fidx ELSE l.antecedent END AS partner FROM links l LEFT JOIN b ON l.doc = b.doc AND l.idx = b.idx)
       SELECT doc, idx, CASE WHEN v THEN CASE WHEN f < idx THEN f ELSE -1 END ELSE partner END AS antecedent FROM (SELECT *, min(idx) FILTER (v) OVER (PARTITION BY doc, partner) AS f FROM u)""",
)
def _(t):
    import numpy as np
    import pandas as pd

    def best(l, r):
        if l.empty or r.empty:
            return pd.DataFrame()
        r = r.sort_values("fidx")
        s = np.stack(l["emb"].to_numpy()) @ np.stack(r["emb"].to_numpy()).T
        return pd.DataFrame({"doc": l["doc"].to_numpy(), "idx": l["idx"].to_numpy(), "fidx": r["fidx"].to_numpy()[s.argmax(axis=1)], "s": s.max(axis=1)})

    parts = P.block_scores(t.vectors(), t.frames().select("doc", "fidx", "emb"), ["doc"], "idx", "fidx", best, "doc long, idx long, fidx long, s double")
    top = parts.groupBy("doc", "idx").agg(F.max(F.struct("s", (-F.col("fidx")).alias("_f"))).alias("_b"))
    near = F.coalesce(F.col("_b.s") > 0.3, F.lit(False))
    rows = t.links().join(top, ["doc", "idx"], "left").select(
        "doc", "idx", near.alias("is_action"), F.when(near, -F.col("_b._f")).otherwise(F.col("antecedent")).alias("partner")
    )
    return K.visual_cluster_link(rows)


@query("em15_kmeans_centroids")
def _(t):
    centers = MX.kmeans_centroids(t.frames(), 6, rounds=5)
    posterior = V.gaussian_posterior(F.col("emb"), centers, 0.5)
    return t.frames().select("doc", "fidx", F.posexplode(posterior).alias("k", "p")).groupBy("k").agg(six_digits(F.sum("p")).alias("mass"))


@query("em16_pca")
def _(t):
    projected, explained = MX.pca(t.embeddings(), 4)
    return projected.select("vec_id", F.size("emb").alias("dims"), six_digits(F.abs(F.element_at("emb", 1))).alias("first"), F.lit(round(explained[0], 6)).alias("explained"))


def mixture_rounds(rounds: int, alpha: float = 1.0) -> str:
    views = [f"""dw AS (SELECT doc, lemma AS word, count(*) AS n, min(idx) AS first FROM mentions GROUP BY ALL),
        g0 AS (SELECT w.word, k.k, {1 / N_CLUSTERS} AS p FROM (SELECT DISTINCT word FROM dw) w, (SELECT unnest(range({N_CLUSTERS})) AS k) k)"""]
    for r in range(rounds + 1):
        views += [
            f"d{r} AS (SELECT doc, k, sum(n * p) AS d FROM dw JOIN g{r} g ON dw.word = g.word GROUP BY ALL)",
            f"z{r} AS (SELECT p.doc, p.fidx, sum(p.p * d.d) AS z FROM posteriors p JOIN d{r} d ON p.doc = d.doc AND p.k = d.k GROUP BY ALL)",
            f"r{r} AS (SELECT p.doc, p.k, sum(p.p / z.z) AS r FROM posteriors p JOIN z{r} z ON p.doc = z.doc AND p.fidx = z.fidx GROUP BY ALL)",
            f"c{r} AS (SELECT dw.word, g.k, sum(dw.n * g.p * r.r) AS c FROM dw JOIN g{r} g ON dw.word = g.word JOIN r{r} r ON r.doc = dw.doc AND r.k = g.k GROUP BY ALL)",
            f"""g{r + 1} AS (SELECT word, k, ({alpha / N_CLUSTERS} + c) / ({alpha} + sum(c) OVER (PARTITION BY word)) AS p FROM (
                SELECT g.word, g.k, coalesce(c.c, 0) AS c FROM g{r} g LEFT JOIN c{r} c ON g.word = c.word AND g.k = c.k))""",
        ]
    return ", ".join(views)


def mixture(t, rounds=2):
    words, posteriors = MX.document_words(t.mentions()), t.posteriors()
    return words, posteriors, MX.mixture_translate(words, posteriors, N_CLUSTERS, rounds)


@query("em17_mixture_translate", f"WITH {mixture_rounds(1)} SELECT word, k::BIGINT AS k, round(p, 6) AS p FROM g2")
def _(t):
    return _rounded(mixture(t)[2])


@query(
    "em17_mixture_log_likelihood",
    f"WITH {mixture_rounds(2)} SELECT round(sum(ln(z.z / s.n)), 5) AS log_likelihood FROM z2 z JOIN (SELECT doc, sum(n) AS n FROM dw GROUP BY doc) s ON z.doc = s.doc",
)
def _(t):
    return MX.mixture_log_likelihood(*mixture(t)).select(F.round("log_likelihood", 5).alias("log_likelihood"))


@query(
    "em18_mixture_update_means",
    f"""WITH {mixture_rounds(2)}, w AS (SELECT doc, fidx, k, x / sum(x) OVER (PARTITION BY doc, fidx) AS w FROM (SELECT p.doc, p.fidx, p.k, p.p * d.d AS x FROM posteriors p JOIN d2 d ON p.doc = d.doc AND p.k = d.k)),
        u AS (SELECT k, list(x ORDER BY dim) AS emb FROM (SELECT k, dim, sum(w * x) / sum(w) AS x FROM (SELECT w.k, w.w, unnest(f.emb) AS x, generate_subscripts(f.emb, 1) AS dim FROM w JOIN frames f ON w.doc = f.doc AND w.fidx = f.fidx) GROUP BY ALL) GROUP BY k)
        SELECT k::BIGINT AS k, {SHAPE} FROM u""",
)
def _(t):
    words, posteriors, table = mixture(t)
    return MX.update_means(words, t.frames(), posteriors, table).select("k", *shape())


ALIGN = f"""{mixture_rounds(1)}, nul AS (SELECT k, avg(p) AS p FROM g2 GROUP BY k),
    spot AS (SELECT dw.doc, dw.first AS idx, dw.n, g.k, g.p FROM dw JOIN g2 g ON dw.word = g.word UNION ALL SELECT d.doc, -1, 1, nul.k, nul.p FROM (SELECT DISTINCT doc FROM dw) d, nul),
    al AS (SELECT s.doc, f.fidx, s.idx, any_value(s.n) AS n, sum(s.p * f.p) AS score FROM spot s JOIN posteriors f ON s.doc = f.doc AND s.k = f.k GROUP BY s.doc, f.fidx, s.idx)"""


@query(
    "em19_mixture_align",
    f"""WITH {ALIGN} SELECT doc, fidx, idx AS aligned, round(score, 6) AS score, round(score / total, 6) AS share FROM (SELECT *, sum(n * score) OVER (PARTITION BY doc, fidx) AS total,
        row_number() OVER (PARTITION BY doc, fidx ORDER BY round(score, 9) DESC, idx) AS r FROM al) WHERE r = 1""",
)
def _(t):
    return _rounded(MX.mixture_align(*mixture(t)))


@query(
    "em20_doc_pair_score",
    f"""WITH {mixture_rounds(1)}, nul AS (SELECT k, avg(p) AS p FROM g2 GROUP BY k),
        ta AS (SELECT b.doc, b.k, ln(greatest(b.p, nul.p)) AS v FROM (SELECT dw.doc, g.k, max(g.p) AS p FROM dw JOIN g2 g ON dw.word = g.word GROUP BY ALL) b JOIN nul ON b.k = nul.k),
        tb AS (SELECT doc, k, count(*) AS v FROM (SELECT doc, fidx, k, row_number() OVER (PARTITION BY doc, fidx ORDER BY p DESC, k) AS r FROM posteriors) WHERE r = 1 GROUP BY ALL),
        sc AS (SELECT ta.doc AS q, tb.doc AS g, sum(ta.v * tb.v) AS score FROM ta JOIN tb ON ta.k = tb.k GROUP BY ALL)
        SELECT q, g, round(score, 5) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, g) AS r FROM sc) WHERE r <= 10""",
)
def _(t):
    text, video = MX.doc_pair_vectors(*mixture(t))
    top = R.retrieve_topk(text.withColumnRenamed("doc", "q"), video.withColumnRenamed("doc", "g"), 10, block=64)
    return top.select("q", "g", F.round("score", 5).alias("score"), "rank")


HEAD_ROWS = f"hr AS (SELECT doc, idx, {SOFT} AS p FROM (SELECT doc, idx, list_transform(emb[1:8], lambda x: 4 * x) AS emb FROM vectors))"
SKL = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (ln(z[1]) - ln(z[2]))))"
UNIFORM = "list_transform(range(8), lambda i: 0.125::DOUBLE)"


def _alignment_rows(t):
    head = F.transform(F.slice("emb", 1, 8), lambda x: 4 * x)
    return t.vectors().select("doc", "idx", V.softmax(head).alias("p"))


@query(
    "em21_kl_antecedents",
    f"""WITH {HEAD_ROWS}, c AS (SELECT b.doc, b.idx, a.idx AS i, {SKL.format('a.p', 'b.p')} AS gap FROM hr a JOIN hr b ON a.doc = b.doc AND a.idx < b.idx
        UNION ALL SELECT doc, idx, -1, {SKL.format('p', UNIFORM)} FROM hr) SELECT doc, idx, i AS antecedent FROM (SELECT *, row_number() OVER (PARTITION BY doc, idx ORDER BY round(gap, 9), i) AS r FROM c) WHERE r = 1""",
)
def _(t):
    return MX.kl_antecedents(_alignment_rows(t))


@query(
    "em22_kl_pair_labels",
    f"""WITH {HEAD_ROWS} SELECT a.doc, a.idx AS i, b.idx AS j, ({SKL.format('a.p', 'b.p')} < {SKL.format('a.p', UNIFORM)} + {SKL.format('b.p', UNIFORM)})::BIGINT AS y
        FROM hr a JOIN hr b ON a.doc = b.doc AND a.idx < b.idx JOIN mentions ma ON ma.doc = a.doc AND ma.idx = a.idx JOIN mentions mb ON mb.doc = b.doc AND mb.idx = b.idx AND mb.lemma = ma.lemma""",
)
def _(t):
    uniform = F.array_repeat(F.lit(0.125), 8)
    rows = _alignment_rows(t).withColumn("null", V.symmetric_kl(F.col("p"), uniform))
    named = rows.join(t.mentions().select("doc", "idx", "lemma"), ["doc", "idx"])
    return MX.kl_pair_labels(P.mention_pairs(named, ["doc", "lemma"], ["p", "null"])).select("doc", "i", "j", "y")


GRAPH = """ev AS (SELECT m.doc, m.idx, m.type_name AS word, coalesce(a.args, []) AS args FROM mentions m LEFT JOIN (SELECT doc, e_idx, list(entity_type ORDER BY entity_type) AS args FROM arguments GROUP BY ALL) a
      ON m.doc = a.doc AND m.idx = a.e_idx WHERE m.kind = 'event'),
    ac AS (SELECT s.doc, s.seg, s.label, list(o.label ORDER BY o.seg) AS objects FROM segments s JOIN segments o ON s.doc = o.doc AND o.seg BETWEEN s.seg + 1 AND s.seg + 2 GROUP BY ALL),
    pa AS (SELECT word, label, c / sum(c) OVER (PARTITION BY word) AS p FROM (SELECT e.word, s.label, sum(e.n * s.n) AS c FROM (SELECT doc, type_name AS word, count(*) AS n FROM mentions WHERE kind = 'event' GROUP BY ALL) e
      JOIN (SELECT doc, label, count(*) AS n FROM segments GROUP BY ALL) s ON e.doc = s.doc GROUP BY ALL)),
    po AS (SELECT argument, object, c / sum(c) OVER (PARTITION BY argument) AS p FROM (SELECT e.argument, s.label AS object, sum(e.n * s.n) AS c FROM (SELECT doc, entity_type AS argument, count(*) AS n FROM arguments GROUP BY ALL) e
      JOIN (SELECT doc, label, count(*) AS n FROM segments GROUP BY ALL) s ON e.doc = s.doc GROUP BY ALL)),
    om AS (SELECT x.doc, x.idx, o.object, avg(po.p) AS m FROM (SELECT doc, idx, unnest(args) AS argument FROM ev) x JOIN po ON po.argument = x.argument JOIN (SELECT DISTINCT label AS object FROM segments) o ON o.object = po.object GROUP BY ALL),
    sc AS (SELECT ev.doc, ev.idx, ac.seg, pa.p * CASE WHEN len(ev.args) = 0 THEN 1 ELSE (SELECT m FROM om WHERE om.doc = ev.doc AND om.idx = ev.idx AND om.object = ac.objects[1])
      * CASE WHEN len(ac.objects) = 2 THEN (SELECT m FROM om WHERE om.doc = ev.doc AND om.idx = ev.idx AND om.object = ac.objects[2]) ELSE 1 END END AS score
      FROM ev JOIN ac ON ev.doc = ac.doc JOIN pa ON pa.word = ev.word AND pa.label = ac.label)"""


def _conditional(left, right, a, b):
    """P(b | a) from how often both occur in a document."""
    counts = left.groupBy("doc", a).agg(F.count("*").alias("_n")).join(right.groupBy("doc", b).agg(F.count("*").alias("_m")), "doc")
    table = counts.groupBy(a, b).agg(F.sum(F.col("_n") * F.col("_m")).alias("_c"))
    totals = table.groupBy(a).agg(F.sum("_c").alias("_t"))
    return table.join(totals, a).select(a, b, (F.col("_c") / F.col("_t")).alias("p"))


@query(
    "em23_graph_alignment",
    f"""WITH {GRAPH} SELECT e.doc, e.idx, CASE WHEN b.score > 0.008 THEN b.seg ELSE -1 END AS aligned, round(CASE WHEN b.score > 0.008 THEN b.score ELSE 0.008 END, 6) AS score FROM ev e
        LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, idx ORDER BY round(score, 12) DESC, seg) AS r FROM sc) WHERE r = 1) b ON e.doc = b.doc AND e.idx = b.idx""",
)
def _(t):
    events = t.mentions().filter("kind = 'event'").select("doc", "idx", F.col("type_name").alias("word"))
    listed = t.arguments().groupBy("doc", F.col("e_idx").alias("idx")).agg(F.array_sort(F.collect_list("entity_type")).alias("args"))
    events = events.join(listed, ["doc", "idx"], "left").withColumn("args", F.coalesce("args", F.array().cast("array<string>")))
    segs = t.segments().select("doc", "seg", "label")
    later = segs.select("doc", F.explode(F.array(F.col("seg") - 1, F.col("seg") - 2)).alias("seg"), F.struct(F.col("seg").alias("s"), "label").alias("_o"))
    actions = segs.join(later.groupBy("doc", "seg").agg(F.array_sort(F.collect_list("_o")).alias("_o")), ["doc", "seg"])
    actions = actions.select("doc", "seg", "label", F.transform("_o", lambda o: o["label"]).alias("objects"))
    p_action = _conditional(events, segs, "word", "label").withColumn("p", F.col("p"))
    p_object = _conditional(t.arguments().withColumnRenamed("entity_type", "argument"), segs.withColumnRenamed("label", "object"), "argument", "object")
    return _rounded(MX.graph_alignment(events, actions, p_action, p_object, 0.008))


FAMILY = "CASE WHEN substr(tag, 1, 2) IN ('NN', 'VB', 'PR') THEN 'core' ELSE substr(tag, 1, 2) END"


def similar_rounds(rounds: int) -> str:
    views = [f"""sm AS (SELECT *, {FAMILY} AS family, min(idx) OVER (PARTITION BY doc, tok) < idx AS exact FROM mention_vectors),
        sc AS (SELECT 'exact' AS mode, b.doc, b.idx AS j, b.tok AS tgt, a.tok AS src, count(*)::DOUBLE AS n FROM sm a JOIN sm b ON a.doc = b.doc AND a.tok = b.tok AND a.idx < b.idx GROUP BY ALL
          UNION ALL SELECT 'similar', b.doc, b.idx, b.tok, a.tok, sum({COSINE.format('a.emb', 'b.emb')}) FROM sm a JOIN sm b ON a.doc = b.doc AND a.family = b.family AND a.idx < b.idx WHERE NOT b.exact GROUP BY ALL
          UNION ALL SELECT 'similar', doc, idx, tok, '###NEW###', 1 FROM sm WHERE NOT exact),
        s0 AS (SELECT DISTINCT mode, src, tgt, CASE WHEN mode = 'exact' THEN 1 ELSE 1 / (SELECT count(DISTINCT tok) FROM mentions) END AS p FROM sc)"""]
    for r in range(rounds):
        views.append(f"""s{r + 1} AS (SELECT mode, src, tgt, c AS count, c / sum(c) OVER (PARTITION BY mode, src) AS p FROM (SELECT mode, src, tgt, sum(post) AS c FROM (
            SELECT c.*, n * q / sum(n * q) OVER (PARTITION BY doc, j) AS post FROM (SELECT c.*, CASE WHEN c.mode = 'exact' THEN 1 ELSE t.p END AS q FROM sc c JOIN s{r} t ON c.mode = t.mode AND c.src = t.src AND c.tgt = t.tgt) c) GROUP BY ALL))""")
    return ", ".join(views)


@query("em24_exact_or_similarity_em", f"WITH {similar_rounds(2)} SELECT mode, src, tgt, round(count, 6) AS count, round(p, 6) AS p FROM s2")
def _(t):
    head = F.substring("tag", 1, 2)
    rows = t.mention_vectors().withColumn("family", F.when(head.isin("NN", "VB", "PR"), "core").otherwise(head))
    cand = T.similarity_candidates(rows, ["doc", "family"], block=64)
    return _rounded(T.fit_exact_or_similar(cand, T.vocab_sizes(t.mentions(), "tok")["text"], 2).select("mode", "src", "tgt", "count", "p"))
