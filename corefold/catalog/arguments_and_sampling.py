"""Queries on event arguments, the samplers and the pair classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from corefold.catalog.counts_and_scores import _rounded
from corefold.catalog.estimators import _conditional  # noqa: F401
from corefold.catalog.pairs_and_media import unit_vectors
from corefold.catalog.registry import query
from corefold.functions import text as X
from corefold.operators import pairs as P
from corefold.operators import spans as S
from corefold.plans import arguments as A
from corefold.plans import restaurants as R
from corefold.plans import sampling as G
from corefold.plans import translation as T
from corefold.session import cut_lineage

SLOTS = """rl AS (SELECT DISTINCT e_type, role FROM arguments), vl AS (SELECT doc, e_idx, role, arg_max(a_lemma, a_start) AS v FROM arguments GROUP BY ALL),
    slots AS (SELECT m.doc, m.idx AS e_idx, r.role, m.lemma AS trigger, l.v AS value FROM mentions m JOIN rl r ON m.type_name = r.e_type
      LEFT JOIN vl l ON l.doc = m.doc AND l.e_idx = m.idx AND l.role = r.role WHERE m.kind = 'event'),
    kv AS (SELECT doc, e_idx, value, count(*) AS own FROM slots WHERE value IS NOT NULL GROUP BY ALL),
    fnd AS (SELECT s.doc, s.e_idx, s.role, s.trigger, k.value, sum(k.own)::DOUBLE AS n, min(k.e_idx) AS first FROM slots s JOIN kv k ON s.doc = k.doc AND k.e_idx <> s.e_idx WHERE s.value IS NULL GROUP BY ALL),
    ic AS (SELECT * FROM fnd UNION ALL SELECT doc, e_idx, role, trigger, value, 1, -1 FROM slots WHERE value IS NOT NULL
      UNION ALL SELECT doc, e_idx, role, trigger, '###NULL###', 1, -1 FROM slots s WHERE value IS NULL AND NOT EXISTS (SELECT 1 FROM fnd f WHERE f.doc = s.doc AND f.e_idx = s.e_idx AND f.role = s.role)),
    i0 AS (SELECT DISTINCT role, trigger, value, 1 / (SELECT count(DISTINCT coalesce(value, '###NULL###')) FROM slots) AS p FROM ic)"""


def impute_rounds(rounds: int) -> str:
    views = [SLOTS]
    for r in range(rounds):
        views.append(f"""i{r + 1} AS (SELECT role, trigger, value, c AS count, c / sum(c) OVER (PARTITION BY role, trigger) AS p FROM (SELECT role, trigger, value, sum(post) AS c FROM (
            SELECT ic.*, n * p / sum(n * p) OVER (PARTITION BY doc, e_idx, ic.role) AS post FROM ic JOIN i{r} i ON ic.role = i.role AND ic.trigger = i.trigger AND ic.value = i.value) GROUP BY ALL))""")
    return ", ".join(views)


def slots(t):
    events = t.mentions().filter("kind = 'event'").select("doc", F.col("idx").alias("e_idx"), F.col("type_name").alias("e_type"), F.col("lemma").alias("trigger"))
    dense = S.densify_roles(t.arguments(), events)
    return dense.select("doc", "e_idx", "role", "trigger", F.when(F.col("value") != X.NULL_TEXT, F.col("value")).alias("value"))


@query("em25_imputation_table", f"WITH {impute_rounds(2)} SELECT role, trigger, value, round(count, 6) AS count, round(p, 6) AS p FROM i2")
def _(t):
    table = A.fit_imputer(slots(t), 2).translation
    return _rounded(table.select(F.col("mode").alias("role"), F.col("src").alias("trigger"), F.col("tgt").alias("value"), "count", "p"))


@query(
    "em25_impute_arguments",
    f"""WITH {impute_rounds(2)} SELECT doc, e_idx, role, value FROM (SELECT ic.doc, ic.e_idx, ic.role, ic.value, row_number() OVER (PARTITION BY ic.doc, ic.e_idx, ic.role ORDER BY round(i.p, 12) DESC, ic.first, ic.value) AS r
        FROM ic JOIN i2 i ON ic.role = i.role AND ic.trigger = i.trigger AND ic.value = i.value) WHERE r = 1""",
)
def _(t):
    return A.impute_arguments(A.fit_imputer(slots(t), 2))


CONDITIONAL = """ac AS (SELECT entity_type, e_lemma AS trigger, a_lemma AS arg, count(*) AS c FROM arguments GROUP BY ALL),
    au AS (SELECT * FROM ac UNION ALL SELECT DISTINCT entity_type, trigger, '###UNK###', 1 FROM ac UNION ALL SELECT entity_type, '###NULL###', arg, sum(c) FROM ac GROUP BY ALL),
    cond AS (SELECT entity_type, trigger, arg, c / sum(c) OVER (PARTITION BY entity_type, trigger) AS p FROM au)"""


@query("em26_argument_conditional", f"WITH {CONDITIONAL} SELECT entity_type, trigger, arg, round(p, 6) AS p FROM cond")
def _(t):
    return _rounded(A.argument_conditional(t.arguments()))


ENTITY_EM = """ecand AS (SELECT b.doc, b.idx AS j, b.lemma AS tgt, a.lemma AS src, count(*)::DOUBLE AS n, min(a.idx) AS first FROM mentions a JOIN mentions b
      ON a.doc = b.doc AND a.type = b.type AND a.idx < b.idx AND a.kind = 'entity' AND b.kind = 'entity' GROUP BY ALL UNION ALL SELECT doc, idx, lemma, '###NEW###', 1, -1 FROM mentions WHERE kind = 'entity'),
    ep AS (SELECT src, tgt, c / sum(c) OVER (PARTITION BY src) AS p FROM (SELECT src, tgt, sum(n / t) AS c FROM (SELECT *, sum(n) OVER (PARTITION BY doc, j) AS t FROM ecand) GROUP BY ALL))"""


@query(
    "em27_argument_pair_prob",
    f"""WITH {CONDITIONAL}, {ENTITY_EM}, pr AS (SELECT a.doc, a.idx AS i, b.idx AS j, a.lemma AS trigger FROM mentions a JOIN mentions b ON a.doc = b.doc AND a.lemma = b.lemma AND a.kind = 'event' AND b.kind = 'event' AND a.idx < b.idx),
        w AS (SELECT pr.*, g.a_idx, g.entity_type, g.a_lemma AS tgt FROM pr JOIN arguments g ON g.doc = pr.doc AND g.e_idx = pr.j),
        m AS (SELECT w.doc, w.i, w.j, w.a_idx, w.entity_type, w.tgt, w.trigger, count(f.a_idx) AS met, max(ep.p) AS best FROM w LEFT JOIN arguments f ON f.doc = w.doc AND f.e_idx = w.i AND f.entity_type = w.entity_type
          LEFT JOIN ep ON ep.src = f.a_lemma AND ep.tgt = w.tgt GROUP BY ALL),
        f AS (SELECT m.doc, m.i, m.j, CASE WHEN met > 0 THEN coalesce(best, nu.p, 1e-100) WHEN EXISTS (SELECT 1 FROM cond c WHERE c.entity_type = m.entity_type AND c.trigger = m.trigger)
          THEN coalesce(ce.p, cu.p) ELSE coalesce(nu.p, 1e-100) END AS p FROM m LEFT JOIN ep nu ON nu.src = '###NEW###' AND nu.tgt = m.tgt
          LEFT JOIN cond ce ON ce.entity_type = m.entity_type AND ce.trigger = m.trigger AND ce.arg = m.tgt LEFT JOIN cond cu ON cu.entity_type = m.entity_type AND cu.trigger = m.trigger AND cu.arg = '###UNK###')
        SELECT pr.doc, pr.i, pr.j, round(coalesce(exp(x.l), 1), 9) AS arg_prob FROM pr LEFT JOIN (SELECT doc, i, j, sum(ln(p)) AS l FROM f GROUP BY ALL) x ON x.doc = pr.doc AND x.i = pr.i AND x.j = pr.j""",
)
def _(t):
    entities = t.mentions().filter("kind = 'entity'")
    model = T.fit(T.text_candidates(entities, ["doc", "type"]), T.vocab_sizes(entities), 1)
    pairs = P.mention_pairs(t.mentions().filter("kind = 'event'"), ["doc", "lemma"]).withColumn("a_lemma", F.col("lemma"))
    found = A.argument_pair_prob(pairs, t.arguments(), A.argument_conditional(t.arguments()), model.translation)
    return found.select("doc", "i", "j", F.round("arg_prob", 9).alias("arg_prob"))


JOINT = f"""WITH RECURSIVE {ENTITY_EM}, el AS (SELECT doc, j AS idx, first FROM (SELECT c.doc, c.j, c.first, row_number() OVER (PARTITION BY c.doc, c.j ORDER BY round(p.p, 12) DESC, c.first) AS r
      FROM ecand c JOIN ep p ON c.src = p.src AND c.tgt = p.tgt) WHERE r = 1),
    rt AS (SELECT doc, idx, idx AS root FROM el WHERE first = -1 UNION ALL SELECT el.doc, el.idx, rt.root FROM el JOIN rt ON el.doc = rt.doc AND el.first = rt.idx),
    held AS (SELECT DISTINCT a.doc, a.e_idx, rt.root AS c FROM arguments a JOIN rt ON a.doc = rt.doc AND a.a_idx = rt.idx WHERE a.entity_type = 'Person'),
    pr AS (SELECT a.doc, a.idx AS i, b.idx AS j, a.lemma AS src, b.lemma AS tgt FROM mentions a JOIN mentions b ON a.doc = b.doc AND a.type = b.type AND a.kind = 'event' AND b.kind = 'event' AND a.idx < b.idx),
    refused AS (SELECT DISTINCT pr.doc, pr.i, pr.j FROM pr JOIN held h ON h.doc = pr.doc AND h.e_idx = pr.j WHERE EXISTS (SELECT 1 FROM held x WHERE x.doc = pr.doc AND x.e_idx = pr.i)
      AND NOT EXISTS (SELECT 1 FROM held x WHERE x.doc = pr.doc AND x.e_idx = pr.i AND x.c = h.c)),
    vcand AS (SELECT doc, j, tgt, src, count(*)::DOUBLE AS n, min(i) AS first FROM pr WHERE NOT EXISTS (SELECT 1 FROM refused r WHERE r.doc = pr.doc AND r.i = pr.i AND r.j = pr.j) GROUP BY ALL
      UNION ALL SELECT doc, idx, lemma, '###NEW###', 1, -1 FROM mentions WHERE kind = 'event'),
    vp AS (SELECT src, tgt, c / sum(c) OVER (PARTITION BY src) AS p FROM (SELECT src, tgt, sum(n / t) AS c FROM (SELECT *, sum(n) OVER (PARTITION BY doc, j) AS t FROM vcand) GROUP BY ALL))
    SELECT doc, j AS idx, first AS antecedent FROM (SELECT c.*, row_number() OVER (PARTITION BY c.doc, c.j ORDER BY round(p.p, 12) DESC, c.first) AS r FROM vcand c JOIN vp p ON c.src = p.src AND c.tgt = p.tgt) WHERE r = 1"""


@query("em28_joint_pipeline", JOINT)
def _(t):
    m = t.mentions()
    links = A.joint_pipeline(m.filter("kind = 'entity'"), m.filter("kind = 'event'"), t.arguments(), 1)
    return links.select("doc", "idx", "antecedent")


FEATURES = ["lemma", "mtype", "type_name"]
COUNTS = """asg AS (SELECT lemma, mtype, type_name, idx % 7 AS tbl FROM mentions), mel AS (UNPIVOT asg ON lemma, mtype, type_name INTO NAME feature VALUE value),
    tc AS (SELECT *, sum(n) OVER (PARTITION BY tbl, feature) AS total FROM (SELECT tbl, feature, value, count(*) AS n FROM mel GROUP BY ALL)),
    sz AS (SELECT feature, count(DISTINCT value) AS v FROM mel GROUP BY ALL)"""


def feature_sizes(t):
    row = t.mentions().select(*[F.countDistinct(f).alias(f) for f in FEATURES]).first()
    return {f: row[f] for f in FEATURES}


def _assigned(t):
    return t.mentions().withColumn("table", F.col("idx") % 7)


@query("em29_table_counts", f"WITH {COUNTS} SELECT tbl AS \"table\", tc.feature, value, n, total::BIGINT AS total, round((n + 0.5 / v) / (total + 0.5), 6) AS p FROM tc JOIN sz ON tc.feature = sz.feature")
def _(t):
    return _rounded(G.predictive(G.table_counts(_assigned(t), FEATURES), 0.5, feature_sizes(t)))


@query(
    "em30_table_log_likelihood",
    f"""WITH {COUNTS} SELECT a.feature, round(a.x - b.x, 5) AS log_likelihood FROM (SELECT tc.feature, sum(lgamma(n + 0.5 / v) - lgamma(0.5 / v)) AS x FROM tc JOIN sz ON tc.feature = sz.feature GROUP BY ALL) a
        JOIN (SELECT feature, sum(lgamma(total + 0.5) - lgamma(0.5)) AS x FROM (SELECT DISTINCT tbl, feature, total FROM tc) GROUP BY ALL) b ON a.feature = b.feature""",
)
def _(t):
    found = G.table_log_likelihood(G.table_counts(_assigned(t), FEATURES), 0.5, feature_sizes(t))
    return found.select("feature", F.round("log_likelihood", 5).alias("log_likelihood"))


@query("em31_parallel_cluster_sweep")
def _(t):
    drawn = G.parallel_cluster_sweeps(t.mentions(), FEATURES, feature_sizes(t), tables=50, sweeps=2)
    return drawn.select("doc", "idx", "table")


# Events of equal trigger and most common argument share a table; every signature (trigger, arguments) against every table.
SEATS = """ev AS (SELECT m.doc, m.idx, m.lemma AS trigger, coalesce(a.args, []) AS args FROM mentions m LEFT JOIN (SELECT doc, e_idx, list(a_lemma ORDER BY a_lemma) AS args FROM arguments GROUP BY ALL) a
      ON m.doc = a.doc AND m.idx = a.e_idx WHERE m.kind = 'event'),
    sg AS (SELECT *, row_number() OVER () AS s FROM (SELECT DISTINCT trigger, args FROM ev)), sv AS (SELECT s, value, count(*) AS mu FROM (SELECT s, unnest(args) AS value FROM sg) GROUP BY ALL),
    hd AS (SELECT s, arg_max(value, {'n': n, 'v': value}) AS head FROM (SELECT s, value, sum(mu) OVER (PARTITION BY value) AS n FROM sv) GROUP BY s),
    sh AS (SELECT sg.s, sg.trigger, len(args) AS m, coalesce(head, '') AS head, k FROM sg LEFT JOIN hd USING (s) JOIN (SELECT trigger, args, count(*) AS k FROM ev GROUP BY ALL) USING (trigger, args)),
    tb AS (SELECT trigger, head, sum(k)::DOUBLE AS n, sum(k * m)::DOUBLE AS na FROM sh GROUP BY ALL),
    tv AS (SELECT sh.trigger, sh.head, sv.value, sum(k * mu)::DOUBLE AS n FROM sh JOIN sv USING (s) GROUP BY ALL),
    pq AS (SELECT 1 / (SELECT count(DISTINCT trigger) FROM sg)::DOUBLE AS p, 1 / (SELECT count(DISTINCT value) FROM sv)::DOUBLE AS q)"""


def seated_events(t):
    events = t.mentions().filter("kind = 'event'").select("doc", "idx", F.col("lemma").alias("trigger"))
    listed = t.arguments().groupBy("doc", F.col("e_idx").alias("idx")).agg(F.array_sort(F.collect_list("a_lemma")).alias("args"))
    return events.join(listed, ["doc", "idx"], "left")


@query(
    "em31_unbounded_start",
    f"""WITH {SEATS} SELECT (SELECT count(*) FROM tb)::BIGINT AS tables, round(lgamma(1) - lgamma(1 + sum(n)) + sum(lgamma(n)) + (SELECT sum(
          lgamma(c * (k + 1)) - lgamma(c * (k + 1) + t) + v) FROM (
            SELECT p AS c, 1 AS k, n AS t, lgamma(n + p) - lgamma(p) + ln(p) AS v FROM tb, pq
            UNION ALL SELECT any_value(q), count(*), sum(n), sum(lgamma(n + q) - lgamma(q) + ln(q)) FROM tv, pq GROUP BY trigger, head)), 3) AS log_likelihood FROM tb""",
)
def _(t):
    named = R.signed(seated_events(t))
    model = R.seating(named, 1.0)
    found = R.log_likelihood(R.counts_of(R.start(named, model), model), model)
    return found.select("tables", F.round("log_likelihood", 3).alias("log_likelihood"))


@query(
    "em31_unbounded_conditionals",
    f"""WITH {SEATS}, ov AS (SELECT sv.s, tv.trigger, tv.head, sum(mu * ln(1 + n / q)) AS g FROM sv JOIN tv USING (value), pq GROUP BY ALL),
        w AS (SELECT sh.s, ln(tb.n) - ln(1 + tb.n) - m * ln(1 + tb.na) + CASE WHEN sh.trigger = tb.trigger THEN ln(1 + tb.n / p) ELSE 0 END + coalesce(ov.g, 0) AS w
          FROM sh, pq, tb LEFT JOIN ov ON ov.s = sh.s AND ov.trigger = tb.trigger AND ov.head = tb.head),
        b AS (SELECT s, max(w) + ln(sum(exp(w - x))) AS total, max(w) AS best FROM (SELECT *, max(w) OVER (PARTITION BY s) AS x FROM w) GROUP BY s)
        SELECT ev.doc, ev.idx, round(b.total, 6) AS log_mass, round(exp(best - total), 6) AS share FROM ev JOIN sg USING (trigger, args) JOIN b USING (s)""",
)
def _(t):
    events = seated_events(t)
    named = R.signed(events)
    model = R.seating(named, 1.0)
    counts = R.counts_of(R.start(named, model), model)
    base = R.base_weights(counts, model)
    gains = R.argument_gains(counts, model, base)
    masses = R.parts(model, base, R.trigger_gains(counts, model, base), gains)
    mass = F.ln(F.col("base") + F.col("by_trigger") + F.col("by_argument")) + F.col("scale")
    best = R.best_tables(events, counts, model, gains)
    return _rounded(named.select("doc", "idx", "sig").join(masses.select("sig", mass.alias("log_mass")), "sig").join(best.drop("table"), ["doc", "idx"]).drop("sig"))


UNBOUNDED_SWEEPS = 10  # the usual number is 35; a sweep is about 6 s on a small box


@query("em31_unbounded_sweeps")
def _(t):
    """Tables with their sizes and commonest trigger after the sweeps, and the number
    of tables and the likelihood of each sweep."""
    found = R.sample(seated_events(t), sweeps=UNBOUNDED_SWEEPS)
    top = found.counts.values.filter("kind = 't'").groupBy("table").agg(F.max(F.struct("n", "value"))["value"].alias("trigger"))
    tables = found.counts.tables.join(top, "table").select(F.lit("table").alias("row"), F.col("table").alias("number"), "n", "trigger", F.lit(None).cast("double").alias("log_likelihood"))
    trace = t.spark.createDataFrame([("sweep", s, n, None, round(ll, 3)) for s, n, ll in found.trace], tables.schema)
    return tables.unionByName(trace)


@query("em32_link_sweep")
def _(t):
    mentions = cut_lineage(unit_vectors(t))
    pairs = cut_lineage(G.pair_rows(mentions, ["doc", "type"], "cluster"))
    model = G.pair_classifier(cut_lineage(G.training_pairs(mentions, ["doc", "type"], "cluster")))
    return G.link_sweep(mentions.drop("emb"), G.score_pairs(model, pairs), FEATURES, feature_sizes(t), 0.5, 0.2, 0, 1234)


def _uniform(*parts: str) -> str:
    text = " || '|' || ".join(parts)
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296"


def _label_draw(sweep: int, counts: str) -> str:
    """The label each word draws in a sweep, given the counts of the one before."""
    u = _uniform("w.doc", "w.idx", "pl.label", f"'label|{sweep}|1234'")
    joined = f"LEFT JOIN n{sweep - 1} n ON n.word = w.lemma AND n.label = pl.label LEFT JOIN u{sweep - 1} t ON t.word = w.lemma" if counts else ""
    n, total = ("coalesce(n.n, 0)", "coalesce(t.t, 0)") if counts else ("0", "0")
    return f"""b{sweep} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, idx ORDER BY s DESC) AS r FROM (SELECT w.doc, w.idx, w.lemma AS word, pl.label, pl.m,
        ln(pl.m * ({n} + 0.2::DOUBLE) / ({total} + 1.0::DOUBLE)) - ln(-ln({u})) AS s FROM mentions w JOIN pl ON w.doc = pl.doc {joined})) WHERE r = 1),
        n{sweep} AS (SELECT word, label, count(*) AS n FROM b{sweep} GROUP BY ALL), u{sweep} AS (SELECT word, sum(n) AS t FROM n{sweep} GROUP BY word)"""


@query(
    "em33_alignment_sweep",
    f"""WITH pl AS (SELECT doc, label, count(*) AS m FROM segments GROUP BY ALL), {_label_draw(0, '')}, {_label_draw(1, 'n0')},
        sn AS (SELECT doc, label, seg, row_number() OVER (PARTITION BY doc, label ORDER BY seg) - 1 AS place FROM segments)
        SELECT b.doc, b.idx, b.label, sn.seg FROM b1 b JOIN sn ON sn.doc = b.doc AND sn.label = b.label AND sn.place = floor({_uniform('b.doc', 'b.idx', "'place|1|1234'")} * b.m)""",
)
def _(t):
    words = t.mentions().select("doc", "idx", F.col("lemma").alias("word"))
    return G.alignment_sweeps(words, t.segments().select("doc", "seg", "label"), 5, 1.0, 2, 1234).select("doc", "idx", "label", "seg")


@query("em34_pair_classifier")
def _(t):
    """Fitted on all positive and a weighted sample of the negative pairs, applied to all."""
    mentions = cut_lineage(unit_vectors(t))
    model = G.pair_classifier(cut_lineage(G.training_pairs(mentions, ["doc", "type"], "cluster")))
    return G.score_pairs(model, G.pair_rows(mentions, ["doc", "type"], "cluster")).select("doc", "i", "j", "label", F.round("score", 4).alias("score"))


@query(
    "em35_sample_negative_pairs",
    f"""WITH s AS (SELECT doc, type, 1 / least(1, 20 * sum(CASE WHEN cluster <> 0 THEN n * (n - 1) ELSE 0 END) / (sum(n) * (sum(n) - 1))::DOUBLE) AS w FROM (
         SELECT doc, type, cluster, count(*) AS n FROM mentions GROUP BY ALL) GROUP BY doc, type HAVING sum(CASE WHEN cluster <> 0 THEN n * (n - 1) ELSE 0 END) > 0),
       m AS (SELECT m.doc, m.type, m.idx, m.cluster, s.w, row_number() OVER (PARTITION BY m.doc, m.type ORDER BY idx) - 1 AS r FROM mentions m JOIN s ON s.doc = m.doc AND s.type = m.type),
       g AS (SELECT doc, type, w, floor((k + {_uniform('doc', 'type', 'k', "'1234'")}) * w)::BIGINT AS number FROM (
         SELECT doc, type, w, unnest(generate_series(0, floor((n * (n - 1) // 2) / w)::BIGINT)) AS k FROM (SELECT doc, type, w, count(*) AS n FROM m GROUP BY ALL) WHERE n > 1)),
       p AS (SELECT a.doc, a.idx AS i, b.idx AS j, a.cluster = b.cluster AND a.cluster <> 0 AS y, a.w, EXISTS (SELECT 1 FROM g WHERE g.doc = a.doc AND g.type = a.type AND g.number = b.r * (b.r - 1) // 2 + a.r) AS drawn
         FROM m a JOIN m b ON a.doc = b.doc AND a.type = b.type AND a.idx < b.idx)
       SELECT doc, i, j, y::BIGINT AS y, round(CASE WHEN y THEN 1 ELSE w END, 6) AS weight FROM p WHERE y OR drawn""",
)
def _(t):
    return _rounded(G.sample_negative_pairs(t.mentions(), ["doc", "type"]))
