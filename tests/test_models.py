"""Estimators against plain-Python loops over pairs, and their invariants."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corefold.functions import vectors as V
from corefold.operators import media as M
from corefold.operators import pairs as P
from corefold.operators import ranking as R
from corefold.operators import spans as S
from corefold.plans import mixture as MX
from corefold.plans import sampling as G
from corefold.plans import translation as T


def mentions(spark, docs=3, n=70, seed=0):
    rng = random.Random(seed)
    rows = [
        (d, i, i // 5, 2 * i, 2 * i, rng.choice("pqrst"), rng.randint(0, 1), rng.choice(["NN", "PRP", "NNS"]))
        for d in range(docs) for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "doc long, idx long, sent long, m_start long, m_end long, lemma string, type long, tag string")


def brute_em(rows, rounds):
    vocab = len({r[5] for r in rows})
    p = defaultdict(lambda: 1 / vocab)
    for _ in range(rounds):
        counts = defaultdict(float)
        for b in rows:
            cand = [("###NEW###", p["###NEW###", b[5]])]
            cand += [(a[5], p[a[5], b[5]]) for a in rows if a[0] == b[0] and a[6] == b[6] and a[1] < b[1]]
            total = sum(w for _, w in cand)
            for src, w in cand:
                counts[src, b[5]] += w / total
        sums = defaultdict(float)
        for (src, _), c in counts.items():
            sums[src] += c
        p = defaultdict(float, {k: c / sums[k[0]] for k, c in counts.items()})
    return p


@pytest.mark.parametrize("block", [1, 7, 256])
def test_word_candidates_equal_pairs_for_any_block(spark, block):
    rows, df = mentions(spark)
    got = {(r["doc"], r["j"], r["src"]): (r["n"], r["first"]) for r in T.candidate_words(df, keys=["doc", "type"], block=block).collect()}
    want = defaultdict(list)
    for b in rows:
        for a in rows:
            if a[0] == b[0] and a[6] == b[6] and a[1] < b[1]:
                want[b[0], b[1], a[5]].append(a[1])
    assert got == {k: (float(len(v)), min(v)) for k, v in want.items()}


def test_em_equals_loops_and_likelihood_rises(spark):
    rows, df = mentions(spark, docs=2, n=30)
    model = T.fit(T.text_candidates(df, ["doc", "type"], block=8), T.vocab_sizes(df), 3, trace=True)
    want = brute_em(rows, 3)
    got = {(r["src"], r["tgt"]): r["p"] for r in model.translation.collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert all(b >= a - 1e-9 for a, b in zip(model.trace, model.trace[1:]))


def test_posteriors_sum_to_one_and_links_point_back(spark):
    _, df = mentions(spark)
    model = T.fit(T.text_candidates(df), T.vocab_sizes(df), 1)
    sums = model.posterior().groupBy("doc", "j").agg(F.sum("post").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in sums)
    links = T.predict_antecedents(model.candidates, model.translation).collect()
    assert len(links) == 210 and all(r["antecedent"] < r["idx"] for r in links)


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_pairs_are_complete_for_any_block(spark, block):
    rows, df = mentions(spark, docs=2, n=17)
    got = sorted((r["doc"], r["i"], r["j"]) for r in P.mention_pairs(df, block=block).collect())
    assert got == sorted((d, i, j) for d in range(2) for j in range(17) for i in range(j))
    other = df.select("doc", F.col("idx").alias("seg")).filter("seg < 11")
    assert P.mention_action_pairs(df.select("doc", "idx"), other, block=block).count() == 2 * 17 * 11


@pytest.mark.parametrize("width", [1, 5, 9])
def test_segments_fold_equals_doubling(spark, width):
    rng = random.Random(width)
    rows = [(d, s, rng.randint(0, 12)) for d in range(4) for s in range(40)] + [(9, s, n) for s, n in enumerate((0, 12, 3))]
    df = spark.createDataFrame(rows, "doc long, sent long, n long")
    fold = sorted(map(tuple, S.split_into_segments(df, width).select("doc", "sent", "seg", "oversize").collect()))
    jump = sorted(map(tuple, S.split_into_segments(df, width, fold_up_to=0).select("doc", "sent", "seg", "oversize").collect()))
    assert fold == jump


def test_char_spans_do_not_depend_on_the_bucket(spark):
    tokens = spark.createDataFrame(
        [(0, 0, i, w) for i, w in enumerate("ab cdefgh ij . klmnopqrstuvwxyz a".split())], "doc long, sent long, pos long, raw string"
    ).withColumn("tid", F.col("pos"))
    placed = S.char_offsets(tokens)
    spans = spark.createDataFrame([(k, 0, 0, k, k + 5) for k in range(28)], "m_id long, doc long, sent long, c_from long, c_to long")
    results = [sorted(map(tuple, S.char_to_token_span(spans, placed, b).select("m_id", "m_start", "m_end").collect())) for b in (1, 4, 64)]
    assert results[0] == results[1] == results[2]


def test_masked_view_of_a_mention(spark):
    tokens = spark.createDataFrame([(0, i, f"w{i}") for i in range(6)], "doc long, tid long, tok string")
    m = spark.createDataFrame([(0, 0, 1, 1, 0), (0, 1, 3, 3, 1)], "doc long, idx long, m_start long, m_end long, type long")
    view = S.mention_view(S.mask_mentions(tokens, m, "type"), m.filter("idx = 1"), "type")
    assert [r["tok"] for r in view.orderBy("tid").collect()] == ["w0", "<mask>", "w2", "<mask>", "<mask>", "<mask>"]


def test_retrieval_is_exact_for_any_block(spark):
    rng = random.Random(5)
    vec = lambda: [rng.gauss(0, 1) for _ in range(4)]
    a, b = [(i, vec()) for i in range(23)], [(i, vec()) for i in range(31)]
    q, g = spark.createDataFrame(a, "q long, emb array<double>"), spark.createDataFrame(b, "g long, emb array<double>")
    for block in (4, 100):
        got = {(r["q"], r["rank"]): r["g"] for r in R.retrieve_topk(q, g, 3, block).collect()}
        for i, v in a:
            order = sorted(b, key=lambda w: -sum(x * y for x, y in zip(v, w[1])))
            assert [got[i, r] for r in (1, 2, 3)] == [w[0] for w in order[:3]]


def test_log_gamma(spark):
    row = spark.range(1).select(*[V.log_gamma(F.lit(x)).alias(str(i)) for i, x in enumerate((0.001, 0.5, 1.0, 7.3, 1e6))]).first()
    assert all(row[i] == pytest.approx(math.lgamma(x), abs=1e-8, rel=1e-12) for i, x in enumerate((0.001, 0.5, 1.0, 7.3, 1e6)))


def test_gaussian_posterior_is_the_softmax_of_distances(spark):
    centers, var = [[0.0, 1.0], [2.0, -1.0], [0.5, 0.5]], 0.7
    x = [0.3, 0.2]
    got = spark.range(1).select(V.gaussian_posterior(F.array(*map(F.lit, x)), centers, var).alias("p")).first()["p"]
    raw = [math.exp(-sum((a - b) ** 2 for a, b in zip(x, c)) / (2 * var)) for c in centers]
    assert got == pytest.approx([r / sum(raw) for r in raw])


def test_sweeps_keep_every_mention_and_repeat(spark):
    _, df = mentions(spark, docs=2, n=25)
    one = G.parallel_cluster_sweeps(df, ["lemma", "tag"], {"lemma": 5, "tag": 3}, tables=6, sweeps=2).select("doc", "idx", "table")
    two = G.parallel_cluster_sweeps(df, ["lemma", "tag"], {"lemma": 5, "tag": 3}, tables=6, sweeps=2).select("doc", "idx", "table")
    rows = sorted(map(tuple, one.collect()))
    assert rows == sorted(map(tuple, two.collect())) and len(rows) == 50 and all(0 <= r[2] < 6 for r in rows)
    counts = G.table_counts(one.join(df, ["doc", "idx"]), ["lemma", "tag"]).groupBy("feature").agg(F.sum("n").alias("n")).collect()
    assert all(r["n"] == 50 for r in counts)


def test_mixture_rows_sum_to_one_and_likelihood_rises(spark):
    rng = random.Random(1)
    words = spark.createDataFrame([(d, w, rng.randint(1, 3), i) for d in range(4) for i, w in enumerate("abc")], "doc long, word string, n long, first long")
    rows = []
    for d in range(4):
        for f in range(5):
            raw = [rng.random() for _ in range(3)]
            rows += [(d, f, k, v / sum(raw)) for k, v in enumerate(raw)]
    post = spark.createDataFrame(rows, "doc long, fidx long, k int, p double")
    traces = []
    for r in (0, 1, 3):
        table = MX.mixture_translate(words, post, 3, r, alpha=0.0)
        sums = table.groupBy("word").agg(F.sum("p").alias("s")).collect()
        assert all(s["s"] == pytest.approx(1.0) for s in sums)
        traces.append(MX.mixture_log_likelihood(words, post, table).first()[0])
    assert traces[0] <= traces[1] + 1e-9 <= traces[2] + 2e-9


def test_nested_mentions_and_duplicates(spark):
    rows = [(0, 0, 1, 0, 5), (0, 1, 1, 2, 4), (0, 2, 1, 6, 8), (0, 3, 1, 6, 8), (0, 4, 2, 2, 4), (0, 5, 1, 0, 3)]
    df = spark.createDataFrame(rows, "doc long, idx long, cluster long, m_start long, m_end long")
    assert sorted(r["idx"] for r in S.remove_nested_mentions(df).collect()) == [0, 4]


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_numbers_and_totals_do_not_depend_on_the_block(spark, width):
    from corefold.operators import order

    rng = random.Random(width)
    rows = [(d, x, rng.randint(0, 9)) for d in range(3) for x in range(0, 60, 2)]
    df = spark.createDataFrame(rows, "doc long, x long, v long")
    block = order.blocks_of(F.col("x"), width)
    n = {(r["doc"], r["x"]): r["n"] for r in order.number_rows(df, ["doc"], ["x"], block, "n").collect()}
    s = {(r["doc"], r["x"]): r["s"] for r in order.running_total(df, ["doc"], ["x"], block, F.col("v"), "s").collect()}
    m = {(r["doc"], r["x"]): r["m"] for r in order.running_max(df, ["doc"], ["x"], block, F.col("v"), "m").collect()}
    for d, x, _ in rows:
        before = [v for e, y, v in rows if e == d and y < x]
        assert n[d, x] == len(before) and s[d, x] == sum(before) and m[d, x] == max(before, default=None)


def test_text_document_keys(spark):
    from corefold.plans import clusters as K

    links = spark.createDataFrame([("b_1", 0, -1), ("b_1", 1, 0), ("a_2", 0, -1), ("a_2", 1, -1)], "doc string, idx long, antecedent long")
    got = {(r["doc"], r["idx"]): r["cluster_id"] for r in K.antecedents_to_clusters(links).collect()}
    assert got == {("a_2", 0): 1, ("a_2", 1): 2, ("b_1", 0): 3, ("b_1", 1): 3}


def test_attention_from_merged_blocks(spark):
    import numpy as np

    draw = np.random.default_rng(4)
    m, f = draw.normal(0, 9, (11, 5)), draw.normal(0, 9, (17, 5))
    mentions = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(m)] + [(2, 0, [1.0] * 5)], "doc long, idx long, emb array<double>")
    frames = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(f)], "doc long, fidx long, emb array<double>")
    pairs = spark.createDataFrame([(1, i, j) for j in range(11) for i in range(j)], "doc long, i long, j long")
    logits = m @ f.T
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    got = M.attention_pair_features(pairs, mentions, frames, block=3).collect()
    assert len(got) == 55
    for r in got:
        a, b = p[r["i"]], p[r["j"]]
        for name, want in (("first", a.max()), ("second", b.max()), ("product", a.max() * b.max()), ("joint", (a * b).max())):
            assert abs(r[name] - want) <= 1e-9 * want
    rows = M.attention_rows(mentions, frames).collect()
    assert len(rows) == 11 * 17 and all(abs(r["p"] - p[r["idx"], r["fidx"]]) < 1e-12 for r in rows)


def test_whole_tables_are_numbered_over_several_tasks(spark):
    from corefold.operators import order

    names = [f"same-prefix-{i:05}" for i in range(20_000)]
    draw = random.Random(1)
    rows = [(n, draw.randrange(3), draw.choice(["hot"] * 8 + ["a", None])) for n in draw.sample(names, len(names))]
    df = spark.createDataFrame(rows, "name string, v int, g string").repartition(6)
    ids = order.number_by_range(df, ["name"], "id", start=5)
    assert [r["id"] for r in ids.orderBy("name").collect()] == list(range(5, 20_005))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be put together
    try:
        assert order._in_ranges(df, ["name"]).select("_order_part").distinct().count() == 8
        assert [r["id"] for r in order.number_by_range(df, ["name"], "id").orderBy("name").collect()] == list(range(20_000))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    inside = order.number_by_range(df, ["name"], "id", keys=["g"]).collect()
    for g in ("hot", "a", None):
        assert [r["id"] for r in sorted((r for r in inside if r["g"] == g), key=lambda r: r["name"])] == list(range(sum(x[2] == g for x in rows)))
    sums = order.running_totals_by_range(df, ["name"], {"total": F.col("v")}).orderBy("name").collect()
    total = 0
    for r in sums:
        total += r["v"]
        assert r["total"] == total
    assert order.number_by_range(df.limit(0), ["name"], "id").count() == 0
    assert order.running_totals_by_range(df.limit(0), ["name"], {"total": F.col("v")}).count() == 0


def test_sampled_pairs_have_the_expected_share_and_weights(spark):
    draw = random.Random(2)
    rows = [(d, i, 1 + draw.randrange(4) if draw.random() < 0.3 else 0) for d in range(12) for i in range(30)]
    mentions = spark.createDataFrame(rows, "doc long, idx long, cluster long")
    cluster = {(d, i): c for d, i, c in rows}
    got = G.sample_negative_pairs(mentions, factor=3.0).collect()
    assert len({(r["doc"], r["i"], r["j"]) for r in got}) == len(got) and all(r["i"] < r["j"] for r in got)
    same = lambda d, i, j: cluster[d, i] != 0 and cluster[d, i] == cluster[d, j]
    assert all(r["y"] == same(r["doc"], r["i"], r["j"]) for r in got)
    all_pairs = [(d, i, j) for d in range(12) for j in range(30) for i in range(j)]
    positives = [p for p in all_pairs if same(*p)]
    all_pairs = [p for p in all_pairs if p[0] in {d for d, _, _ in positives}]  # no positives, no negatives
    assert sum(r["y"] for r in got) == len(positives)
    by_weight = sum(r["weight"] for r in got if not r["y"])
    negatives = len(all_pairs) - len(positives)
    assert abs(by_weight - negatives) < 0.1 * negatives and len(got) < 0.6 * len(all_pairs)
    every = G.sample_negative_pairs(mentions, factor=1e9)
    assert every.count() == len(all_pairs) and every.filter("weight <> 1").count() == 0
