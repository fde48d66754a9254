"""Dealt candidates against the rounds over the whole candidate table, and sweeps against their sums."""

import random

import pytest
from pyspark.sql import functions as F

from corefold.plans import arguments as A
from corefold.plans import dealt as D
from corefold.plans import translation as T


def candidates(spark, seed=0):
    """A common word with most mentions, equal words in several rows, closed candidates and nulls."""
    rng = random.Random(seed)
    rows = []
    for doc in range(12):
        for j in range(20):
            tgt = "common" if rng.random() < 0.7 else rng.choice(["b", "c", "é", None])
            for _ in range(rng.randint(1, 9)):
                src = rng.choice(["common", "b", "c", "é", "z", None])
                rows.append(("text", doc, j, tgt, src, 0, float(rng.randint(1, 3)), rng.randint(0, 5), rng.random() < 0.9))
            rows.append(("text", doc, j, tgt, "###NEW###", 0, 1.0, -1, True))
    return spark.createDataFrame(rows, "mode string, doc long, j long, tgt string, src string, dist long, n double, first long, open boolean")


@pytest.mark.parametrize("rows", [16, 100, 1 << 18])
def test_parts_of_any_size_give_the_rounds_of_the_whole_table(spark, rows):
    found = candidates(spark)
    dealt = D.deal(found, rows=rows)
    assert dealt.n >= found.count() // rows
    table = T.init_translation(found, {"text": 5})
    for _ in range(3):
        post = T.e_step(found, table.select("mode", "src", "tgt", "p"))
        assert dealt.log_likelihood(table).first()[0] == pytest.approx(T.log_likelihood(post).first()[0])
        want = {(r["src"], r["tgt"]): r["p"] for r in T.m_step(post).collect()}
        table = T.normalised(dealt.counts(table)).localCheckpoint()
        assert {(r["src"], r["tgt"]): r["p"] for r in table.collect()} == pytest.approx(want)
    rounded = table.withColumn("p", F.round("p", 12)).localCheckpoint()
    got = {(r["doc"], r["idx"]): (r["antecedent"], r["score"]) for r in T.predict_antecedents(dealt, rounded).collect()}
    assert got == {(r["doc"], r["idx"]): (r["antecedent"], r["score"]) for r in T.predict_antecedents(found, rounded).collect()}


def test_a_common_word_is_spread_and_a_round_moves_no_candidates(spark):
    dealt = D.deal(candidates(spark), rows=100)
    assert dealt.pairs.filter("src = '###NEW###' AND tgt = 'common'").select("g").distinct().count() > 1
    plan = dealt.counts(T.init_translation(dealt.pairs, {"text": 5}))._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "ExistingRDD" in line and "pack#" in line)
    depth, above = len(lines[at]) - len(lines[at].lstrip(" :+-|")), []
    for line in reversed(lines[:at]):  # the operators over the parts
        here = len(line) - len(line.lstrip(" :+-|"))
        if here < depth:
            depth, above = here, [*above, line]
        if "MapInArrow" in line:
            break
    assert "MapInArrow" in above[-1] and not any("Exchange" in line for line in above)


def test_mentions_whose_word_differs_keep_one_normaliser(spark):
    rows = [("text", 1, 1, t, s, 0, 1.0, i, True) for i, (t, s) in enumerate([("a", "x"), ("b", "x"), ("b", "y")])]
    found = spark.createDataFrame(rows, "mode string, doc long, j long, tgt string, src string, dist long, n double, first long, open boolean")
    got = D.deal(found, rows=1).counts(T.init_translation(found, {"text": 2})).collect()
    assert {(r["src"], r["tgt"]): r["count"] for r in got} == pytest.approx({("x", "a"): 1 / 3, ("x", "b"): 1 / 3, ("y", "b"): 1 / 3})


def sampled(spark):
    rng = random.Random(3)
    rows = [(d, i, rng.choice("pqrs"), rng.choice(["x", None]), rng.randint(0, 4)) for d in range(6) for i in range(30)]
    return spark.createDataFrame(rows, "doc long, idx long, lemma string, kind string, table long")


def test_sweep_draws_by_the_gains_of_values_and_document(spark):
    import math
    from collections import Counter

    from corefold.functions import text as X
    from corefold.plans import sampling as G

    mentions = sampled(spark)
    rows = mentions.withColumn("u", X.seeded_uniform("0|7", F.col("doc"), F.col("idx"))).collect()
    got = {(r["doc"], r["idx"]): r["table"] for r in G.cluster_sweep(mentions, ["lemma", "kind"], {"lemma": 4, "kind": 1}, 5, 1.0, 0.5, 0, 7).collect()}
    counts = Counter((f, r["table"], r[f]) for r in rows for f in ("lemma", "kind"))
    size, used = Counter(r["table"] for r in rows), Counter((r["doc"], r["table"]) for r in rows)
    assert len(got) == len(rows)
    for r in rows:
        weights = []
        for k in range(5):
            w = math.log((used[r["doc"], k] + 0.1) / 0.1)
            for f, v in (("lemma", 4), ("kind", 1)):
                seen = counts[f, k, r[f]] if r[f] is not None else 0  # an absent value tells nothing
                w += math.log((seen + 1 / v) / (size[k] + 1.0))
            weights.append(math.exp(w))
        at, k = r["u"] * sum(weights), 0
        while at >= weights[k] and k < 4:
            at, k = at - weights[k], k + 1
        assert got[r["doc"], r["idx"]] == k


def test_sweep_joins_values_once_per_combination(spark):
    """Mentions meet packed gains, so no row per mention and table is shuffled."""
    from corefold.plans import sampling as G

    mentions = sampled(spark)
    gains = G.combination_gains(mentions, G.table_counts(mentions, ["lemma", "kind"]), ["lemma", "kind"], {"lemma": 4, "kind": 1}, 1.0)
    assert gains.count() == mentions.select("lemma", "kind").distinct().count()


def test_packed_frames_are_one_row_per_frame(spark):
    from corefold.plans import mixture as MX

    post = spark.createDataFrame([(1, f, k, 0.25 * (k + 1)) for f in range(3) for k in range(2)], "doc long, fidx long, k int, p double")
    words = spark.createDataFrame([(1, "a", 2, 0), (1, "b", 1, 1), (2, "b", 1, 0)], "doc long, word string, n long, first long")
    table = spark.createDataFrame([("a", 0, 0.3), ("a", 1, 0.7), ("b", 0, 0.6), ("b", 1, 0.4)], "word string, k int, p double")
    packed = MX.packed_frames(post, 2)
    assert sorted((r["fidx"], r["vec"]) for r in packed.collect()) == [(f, [0.25, 0.5]) for f in range(3)]
    assert [r["z"] for r in MX.frame_scores(words, post, table).collect()] == pytest.approx([0.25 * 1.2 + 0.5 * 1.8] * 3)


def test_imputer_deals_slots_by_trigger(spark):
    rows = [(d, e, r, f"t{e % 2}", None if (d + e) % 3 == 0 else f"v{(d * e) % 4}") for d in range(4) for e in range(6) for r in ("A", "B")]
    model = A.fit_imputer(spark.createDataFrame(rows, "doc long, e_idx long, role string, trigger string, value string"), 2)
    by_table = model.posterior().groupBy("doc", "e_idx", "mode").agg(F.min_by("tgt", F.struct(-F.round("w", 12), "first", "tgt")).alias("v"))
    assert {tuple(r) for r in A.impute_arguments(model).collect()} == {tuple(r) for r in by_table.collect()}


def test_products_of_frames_are_summed_by_document(spark):
    rng = random.Random(5)
    rows = [(d, f, k, rng.random()) for d in range(3) for f in range(7) for k in range(3)]
    post = spark.createDataFrame(rows, "doc long, fidx long, k int, p double")
    at = {(d, f, k): p for d, f, k, p in rows}
    found = {r["doc"]: r for r in T.frame_products(post, 3, block=2).collect()}
    for d in range(3):
        assert found[d]["_mass"] == pytest.approx([sum(at[d, f, k] for f in range(7)) for k in range(3)])
        for a in range(3):
            assert found[d]["_gram"][a] == pytest.approx([sum(at[d, f, a] * at[d, f, b] for f in range(7)) for b in range(3)])


def test_imputer_makes_candidates_without_moving_them(spark, monkeypatch):
    import collections

    monkeypatch.setattr(A, "VALUES", 2, raising=False)
    rng = random.Random(8)
    rows = [(d, e, r, f"t{e % 3}", None if rng.random() < 0.5 else f"v{rng.randrange(5)}") for d in range(5) for e in range(7) for r in "ABC"]
    rows += [(9, 0, "A", "t0", None), (9, 0, "B", "t0", "v1"), (10, 0, "A", "t1", None), (10, 0, "A", "t1", None), (10, 4, "B", "t1", "v3"), (None, 1, "A", "t1", None), (None, 2, "A", "t1", "v1")]
    found = A.imputation_candidates(spark.createDataFrame(rows, "doc long, e_idx long, role string, trigger string, value string"))
    want = collections.Counter()
    for d, e, r, t, v in rows:
        others = [] if v is not None else [(w, f) for x, f, _, _, w in rows if w is not None and x == d and d is not None and f != e]
        for w in {w for w, _ in others}:
            want[d, f"{e}:{r}", w, t, float(sum(w == x for x, _ in others)), min(f for x, f in others if x == w)] += 1
        if not others:
            want[d, f"{e}:{r}", v or "###NULL###", t, 1.0, -1] += 1
    assert collections.Counter((r["doc"], r["j"], r["tgt"], r["src"], r["n"], r["first"]) for r in found.collect()) == want
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "Generate explode" in line)
    depth, above = len(lines[at]) - len(lines[at].lstrip(" :+-")), []
    for line in reversed(lines[:at]):  # what the candidates pass through
        here = len(line) - len(line.lstrip(" :+-"))
        if here < depth:
            depth, above = here, [*above, line.lstrip(" :+-")]
    assert above and not any(line.startswith(("Join", "Aggregate", "Window")) for line in above)
