"""Keys that meet in batches: block products and retrieval against brute force."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corefold.operators import media as M
from corefold.operators import pairs as P
from corefold.operators import ranking as R
from corefold.plans import translation as T


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_keys_share_batches(spark):
    draw = random.Random(3)
    rows = [(draw.choice([None, *range(40)]), i, draw.choice([None, 5, 2**60 + 1]), float(draw.randrange(9))) for i in range(300)]
    table = spark.createDataFrame(rows, "doc long, idx long, big long, x double")

    def product(l, r):
        if l.empty or r.empty:
            return pd.DataFrame()
        i, j = np.meshgrid(np.arange(len(l)), np.arange(len(r)))
        out = pd.DataFrame({"doc": l["doc"].iloc[0], "i": l["idx"].to_numpy()[i.ravel()], "j": r["idx"].to_numpy()[j.ravel()], "s": (l["x"].to_numpy()[i] * r["x"].to_numpy()[j]).ravel()})
        return out[out["i"] < out["j"]]

    for ordered in (False, True):
        found = P.block_scores(table, table, ["doc"], "idx", "idx", product, "doc long, i long, j long, s double", 1000, ordered)
        want = sorted((str(a[0]), a[1], b[1], a[3] * b[3]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1])
        assert sorted((str(r.doc), r.i, r.j, r.s) for r in found.collect()) == want
        assert "MapInArrow" in _plan(found) and "CoGroup" not in _plan(found)
    split = P.block_scores(table.filter("doc IS NOT NULL"), table, ["doc"], "idx", "idx", product, "doc long, i long, j long, s double", 16, True)
    assert split.count() == sum(w[0] != "None" for w in want)
    mixed = spark.createDataFrame([(1, None), (1, 7), (2, 2**60 + 1)], "doc long, big long").coalesce(1)  # one batch
    kept = P.meet(mixed, mixed.select("doc", F.col("big").alias("other")), ["doc"], lambda l, r: {"big": l["big"].to_numpy()}, "big long")
    assert sorted(str(r.big) for r in kept.collect()) == sorted(["None", "7", str(2**60 + 1)])


def test_semantic_matches_without_a_transfer_per_key(spark):
    draw = random.Random(4)
    rows = [(d, i, "t%d" % draw.randrange(2), "w%d" % draw.randrange(4), draw.randrange(3), [draw.gauss(0, 1) for _ in range(4)]) for d in range(30) for i in range(12)]
    table = spark.createDataFrame(rows, "doc long, idx long, type string, lemma string, sent long, emb array<double>")
    found = T.semantic_matches(table, 0.5, 4, ("doc", "type"))
    assert "CoGroup" not in _plan(found)
    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[2] == b[2] and a[1] < b[1]:
                u, v = np.array(a[5]), np.array(b[5])
                if abs(u @ v) / np.sqrt((u @ u) * (v @ v)) > 0.5:
                    n, first = want.get((b[0], b[1], b[3], a[3], b[4] - a[4]), (0, 10**9))
                    want[(b[0], b[1], b[3], a[3], b[4] - a[4])] = (n + 1, min(first, a[1]))
    assert {(r.doc, r.j, r.tgt, r.src, r.dist): (r.n, r.first) for r in found.collect()} == want


def test_retrieval_sends_rows_to_few_blocks(spark, monkeypatch):
    draw = random.Random(5)
    vectors = [[float(draw.randrange(-2, 3)) for _ in range(3)] for _ in range(150)]  # many ties
    q = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "q long, emb array<double>")
    g = spark.createDataFrame([(1000 + i, v) for i, v in enumerate(vectors[::-1])], "g long, emb array<double>")
    sent = []
    meet = R.meet
    monkeypatch.setattr(R, "meet", lambda l, r, *rest: (sent.append((l.count(), r.count())), meet(l, r, *rest))[1])
    monkeypatch.setattr(R, "SCORES_AT_ONCE", 20)
    found = R.retrieve_topk(q, g, 4, block=2).collect()
    assert max(sent[0]) <= 150 * R.FEW_BLOCKS
    want = {}
    for i, v in enumerate(vectors):
        ranked = sorted((-float(np.dot(v, w)), 1000 + n) for n, w in enumerate(vectors[::-1]))[:4]
        want[i] = [(g_, -s) for s, g_ in ranked]
    got = {}
    for r in sorted(found, key=lambda r: (r.q, r.rank)):
        got.setdefault(r.q, []).append((r.g, r.score))
    assert got == want


def test_pooling_sends_vectors_once(spark):
    draw = random.Random(6)
    frames = spark.createDataFrame([(d, f, [draw.gauss(0, 1) for _ in range(3)]) for d in range(5) for f in range(23)], "doc long, fidx long, emb array<double>")
    rows = []
    for d in range(5):
        for seg in range(9):
            start, n = draw.randrange(18), draw.randrange(1, 12)
            rows += [(d, seg, pos, f) for pos, f in enumerate(range(start, min(23, start + n)))]
    named = spark.createDataFrame(rows, "doc long, seg long, pos long, fidx long")
    whole = named.join(frames, ["doc", "fidx"])
    for how, key in (("mean", lambda r: (r.doc, r.seg)), ("resample", lambda r: (r.doc, r.seg, r.chunk))):
        want = {key(r): list(r.emb) for r in M.pool_segments(whole, how, 4).collect()}
        found = M.pool_segments(named, how, 4, frames)
        assert "MapInArrow" in _plan(found)
        got = {key(r): list(r.emb) for r in found.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    want = {(r.doc, r.seg): list(r.emb) for r in M.vector_mean(whole, ["doc", "seg"]).collect()}
    split = {(r.doc, r.seg): list(r.emb) for r in M.frame_means(named, frames, ["doc", "seg"], block=10).collect()}
    assert split.keys() == want.keys() and all(np.allclose(split[k], want[k]) for k in want)


def test_token_cosines_without_broadcast(spark):
    draw = random.Random(7)
    tokens = [(d, i, 10 * i + k, [draw.gauss(0, 1) for _ in range(3)]) for d in range(3) for i in range(12) for k in range(draw.randrange(3))]
    tokens.append((*tokens[0][:3], [1.0, 0.0, 0.0]))  # a token with two vectors
    pairs = [(d, i, j) for d in range(3) for i in range(-1, 12) for j in range(max(0, i + 1), 12)]
    table, listed = spark.createDataFrame(tokens, "doc long, idx long, tid long, emb array<double>"), spark.createDataFrame(pairs, "doc long, i long, j long")
    want = {}
    for d, i, j in pairs:
        if i < 0:
            want[d, i, j] = 1.0
            continue
        top = {}
        for e, b, t, v in tokens:
            for e2, a, _, u in tokens:
                if e == e2 == d and b == j and a == i:
                    cos = abs(np.dot(u, v)) / (np.linalg.norm(u) * np.linalg.norm(v))
                    top[t] = max(top.get(t, 0.0), cos)
        if top:
            want[d, i, j] = sum(top.values()) / len(top)
    for block in (1024, 5):
        found = M.max_abs_cosine_mean(listed, table, block)
        assert "Broadcast" not in _plan(found)
        got = {(r.doc, r.i, r.j): r.sim for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
