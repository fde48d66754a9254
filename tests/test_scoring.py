"""Scores against brute force over pairs and against worked examples."""

import itertools
import random

import numpy as np
import pytest

from corefold.plans import clusters as K
from corefold.plans import scoring as S


def table(spark, rows):
    return spark.createDataFrame(rows, "doc long, idx long, gold long, pred long, type string")


def brute_pairs(rows):
    counts = dict(tp=0, fp=0, fn=0, tn=0)
    for a, b in itertools.combinations(rows, 2):
        if a[0] != b[0]:
            continue
        y = a[2] == b[2] and a[2] > 0
        p = a[3] == b[3] and a[3] > 0
        counts["tp" if p and y else "fp" if p else "fn" if y else "tn"] += 1
    return counts


def random_rows(seed, docs=4, n=12):
    rng = random.Random(seed)
    return [(d, i, rng.randint(0, 4), rng.randint(0, 4), rng.choice("ab")) for d in range(docs) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_pairwise_counts_equal_enumeration(spark, seed):
    rows = random_rows(seed)
    got = S.pairwise_prf(table(spark, rows)).first().asDict()
    want = brute_pairs(rows)
    assert {k: got[k] for k in want} == want


def test_pairwise_by_type_counts_each_member(spark):
    rows = random_rows(7)
    got = {r["type"]: r.asDict() for r in S.pairwise_by_type(table(spark, rows)).collect()}
    for kind in "ab":
        tp = sum(
            (a[4] == kind) + (b[4] == kind)
            for a, b in itertools.combinations(rows, 2)
            if a[0] == b[0] and a[2] == b[2] > 0 and a[3] == b[3] > 0
        )
        assert got[kind]["tp"] == tp


def test_empty_and_single_documents(spark):
    one = S.pairwise_prf(table(spark, [(0, 0, 1, 1, "a")])).first()
    assert (one["tp"], one["fp"], one["precision"], one["f1"]) == (0, 0, 0.0, 0.0)
    assert S.muc(table(spark, [(0, 0, 0, 0, "a")])).first()["f1"] == 0.0


# Gold {1,2,3} {4,5,6,7}; response {1,2} {3,4,5} {6,7}: the textbook link scores.
EXAMPLE = [(0, 1, 1, 1, "a"), (0, 2, 1, 1, "a"), (0, 3, 1, 2, "a"), (0, 4, 2, 2, "a"), (0, 5, 2, 2, "a"), (0, 6, 2, 3, "a"), (0, 7, 2, 3, "a")]


def test_worked_example(spark):
    rows = table(spark, EXAMPLE)
    muc = S.muc(rows).first()
    assert muc["recall"] == pytest.approx(3 / 5) and muc["precision"] == pytest.approx(3 / 4)
    b3 = S.b_cubed(rows).first()
    assert b3["recall"] == pytest.approx((4 / 3 + 1 / 3 + 4 / 4 + 4 / 4) / 7)
    assert b3["precision"] == pytest.approx((4 / 2 + 1 / 3 + 4 / 3 + 4 / 2) / 7)
    # phi: {123}-{12} 4/5, {123}-{345} 2/6, {4567}-{345} 4/7, {4567}-{67} 4/6
    ceaf = S.ceaf_e(rows).first()
    assert ceaf["precision"] == pytest.approx((4 / 5 + 4 / 6) / 3) and ceaf["recall"] == pytest.approx((4 / 5 + 4 / 6) / 2)


def test_perfect_response(spark):
    rows = table(spark, [(d, i, i // 2 + 1, i // 2 + 1, "a") for d in range(3) for i in range(6)])
    for score in (S.muc, S.b_cubed, S.ceaf_e):
        assert score(rows).first()["f1"] == pytest.approx(1.0)


@pytest.mark.parametrize("seed", [1])
def test_ceaf_equals_whole_assignment(spark, seed):
    rows = random_rows(seed, docs=1, n=20)
    sizes = {p: sum(1 for r in rows if r[3] == p) for p in range(1, 5)}
    kept = [p for p in sizes if sizes[p] > 1]
    gold = sorted({r[2] for r in rows if r[2] > 0})
    w = np.array([[2 * sum(1 for r in rows if r[2] == g and r[3] == p) / (sum(1 for r in rows if r[2] == g) + sizes[p]) for p in kept] for g in gold])
    w = w if w.shape[0] <= w.shape[1] else w.T
    best = max(sum(w[i, p[i]] for i in range(w.shape[0])) for p in itertools.permutations(range(w.shape[1]), w.shape[0]))
    found = S.ceaf_matching(table(spark, rows), tolerance=1e-4)
    assert found.total == pytest.approx(best) and best <= found.bound + 1e-9 and found.bound - found.total <= 1e-4 * 2 * (len(gold) + len(kept))


def test_long_chain_and_components(spark):
    n = 200
    links = spark.createDataFrame([(0, i, i - 1) for i in range(n)] + [(1, 0, -1), (1, 1, 0)], "doc long, idx long, antecedent long")
    got = K.antecedents_to_clusters(links).collect()
    assert {(r["doc"], r["root"], r["cluster_id"]) for r in got} == {(0, 0, 1), (1, 0, 2)} and len(got) == n + 2
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]
    parent = list(range(61))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = K.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert all(r["component"] == find(r["node"]) for r in found)
    assert {r["node"] for r in found} == {x for e in edges for x in e}
