"""Clustering, whitening and sharding against plain counts on small tables."""

import collections
import fractions
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corefold.llm import centroids, shards, vectors, whitening

NAN, INF = float("nan"), float("inf")


def vector_table(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
    for name in ("key", "planes", "norm", "cluster", "x", "n", "dims", "label"):
        df = df.withColumn(name, F.lit("mine"))
    return df


def odd_vectors(dims=64):
    good = [float(i % 7) - 3 for i in range(dims)]
    return [
        (901, None), (902, []), (903, good[:-1]), (904, good + [1.0]), (905, [NAN] + good[1:]), (906, good[:-1] + [INF]),
        (907, [None] + good[1:]), (None, good), (908, good), (908, good),
    ]


# ---- rows of a list column

def test_finite_rows_also_of_slices():
    column = pa.array([[9.0], None, [1.0, 2.0], [], [None, 1.0], [NAN], [3.0], [INF, 1.0]], pa.list_(pa.float32()))
    rows, size, out = vectors.finite_rows(column.slice(1))
    assert rows.tolist() == [1, 2, 5] and size.tolist() == [2, 0, 1] and out.tolist() == [[1, 2], [0, 0], [3, 0]]
    rows, size, out = vectors.finite_rows(column.slice(0, 0))
    assert len(rows) == 0 and out.shape == (0, 0)


# ---- bit planes

@pytest.mark.parametrize("dims", [1, 5, 64, 70])
def test_popcounts_give_exact_products(dims):
    draw = np.random.default_rng(dims)
    for top in (0, 1, 900, 2**26):
        x, c = draw.integers(-top, top, (20, dims), endpoint=True), draw.integers(-top, top, (1, dims), endpoint=True)
        planes = centroids.to_planes(x)
        assert (centroids.dots(planes, centroids.to_planes(c)[0]) == (x * c).sum(axis=1)).all()
        assert (centroids.dots(centroids.widen(planes, planes.shape[1] + 4), centroids.to_planes(c)[0]) == (x * c).sum(axis=1)).all()


def lloyd(rows, k, rounds, scale, dims):
    kept = [(i, np.floor(np.array(v, np.float64) * scale).astype(int)) for i, v in rows if v is not None and len(v) == dims and all(e is not None and np.isfinite(e) for e in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), j) for j, (i, _) in enumerate(kept) if i is not None)
    cents = [kept[j][1].tolist() for _, j in named[:k]]
    far = lambda x, c: sum((int(a) - b) ** 2 for a, b in zip(x, c))
    for t in range(rounds + 1):
        of = [min(range(len(cents)), key=lambda c: (far(x, cents[c]), c)) for _, x in kept]
        if t < rounds:
            for c in range(len(cents)):
                mine = [x for (_, x), o in zip(kept, of) if o == c]
                if mine:
                    cents[c] = [sum(int(x[d]) for x in mine) // len(mine) for d in range(dims)]
    each = [(i, o, far(x, cents[o])) for (i, x), o in zip(kept, of)]
    inertia = collections.Counter()
    for _, o, d in each:
        inertia[o] += d
    return collections.Counter((i, o, d, inertia[o], sum(inertia.values()), tuple(cents[o])) for i, o, d in each)


@pytest.mark.parametrize("dims", [64, 3])
def test_clusters_equal_plain_rounds(spark, dims):
    draw = random.Random(dims)
    same = [1.5] * dims
    rows = [(i, [draw.gauss(i % 5, 0.4) for _ in range(dims)]) for i in range(150)] + [(200 + i, same) for i in range(60)] + odd_vectors(dims)
    rows = [(i, None if v is None else [None if e is None else float(np.float32(e)) for e in v]) for i, v in rows]
    got = centroids.cluster(vector_table(spark, rows), k=6, rounds=4, dims=dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    found = collections.Counter((r[0], r[1], r[2], r[3], r[4], tuple(r[5])) for r in got.collect())
    assert found == lloyd(rows, 6, 4, 1024, dims)


def test_clusters_of_few_or_no_vectors(spark):
    assert centroids.cluster(vector_table(spark, odd_vectors()[:7])).count() == 0
    assert centroids.cluster(vector_table(spark, []).limit(0)).count() == 0
    few = centroids.cluster(vector_table(spark, odd_vectors()[8:] + [(5, [0.0] * 64)])).collect()
    assert sorted((r["vec_id"], r["distance"]) for r in few) == [(5, 0), (908, 0), (908, 0)]
    with pytest.raises(Exception, match="27 bits"):
        centroids.cluster(vector_table(spark, [(1, [1e9] * 64)])).collect()


# ---- whitening

def exact_covariance(list_):
    n, dims = len(list_), len(list_[0])
    mean = [fractions.Fraction(sum(x[d] for x in list_), n) for d in range(dims)]
    return [[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in list_) / n) for j in range(dims)] for i in range(dims)]


@pytest.mark.parametrize("spread", [3.0, 1e7])
def test_whitening_against_plain_moments(spark, spread):
    draw = random.Random(7)
    rows = [(i, [float(np.float32(draw.gauss(50 * d, spread / (d + 1)))) for d in range(6)]) for i in range(120)]
    rows += [(500 + i, rows[3][1]) for i in range(80)] + [(700, None), (701, [NAN] * 6), (702, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    got = whitening.whiten(vector_table(spark, rows), components=4).collect()
    ints = {i: [int(np.floor(256 * np.float64(e))) for e in v] for i, v in rows if i < 700}
    fit_list = [list(x) for x in {tuple(x) for x in ints.values()}]
    n, sums = len(fit_list), [sum(x[d] for x in fit_list) for d in range(6)]
    cov = np.array(exact_covariance(fit_list))
    packed = whitening.pack(vector_table(spark, rows), "embedding", 256, "vec_id")
    model = whitening.fit(packed, 4)
    assert np.abs(model.covariance - cov).max() <= 1e-15 * np.abs(cov).max() and model.sums == sums
    assert len(got) == 4 * len(ints) and {r["n"] for r in got} == {n}
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    by = collections.defaultdict(dict)
    for r in got:
        assert int(r["deviation"]) == sum((n * a - s) ** 2 for a, s in zip(ints[r["vec_id"]], sums))
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9) and r["identity_error"] <= 1e-9
        by[r["vec_id"]][r["component"]] = r["whitened"]
    seen = {tuple(ints[i]): [by[i][c] for c in (1, 2, 3, 4)] for i in ints}
    w = np.array([seen[tuple(x)] for x in fit_list])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(4)).max() < 1e-9
    # the projection is on eigenvectors: whitened = a linear map of the centred vectors that V turns into e times itself
    centred = np.array(fit_list) - np.array(sums) / n
    map_ = np.linalg.lstsq(centred, w, rcond=None)[0] * np.sqrt(values[:4])
    assert np.abs(cov @ map_ - map_ * values[:4]).max() < 1e-6 * values[0]


def test_polarisation_keeps_large_integers_exact():
    draw = np.random.default_rng(3)
    y = draw.integers(-(2**40), 2**40, (50, 5))
    plain = [sum((int(a) if i == j else int(a) + int(b)) ** 2 for a, b in zip(y[:, i], y[:, j])) for i, j in zip(*np.triu_indices(5))]
    assert whitening.squares(y).tolist() == plain


def test_whitening_of_odd_rows(spark):
    assert whitening.whiten(vector_table(spark, []).limit(0)).count() == 0
    assert whitening.whiten(vector_table(spark, [(1, None), (2, [NAN])])).count() == 0
    assert whitening.whiten(vector_table(spark, [(1, []), (2, [])])).count() == 0
    assert whitening.whiten(vector_table(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])])).count() == 0
    # one direction only: one component, the short vector standing for (1, 0)
    rows = whitening.whiten(vector_table(spark, [(1, [1.0]), (None, [3.0, 0.0]), (3, [5.0, 0.0])])).collect()
    assert {(r["vec_id"], r["component"]) for r in rows} == {(1, 1), (None, 1), (3, 1)} and {r["n"] for r in rows} == {3}
    assert sorted(abs(round(r["whitened"], 9)) for r in rows) == [0.0, round(1.5**0.5, 9), round(1.5**0.5, 9)]


# ---- shards

DOCS = "doc_id long, text string, source string, shard_of string, _rank string, size string"


def doc_table(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", "z") for i, t, s in rows], DOCS).repartition(5)


def test_shards_hold_the_mixture(spark):
    draw = random.Random(4)
    rows = [(i, None if i % 50 == 0 else "eé" * (i % 9), draw.choice(["hot"] * 6 + ["a", "b", None])) for i in range(1000)] + [(1, "x", "a")] * 7 + [(None, "n", "b")] * 3
    got = shards.assign(doc_table(spark, rows), shards=8).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows
    )
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    counts = [len(by[s]) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(r["slot"] for r in of) == list(range(len(of))) for of in by.values())
    source = {i: s for i, _, s in rows[:1000]}
    whole = collections.Counter(s for _, _, s in rows)
    for of in by.values():
        part = collections.Counter(source.get(r["doc_id"], "b") if r["doc_id"] != 1 else "a" for r in of)
        assert all(abs(part[s] - whole[s] / 8) <= 3 for s in whole)


def test_shards_equal_a_plain_sort(spark):
    rows = [(i, "t" * (i % 5), "abc"[i % 7 % 3]) for i in range(200)]
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in shards.assign(doc_table(spark, rows), shards=7, seed=5).collect()}
    mark = lambda i: int(hashlib.sha256(f"5:{i}".encode()).hexdigest()[:15], 16)
    fraction = {}
    for s in "abc":
        of = sorted((i for i, _, x in rows if x == s), key=mark)
        fraction |= {i: ((2 * r + 1) / (2 * len(of)), mark(i)) for r, i in enumerate(of)}
    want, seen = {}, collections.Counter()
    for place, i in enumerate(sorted(fraction, key=fraction.get)):
        shard = place * 7 // 200
        want[i] = (shard, seen[shard])
        seen[shard] += 1
    assert got == want


def test_shards_of_few_rows_and_files(spark, tmp_path):
    assert shards.assign(doc_table(spark, []).limit(0)).count() == 0
    few = shards.assign(doc_table(spark, [(1, "a", "s"), (2, None, None)])).collect()
    assert sorted(r["slot"] for r in few) == [0, 0] and len({r["shard"] for r in few}) == 2
    rows = [(i, f"text {i}", "ab"[i % 2]) for i in range(50)]
    path = str(tmp_path / "shards")
    shards.write_shards(doc_table(spark, rows), path, shards=5)
    back = spark.read.parquet(path)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t for i, t, _ in rows}
    assert {(r["shard"], r["n"]) for r in back.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {(s, 10) for s in range(5)}
    with pytest.raises(ValueError):
        shards.write_shards(doc_table(spark, rows).withColumn("slot", F.lit(1)), path)
