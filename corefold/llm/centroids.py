"""Centroid clustering on bit planes.

Components become integers; the k-th bits of a vector's components are one plane,
packed into unsigned 64-bit words (one word for up to 64 components). With w(k) the
weight of plane k in two's complement, dot(x, c) is the sum of
w(i) * w(j) * popcount(x's plane i AND c's plane j), exactly, and so is the squared
distance |x|^2 - 2 dot(x, c) + |c|^2.

Vectors are packed once and written; every round reads the planes, and a task gives
one row per cluster and component whatever it has read. Only those k x dims sums pass
through the driver. No row is moved by its cluster, so a cluster with most of the
vectors costs no more than another.

Odd rows: a null vector, one of another length, or one with a null or non-finite entry
takes no part and gives no row. Repeated rows count as often as they stand. A row
without id takes part, but is the last to become a starting centroid. Fewer vectors
than k give fewer centroids, none gives no row. A distance tie goes to the smaller
cluster number. Components need at most 27 bits after scaling, which keeps a squared
distance of 64 components inside a long; longer ones raise an error."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corefold.llm.common import written
from corefold.llm.vectors import arrow_map, finite_rows, floored

MAX_BITS = 27


def weights(planes: int) -> np.ndarray:
    """Two's complement: the last plane counts negative."""
    out = np.int64(1) << np.arange(planes, dtype=np.int64)
    out[-1] = -out[-1]
    return out


def to_planes(x: np.ndarray) -> np.ndarray:
    """(rows, dims) integers -> (rows, planes, words) of uint64, as few planes as the
    largest value needs."""
    planes = int(np.abs(x).max(initial=0)).bit_length() + 1
    words = -(-x.shape[1] // 64)
    wide = np.zeros((len(x), planes, words * 64), np.uint8)
    for k in range(planes):
        wide[:, k, : x.shape[1]] = (x >> k) & 1
    return np.packbits(wide, axis=2, bitorder="little").view("<u8")


def widen(planes: np.ndarray, to: int) -> np.ndarray:
    """The same integers in more planes: the sign's plane is repeated."""
    return np.concatenate([planes, np.repeat(planes[:, -1:], to - planes.shape[1], axis=1)], axis=1)


def from_bytes(column: pa.Array, words: int) -> np.ndarray:
    rows = [np.frombuffer(b, "<u8").reshape(-1, words) for b in column.to_pylist()]
    most = max(len(r) for r in rows)
    if all(len(r) == most for r in rows):
        return np.stack(rows)
    return np.stack([widen(r[None], most)[0] for r in rows])


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(rows, planes, words) and (planes, words) -> exact dot products."""
    total = np.zeros(x.shape[:2], np.int64)
    for plane, weight in zip(c, weights(len(c))):
        total += weight * np.bitwise_count(x & plane).sum(axis=2, dtype=np.int64)
    return total @ weights(x.shape[1])


def pack(df: DataFrame, vector: str, dims: int, scale: int, key: str) -> DataFrame:
    """key, planes (little-endian words, plane by plane), norm of the vectors that take part."""
    kind = df.select(key).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows, size, values = finite_rows(batch.column(1))
            kept = size == dims
            x = floored(values[kept][:, :dims], scale, MAX_BITS)
            if len(x):
                planes = to_planes(x)
                yield {"key": batch.column(0).take(pa.array(rows[kept])), "planes": [p.tobytes() for p in planes], "norm": (x * x).sum(axis=1)}

    return arrow_map(df.select(F.col(key).alias("key"), F.col(vector).alias("vector")), run, f"key {kind}, planes binary, norm long")


def nearest(planes: np.ndarray, norm: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid."""
    distance = np.empty((len(planes), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        c = np.array([c], np.int64)
        distance[:, k] = norm - 2 * dots(planes, to_planes(c)[0]) + (c * c).sum()
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(best)), best]


def assign(packed: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """key, cluster, distance."""
    words, kind = -(-len(centroids[0]) // 64), dict(packed.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if batch.num_rows:
                best, distance = nearest(from_bytes(batch.column(1), words), np.asarray(batch.column(2)), centroids)
                yield {"key": batch.column(0), "cluster": best, "distance": distance}

    return arrow_map(packed.select("key", "planes", "norm"), run, f"key {kind}, cluster int, distance long")


def sums(packed: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """cluster, dim, total: the component sums of the vectors nearest to each
    centroid; dim -1 has their number. One row per cluster and dim leaves a task."""
    dims, words = len(centroids[0]), -(-len(centroids[0]) // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros((len(centroids), dims + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            planes = from_bytes(batch.column(0), words)
            best, _ = nearest(planes, np.asarray(batch.column(1)), centroids)
            bits = np.unpackbits(planes.view(np.uint8), axis=2, bitorder="little", count=dims)
            for k in np.unique(best):
                of = best == k
                total[k, :dims] += weights(planes.shape[1]) @ bits[of].sum(axis=0, dtype=np.int64)
                total[k, dims] += of.sum()
        cluster, dim = np.nonzero(total)
        yield {"cluster": cluster, "dim": np.where(dim == dims, -1, dim), "total": total[cluster, dim]}

    parts = arrow_map(packed.select("planes", "norm"), run, "cluster int, dim int, total long")
    return parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total"))


def starts(packed: DataFrame, k: int, dims: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of ``seed:key``; equal keys by their planes."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = packed.select("planes", mark.alias("mark")).orderBy(F.asc_nulls_last("mark"), "planes").limit(k).collect()
    out = []
    for row in first:
        planes = from_bytes(pa.array([row["planes"]], pa.binary()), -(-dims // 64))
        bits = np.unpackbits(planes.view(np.uint8), axis=2, bitorder="little", count=dims)[0]
        out.append((weights(len(bits)) @ bits.astype(np.int64)).tolist())
    return out


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """Lloyd's rounds from the seeded starting vectors: key, cluster, distance,
    cluster_inertia, inertia, centroid (the final one's integers)."""
    packed = written(pack(df, vector, dims, scale, key), "planes")
    centroids = starts(packed, k, dims, seed)
    spark, kind = df.sparkSession, dict(packed.dtypes)["key"]
    if not centroids:
        return spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    for _ in range(rounds):
        total = {(r["cluster"], r["dim"]): r["total"] for r in sums(packed, centroids).collect()}
        for c in range(len(centroids)):
            if count := total.get((c, -1)):
                centroids[c] = [total.get((c, d), 0) // count for d in range(dims)]
    assigned = written(assign(packed, centroids), "assigned")
    inertia = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    rows = [(c, inertia.get(c, 0), sum(inertia.values()), centroids[c]) for c in range(len(centroids))]
    final = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return assigned.join(F.broadcast(final), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
