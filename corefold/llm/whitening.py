"""Embedding whitening by polarisation.

Components become integers x. Every variance comes from exact integers: with y = x - m,
m the whole part of the mean, the fit aggregates the squares of y for every dimension
and of y(i) + y(j) for every pair of dimensions. The variance of a sum tells the
covariance, cov(i, j) = (var(i + j) - var(i) - var(j)) / 2; what is left of the mean is
taken off exactly before the one division. ``eigh`` then works on dims x dims doubles.

The fit list holds each distinct vector once. Copies meet by the vector's bytes, with a
partial aggregate before the shuffle, so a vector that makes up a third of the rows is
one row per task. Sums leave a task as one row per pair of dimensions, and
dims x (dims + 1) / 2 of them reach the driver.

Odd rows: a row whose vector is null or holds a null or non-finite entry takes no part.
A shorter vector counts as zero in the dimensions it lacks, in the fit as well as in the
result; an empty one is all zero. Repeated rows each get a result. Components whose
eigenvalue is not above 1e-12 of the largest (fewer distinct vectors than dimensions,
constant dimensions) cannot be whitened and give no row; a single distinct vector gives
none at all. Equal eigenvalues have any orthonormal vectors. Components need at most 40
bits after scaling, larger ones raise an error."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corefold.llm.common import written
from corefold.llm.vectors import arrow_map, finite_rows, floored

MAX_BITS = 40
STEP = 2048  # vectors whose pair sums are formed at once
LEAST = 1e-12


def encode(x: np.ndarray, size: np.ndarray) -> list[bytes]:
    """A row's integers in 2 bytes each if all fit, else in 8, after a byte that tells
    which: equal vectors, equal bytes."""
    narrow = (np.abs(x) < 1 << 15).all(axis=1)
    low, high = x.astype("<i2"), x.astype("<i8")
    return [b"\0" + low[i, :n].tobytes() if narrow[i] else b"\1" + high[i, :n].tobytes() for i, n in enumerate(size.tolist())]


def decode(column: pa.Array, dims: int) -> np.ndarray:
    rows = column.to_pylist()
    if len({(b[0], len(b)) for b in rows}) == 1:
        kind = "<i8" if rows[0][0] else "<i2"
        x = np.frombuffer(b"".join(b[1:] for b in rows), kind).reshape(len(rows), -1).astype(np.int64)
        return np.pad(x, ((0, 0), (0, dims - x.shape[1])))
    out = np.zeros((len(rows), dims), np.int64)
    for i, b in enumerate(rows):
        x = np.frombuffer(b[1:], "<i8" if b[0] else "<i2")
        out[i, : len(x)] = x
    return out


def exactly(y: np.ndarray, most: int) -> np.ndarray:
    """As Python's integers where sums of products up to ``most`` leave 63 bits."""
    return y if most < 1 << 62 else y.astype(object)


def pack(df: DataFrame, vector: str, scale: int, key: str) -> DataFrame:
    """key, x (the integers' bytes), dims of the rows that take part."""
    kind = df.select(key).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows, size, values = finite_rows(batch.column(1))
            if len(rows):
                yield {"key": batch.column(0).take(pa.array(rows)), "x": encode(floored(values, scale, MAX_BITS), size), "dims": size}

    return arrow_map(df.select(F.col(key).alias("key"), F.col(vector).alias("vector")), run, f"key {kind}, x binary, dims int")


def dimension_sums(fit_list: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(dims + 1, object)
        for batch in batches:
            if batch.num_rows:
                x = decode(batch.column(0), dims)
                total[:dims] += x.sum(axis=0)
                total[dims] += len(x)
        yield {"dim": np.arange(dims + 1), "total": [str(v) for v in total]}

    parts = arrow_map(fit_list.select("x"), run, "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    total = {r["dim"]: int(r["total"]) for r in parts.collect()}
    return total.get(dims, 0), [total.get(d, 0) for d in range(dims)]


def squares(y: np.ndarray) -> np.ndarray:
    """(rows, dims) -> the sums over the rows of y(i)^2 for i = j and of
    (y(i) + y(j))^2 for i < j, in the order of ``np.triu_indices``."""
    y = exactly(y, 4 * int(np.abs(y).max(initial=0)) ** 2 * len(y)).T
    out = []
    for i in range(len(y)):
        both = np.concatenate([y[i : i + 1], y[i] + y[i + 1 :]])
        out.append((both * both).sum(axis=1))
    return np.concatenate(out).astype(object)


def square_sums(fit_list: DataFrame, middle: list[int]) -> list[int]:
    """``squares`` over all vectors less ``middle``."""
    dims = len(middle)
    pairs = dims * (dims + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(pairs, object)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                total += squares(decode(batch.column(0).slice(at, STEP), dims) - np.array(middle, np.int64))
        yield {"pair": np.arange(pairs), "total": [str(v) for v in total]}

    parts = arrow_map(fit_list.select("x"), run, "pair int, total string").groupBy("pair").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    total = {r["pair"]: int(r["total"]) for r in parts.collect()}
    return [total.get(p, 0) for p in range(pairs)]


def covariance(n: int, rest: list[int], square: list[int]) -> np.ndarray:
    """From the sums of y and the sums of squares; one rounding per entry."""
    dims = len(rest)
    at = iter(square)
    spread = {(i, j): n * next(at) - (rest[i] + rest[j] if i < j else rest[i]) ** 2 for i in range(dims) for j in range(i, dims)}
    out = np.empty((dims, dims))
    for (i, j), both in spread.items():
        out[i, j] = out[j, i] = (both - spread[i, i] - spread[j, j]) / (2 * n * n) if i < j else both / (n * n)
    return out


@dataclass
class Whitening:
    """n vectors with dimension sums; eigenvalues by size, a column of ``vectors`` each."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float = 0.0

    def usable(self, components: int) -> int:
        """How many of the first components have an eigenvalue to divide by."""
        return int((self.values[:components] > LEAST * max(self.values[0], 0.0)).sum()) if len(self.values) else 0

    def explained(self) -> np.ndarray:
        return self.values / np.trace(self.covariance)

    def apply(self, x: np.ndarray, components: int) -> np.ndarray:
        middle = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return ((x - middle) - rest) @ self.vectors[:, :components] / np.sqrt(self.values[:components])

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Exact sum over the dimensions of (n * x - sum)^2."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, *map(abs, self.sums), 0)
        far = exactly(x, 4 * most * most * max(len(self.sums), 1)) * self.n - np.array(self.sums, object if 4 * most * most * max(len(self.sums), 1) >= 1 << 62 else np.int64)
        return (far * far).sum(axis=1)


def moments(fit_list: DataFrame, model: Whitening, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the whitened fit list."""
    dims = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros((components + 1, components))
        for batch in batches:
            if batch.num_rows:
                w = model.apply(decode(batch.column(0), dims), components)
                total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield {"cell": np.arange(total.size), "total": total.reshape(-1)}

    parts = arrow_map(fit_list.select("x"), run, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total"))
    total = {r["cell"]: r["total"] for r in parts.collect()}
    flat = np.array([total[c] for c in range((components + 1) * components)]).reshape(components + 1, components) / model.n
    return flat[-1], flat[:-1] - np.outer(flat[-1], flat[-1])


def fit(packed: DataFrame, components: int) -> Whitening:
    """The model of packed vectors, checked on the fit list: ``identity_error`` is the
    largest entry of the whitened covariance less the identity."""
    dims = packed.agg(F.max("dims")).first()[0] or 0
    fit_list = written(packed.select("x").distinct(), "fit")
    n, total = dimension_sums(fit_list, dims)
    if not n or not dims:
        return Whitening(n, total, np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    middle = [s // n for s in total]
    matrix = covariance(n, [s - n * m for s, m in zip(total, middle)], square_sums(fit_list, middle))
    values, vectors = np.linalg.eigh(matrix)
    model = Whitening(n, total, matrix, values[::-1].copy(), vectors[:, ::-1].copy())
    if usable := model.usable(components):
        model.identity_error = float(np.abs(moments(fit_list, model, usable)[1] - np.eye(usable)).max())
    return model


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """key, component, n, deviation (decimal), whitened, explained, identity_error: a
    row per vector that takes part and usable component."""
    packed = written(pack(df, vector, scale, key), "packed")
    model = fit(packed, components)
    dims, kind, usable = len(model.sums), dict(packed.dtypes)["key"], model.usable(components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if batch.num_rows and usable:
                x = decode(batch.column(1), dims)
                yield {"key": batch.column(0), "deviation": [str(v) for v in model.deviation(x).tolist()], "whitened": model.apply(x, usable).tolist()}

    rows = arrow_map(packed.select("key", "x"), run, f"key {kind}, deviation string, whitened array<double>")
    share = F.array(*[F.lit(float(v)) for v in model.explained()[:usable]]) if usable else F.array(F.lit(0.0))
    return rows.select("key", F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("at")].alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
