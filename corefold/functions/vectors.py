"""Column expressions over ``array<double>`` vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-100  # floor of norms and probabilities
# Model tables (centroids) travel to the tasks inside the expression; their
# size is checked against this number of doubles (64 MB).
MAX_MODEL_CELLS = 8_000_000


def vsum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def abs_cosine(a: Column, b: Column) -> Column:
    return F.abs(dot(a, b)) / F.greatest(F.lit(EPS), norm(a) * norm(b))


def kl(p: Column, q: Column, eps: float = EPS) -> Column:
    floor = F.lit(eps)
    return vsum(
        F.zip_with(
            p, q,
            lambda x, y: x * (F.ln(F.greatest(x, floor)) - F.ln(F.greatest(y, floor))),
        )
    )


def symmetric_kl(p: Column, q: Column, eps: float = EPS) -> Column:
    return kl(p, q, eps) + kl(q, p, eps)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, not once per lambda call."""
    return F.element_at(F.transform(F.array(value), body), 1)


def logsumexp(a: Column) -> Column:
    return let(
        F.array_max(a),
        lambda peak: peak + F.ln(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - peak))),
    )


def softmax(a: Column) -> Column:
    return let(logsumexp(a), lambda total: F.transform(a, lambda x: F.exp(x - total)))


def unit(a: Column) -> Column:
    """Vector of length one (zeros stay), so that a cosine is one product."""
    return let(F.greatest(F.lit(EPS), norm(a)), lambda n: F.transform(a, lambda x: x / n))


def pair_vector(a: Column, b: Column) -> Column:
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: x * y))


def pair_features(lemma_a: Column, lemma_b: Column, a: Column, b: Column) -> Column:
    """[same lemma, absolute cosine]; the vectors are of unit length."""
    return F.array((lemma_a == lemma_b).cast("double"), F.abs(dot(a, b)))


def pad_or_truncate(a: Column, length: int, pad: Column) -> Column:
    return F.slice(F.concat(a, F.array_repeat(pad, length)), 1, length)


def one_hot(index: Column, size: int) -> Column:
    """Unit vector; an index at or past ``size`` gives the uniform vector."""
    slots = F.sequence(F.lit(0), F.lit(size - 1))
    return F.when(
        index < size,
        F.transform(slots, lambda k: F.when(k == index, 1.0).otherwise(0.0)),
    ).otherwise(F.array_repeat(F.lit(1.0 / size), size))


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series at x + 8, stepped back."""
    y = x + 8
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.ln(x + i)
    return series - shift


def log_rising_factorial(a: Column, n: Column) -> Column:
    """ln(a (a+1) ... (a+n-1)); 0 for n = 0."""
    return F.when(n > 0, log_gamma(a + n) - log_gamma(a)).otherwise(0.0)


def gaussian_posterior(x: Column, centroids: Sequence[Sequence[float]], variances) -> Column:
    """Softmax over clusters of -|x - c|^2 / (2 var), an ``array<double>``.

    ``centroids`` is a fitted model (K rows, size checked); the product with the
    data is one matrix product per Arrow batch."""
    means = np.asarray(centroids, dtype=float)
    if means.size > MAX_MODEL_CELLS:
        raise ValueError("centroid table too large for the tasks; lower K or the width")
    scale = np.broadcast_to(np.asarray(variances, dtype=float), (means.shape[0],))
    half = (means**2).sum(axis=1) / 2.0

    @F.pandas_udf("array<double>")
    def posterior(batch: pd.Series) -> pd.Series:
        if len(batch) == 0:
            return pd.Series([], dtype=object)
        rows = np.stack([np.asarray(v, dtype=float) for v in batch])
        logit = (rows @ means.T - half - (rows**2).sum(axis=1, keepdims=True) / 2.0) / scale
        logit -= logit.max(axis=1, keepdims=True)
        mass = np.exp(logit)
        return pd.Series(list(mass / mass.sum(axis=1, keepdims=True)))

    return posterior(x)
