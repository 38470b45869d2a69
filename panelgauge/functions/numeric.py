"""Column expressions: response probabilities, seeded normals, quantiles; and the normal distribution for pandas tasks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def ordinal_logit(eta: Column, thresholds: list[float]) -> list[Column]:
    """Category probabilities of a cumulative logit; each difference is taken on the side where it does not cancel."""
    cuts = [F.lit(float(t)) - eta for t in thresholds]
    out = [logistic(cuts[0])]
    for a, b in zip(cuts, cuts[1:], strict=False):
        # F(b) - F(a) = (1 - exp(a - b)) F(b) (1 - F(a))
        out.append((1 - F.exp(a - b)) * logistic(b) * logistic(-a))
    return [*out, logistic(-cuts[-1])]


def softmax(etas: list[Column]) -> list[Column]:
    top = F.greatest(*etas) if len(etas) > 1 else etas[0]
    e = [F.exp(x - top) for x in etas]
    total = e[0]
    for x in e[1:]:
        total = total + x
    return [x / total for x in e]


def inverse_cdf_label(u: Column, probabilities: list[Column], labels: list) -> Column:
    """The first label whose cumulative probability exceeds u; the last one takes the rest."""
    out, total = F.lit(labels[-1]), None
    cums = []
    for p in probabilities[:-1]:
        total = p if total is None else total + p
        cums.append(total)
    for c, label in list(zip(cums, labels, strict=False))[::-1]:
        out = F.when(u < c, F.lit(label)).otherwise(out)
    return out


def uniform(seed: int, *keys: Column) -> Column:
    """A uniform draw on (0, 1) that depends on the seed and the keys only: retries and partitions don't change it."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def normal(seed: int, *keys: Column) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(TWO_PI * uniform(seed + 7919, *keys))


def normal_cdf(x) -> np.ndarray:
    x = np.asarray(x, float)
    return 0.5 * np.vectorize(math.erfc)(-x / math.sqrt(2))


def quantile6(sorted_values: Column, p: float) -> Column:
    """Type 6 quantile of a sorted array: h = (n + 1) p."""
    n = F.size(sorted_values)
    h = F.least(F.greatest((n + 1) * F.lit(p), F.lit(1.0)), n.cast("double"))
    lo = F.floor(h).cast("int")
    at = lambda i: F.get(sorted_values, F.least(i, n) - 1)
    return at(lo) + (h - lo) * (at(lo + 1) - at(lo))
