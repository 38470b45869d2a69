"""Response kernels of discrete outcomes: loss, score, curvature and third derivatives in the latent value and the cut points.

An ordered outcome falls between two cuts; a and b are the cuts less the latent
value. The logit has closed forms whose terms all have one sign. The probit works
with the mean, variance and third cumulant of the normal on (a, b): by a Gauss-Legendre
rule where the interval is narrow, by log differences on the side that does not
cancel elsewhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from ..spec import Family

LOG_ROOT_2PI = 0.5 * math.log(2 * math.pi)
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(16)
NARROW = 0.5
_erfc = np.vectorize(math.erfc, otypes=[float])


def log_normal_cdf(x: np.ndarray) -> np.ndarray:
    """log of the normal distribution function, by its expansion in the far tail."""
    x = np.asarray(x, float)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        near = np.log(0.5 * _erfc(-np.clip(x, -35, 40) / math.sqrt(2)))
        r = 1 / (x * x)
        far = -0.5 * x * x - np.log(-x) - LOG_ROOT_2PI + np.log1p(-r * (1 - 3 * r * (1 - 5 * r)))
    return np.where(x < -35, far, np.where(np.isposinf(x), 0.0, near))


@dataclass
class Cut:
    """Per row: loss; score g, curvature w, third derivative t in the latent value; and loss, score and curvature by the lower (a) and upper (b) cut."""

    loss: np.ndarray
    g: np.ndarray
    w: np.ndarray
    t: np.ndarray
    loss_a: np.ndarray
    loss_b: np.ndarray
    g_a: np.ndarray
    g_b: np.ndarray
    w_a: np.ndarray
    w_b: np.ndarray


def _logistic_parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distribution function, its complement, density and the density's slope."""
    e = np.exp(-np.abs(x))
    small, large = e / (1 + e), 1 / (1 + e)
    cdf, rest = np.where(x >= 0, large, small), np.where(x >= 0, small, large)
    density = cdf * rest
    return cdf, rest, density, density * (rest - cdf)


def logit_cut(a: np.ndarray, b: np.ndarray) -> Cut:
    low, _, fa, sa = _logistic_parts(a)
    _, high, fb, sb = _logistic_parts(b)
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        gap = b - a
        ends = np.isinf(a) | np.isinf(b)
        width = np.where(ends, 0.0, -np.log(-np.expm1(-gap)))
        ratio = np.where(ends, 0.0, 1 / np.expm1(gap))
    softplus = lambda x: np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))
    loss = width + np.where(np.isposinf(b), 0.0, softplus(-b)) + np.where(np.isneginf(a), 0.0, softplus(a))
    return Cut(loss, high - low, fa + fb, -sa - sb, ratio + low, -ratio - high, -fa, -fb, sa, sb)


def probit_cut(a: np.ndarray, b: np.ndarray) -> Cut:
    flip = a + np.where(np.isinf(b), 0.0, b) > 0
    flip = np.where(np.isposinf(b), a > 0, np.where(np.isneginf(a), False, flip))
    lo, hi = np.where(flip, -b, a), np.where(flip, -a, b)  # now on the lower side
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        top, bottom = log_normal_cdf(hi), log_normal_cdf(lo)
        log_p = top + np.log1p(-np.exp(np.minimum(bottom - top, 0.0)))
        narrow = np.isfinite(lo) & np.isfinite(hi) & (hi - lo <= NARROW)
        if narrow.any():
            c, h = (lo + hi)[narrow] / 2, (hi - lo)[narrow] / 2
            x = h[:, None] * _NODES
            mass = _WEIGHTS * np.exp(-c[:, None] * x - x * x / 2)
            total = mass.sum(1)
            log_p[narrow] = -0.5 * c * c - LOG_ROOT_2PI + np.log(h * total)
        log_density = lambda x: -0.5 * x * x - LOG_ROOT_2PI
        alpha = np.where(np.isinf(a), 0.0, np.exp(log_density(np.where(np.isinf(a), 0.0, a)) - log_p))
        beta = np.where(np.isinf(b), 0.0, np.exp(log_density(np.where(np.isinf(b), 0.0, b)) - log_p))
        za, zb = np.where(np.isinf(a), 0.0, a), np.where(np.isinf(b), 0.0, b)
        a1, b1 = -za * alpha, -zb * beta
        a2, b2 = (za * za - 1) * alpha, (zb * zb - 1) * beta
        laa, lab, lbb = a1 + alpha**2, -alpha * beta, beta**2 - b1
        laaa, laab, labb, lbbb = a2 + 3 * a1 * alpha + 2 * alpha**3, -a1 * beta - 2 * alpha**2 * beta, 2 * alpha * beta**2 - alpha * b1, -b2 + 3 * b1 * beta - 2 * beta**3
        g, w = beta - alpha, laa + 2 * lab + lbb
        t = -(laaa + 3 * laab + 3 * labb + lbbb)
        if narrow.any():
            mass = mass / total[:, None]
            mean = (mass * x).sum(1)
            d = x - mean[:, None]
            g[narrow] = -(c + mean) * np.where(flip[narrow], -1, 1)
            w[narrow] = 1 - (mass * d * d).sum(1)
            t[narrow] = -(mass * d**3).sum(1) * np.where(flip[narrow], -1, 1)
    return Cut(-log_p, g, np.clip(w, 0.0, 1.0), t, alpha, -beta, -(laa + lab), -(lab + lbb), laaa + 2 * laab + labb, laab + 2 * labb + lbbb)


def cut_kernel(family: Family, eta: np.ndarray, code: np.ndarray, cuts: np.ndarray) -> Cut:
    edges = np.r_[-np.inf, cuts, np.inf]
    return (logit_cut if family.link == "logit" else probit_cut)(edges[code] - eta, edges[code + 1] - eta)


@dataclass
class Choice:
    """Per row of a nominal outcome: loss, score and probabilities of the contrasts; curvature is diag(p) - p p'."""

    loss: np.ndarray
    g: np.ndarray
    p: np.ndarray

    @property
    def w(self) -> np.ndarray:
        out = -self.p[:, :, None] * self.p[:, None, :]
        at = np.arange(self.p.shape[1])
        out[:, at, at] += self.p
        return out

    def third(self, b: np.ndarray) -> np.ndarray:
        """Half the trace of b with the curvature's slope in each latent value."""
        p = self.p
        bp = np.einsum("rab,rb->ra", b, p)
        own = np.einsum("raa->ra", b)
        return 0.5 * p * (own - (p * own).sum(1, keepdims=True) - 2 * bp + 2 * (p * bp).sum(1, keepdims=True))


def choice_kernel(eta: np.ndarray, code: np.ndarray) -> Choice:
    z = np.concatenate([np.zeros((len(eta), 1)), eta], 1)
    z = z - z.max(1, keepdims=True)
    e = np.exp(z)
    total = e.sum(1)
    p = e[:, 1:] / total[:, None]
    rows = np.arange(len(code))
    g = p.copy()
    hit = code > 0
    g[rows[hit], code[hit] - 1] -= 1
    return Choice(np.log(total) - z[rows, code], g, p)
