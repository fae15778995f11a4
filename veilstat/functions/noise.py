"""Noise distributions and where their uniforms come from.

Quantile and distribution functions take floats or Columns. Noise itself is drawn on the driver: one value for each
released number, from the operating system's generator unless a seed or fixed uniforms are given.
"""

from __future__ import annotations

import hashlib
import math
import random
import secrets
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = float | Column


def _log(x: Number) -> Number:
    return F.ln(x) if isinstance(x, Column) else math.log(x)


def _exp(x: Number) -> Number:
    return F.exp(x) if isinstance(x, Column) else math.exp(x)


def _any_column(*xs: Number) -> bool:
    return any(isinstance(x, Column) for x in xs)


def _col(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def sgn(x: Number) -> Number:
    """-1 below zero, else 1 (so 1 at zero)."""
    return F.when(x < 0, -1.0).otherwise(1.0) if isinstance(x, Column) else (-1.0 if x < 0 else 1.0)


def laplace_quantile(p: Number, mu: Number = 0.0, b: Number = 1.0) -> Number:
    if _any_column(p, mu, b):
        p, mu, b = _col(p), _col(mu), _col(b)
        return F.when(p < 0.5, mu + b * F.ln(2 * p)).otherwise(mu - b * F.ln(2 - 2 * p))
    if p < 0.5:
        return mu + b * math.log(2 * p) if p > 0 else -math.inf
    return mu - b * math.log(2 - 2 * p) if p < 1 else math.inf


def laplace_cdf(x: Number, mu: Number = 0.0, b: Number = 1.0) -> Number:
    if _any_column(x, mu, b):
        x, mu, b = _col(x), _col(mu), _col(b)
        return F.lit(0.5) + F.lit(0.5) * sgn(x - mu) * (1 - F.exp(-F.abs(x - mu) / b))
    return 0.5 + 0.5 * sgn(x - mu) * (1 - math.exp(-abs(x - mu) / b))


def laplace_density(x: Number, mu: Number = 0.0, b: Number = 1.0) -> Number:
    """1/(2b) exp(-|x - mu| / b)."""
    if _any_column(x, mu, b):
        x, mu, b = _col(x), _col(mu), _col(b)
        return F.exp(-F.abs(x - mu) / b) / (2 * b)
    return math.exp(-abs(x - mu) / b) / (2 * b)


class Uniforms:
    """Uniforms in the open unit interval.

    ``Uniforms()`` is secure; ``Uniforms(seed=...)`` repeats; ``Uniforms(fixed=[...])`` gives these values in turn, for tests;
    ``Uniforms.silent()`` turns noise off.
    """

    def __init__(self, seed: int | None = None, fixed: Sequence[float] | None = None):
        self.off = False
        self._fixed, self._next = (list(fixed), 0) if fixed is not None else (None, 0)
        self._random = random.Random(seed) if seed is not None else None

    @classmethod
    def silent(cls) -> Uniforms:
        out = cls()
        out.off = True
        return out

    def draw(self, n: int) -> list[float]:
        return [self._one() for _ in range(n)]

    def _one(self) -> float:
        if self._fixed is not None:
            u = self._fixed[self._next % len(self._fixed)]
            self._next += 1
            return u
        while True:
            u = self._random.random() if self._random else secrets.randbits(53) / 2**53
            if 0 < u < 1:
                return u


def dp_noise(n: int, scale: float | Sequence[float], dist: str = "laplace", shape: float | None = None, source: Uniforms | None = None) -> list[float]:
    """n draws of laplace, gaussian or gamma noise by inverting its distribution; ``scale`` may differ from draw to draw."""
    source = source or Uniforms()
    scales = [float(s) for s in scale] if isinstance(scale, Sequence) else [float(scale)] * n
    if source.off:
        return [0.0] * n
    if dist == "laplace":
        return [laplace_quantile(u, b=s) if s > 0 else 0.0 for u, s in zip(source.draw(n), scales, strict=True)]
    if dist == "gaussian":
        return [NormalDist().inv_cdf(u) * s for u, s in zip(source.draw(n), scales, strict=True)]
    if dist == "gamma":
        return [gamma_quantile(u, shape if shape is not None else 1.0) * s for u, s in zip(source.draw(n), scales, strict=True)]
    raise ValueError(f"distribution {dist!r} should be one of laplace, gaussian, gamma")


def regularized_gamma(a: float, x: float) -> float:
    """Lower incomplete gamma over gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    head = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * head
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - head * h


def gamma_quantile(p: float, shape: float) -> float:
    """Of the gamma distribution with scale 1, by bisection; exact for shape 1."""
    if shape == 1:
        return -math.log1p(-p)
    low, high = 0.0, max(1.0, shape)
    while regularized_gamma(shape, high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if regularized_gamma(shape, mid) < p else (low, mid)
    return (low + high) / 2


def chi_squared_quantile(p: float, df: float) -> float:
    return 2 * gamma_quantile(p, df / 2)


def keyed_uniform(key: Column, seed: int) -> Column:
    """A uniform that depends on a key and a seed only; it is no secret and serves tests alone."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296


def keyed_uniform_value(key: object, seed: int) -> float:
    return (int(hashlib.md5(f"{key}|{seed}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
