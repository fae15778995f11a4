"""Generalized linear models by objective perturbation. Experimental.

A convex loss summed over the rows is minimised with a random linear term, whose size the privacy loss sets, by Newton's
method: each step is one distributed aggregate that gives the loss, its gradient and its curvature together; least squares needs only the cross
products, which one pass gives. Values imputed at random are written once, so that all steps see the same. Rows are scaled into the unit ball by the largest row norm (which is taken from the data and
so is not itself private).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calibration as cal
from ..functions import validate as v
from ..functions.noise import Uniforms, dp_noise
from ..operators import clean, mechanisms
from ..sources.shared import written
from .regression import parse_formula

CURVATURE = 0.25


def _softplus(z: Column) -> Column:
    return F.when(z > 0, z + F.log1p(F.exp(-z))).otherwise(F.log1p(F.exp(z)))


#: A published polynomial of the complementary error function, its relative error below 1.2e-7 everywhere.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _normal_log_cdf(z: Column) -> Column:
    """ln of the normal distribution function, in both tails to seven digits."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    poly = F.lit(0.0)
    for c in reversed(ERFC):
        poly = poly * t + c
    tail = F.log(t) - x * x + poly - math.log(2)
    return F.when(z < 0, tail).otherwise(F.log1p(-F.exp(tail)))


def loss_terms(objective: str, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Log likelihood of one row for the linear predictor z, its derivative, and minus its second derivative."""
    if objective == "logit":
        p = 1 / (1 + F.exp(-z))
        return y * z - _softplus(z), y - p, p * (1 - p)
    if objective == "probit":
        ratio = lambda u: F.exp(-u * u / 2 - math.log(2 * math.pi) / 2 - _normal_log_cdf(u))
        one, none = ratio(z), ratio(-z)
        return y * _normal_log_cdf(z) + (1 - y) * _normal_log_cdf(-z), y * one - (1 - y) * none, y * one * (one + z) + (1 - y) * none * (none - z)
    if objective == "poisson":
        return y * z - F.exp(z), y - F.exp(z), F.exp(z)
    raise ValueError(f"objective {objective!r} should be one of logit, probit, poisson, ols")


Step = tuple[float, np.ndarray, np.ndarray]


def newton(f: Callable[[np.ndarray], Step], start: np.ndarray, tolerance: float = 1e-9, most: int = 100) -> np.ndarray:
    """The minimum of a convex function that gives its value, gradient and curvature; steps that do not lower it are halved.

    Raises where ``most`` evaluations do not make the gradient small.
    """
    x = np.asarray(start, float)
    value, slope, curve = f(x)
    done = 1
    while np.abs(slope).max() > tolerance:
        move = np.linalg.solve(curve + 1e-12 * np.eye(len(x)), slope)
        size = 1.0
        while True:
            got = f(x - size * move)
            done += 1
            if got[0] <= value + 1e-12 * abs(value) and math.isfinite(got[0]):
                break
            size /= 2
            if done > most or size < 1e-9:
                raise RuntimeError(f"no minimum found in {done} evaluations; the data may be separable")
        x = x - size * move
        small = np.abs(size * move).max() <= 1e-12 * (1 + np.abs(x).max())
        value, slope, curve = got
        if small:
            break
        if done > most:
            raise RuntimeError(f"no minimum found in {done} evaluations; the data may be separable")
    return x


def perturbation(dim: int, epsilon: float, n: int, source: Uniforms | None = None) -> tuple[np.ndarray, float]:
    """The random linear term and the ridge weight: the direction is uniform, the length has a gamma distribution."""
    source = source or Uniforms()
    ridge = max(1.0, CURVATURE / (n * math.expm1(epsilon / 2)) + 0.001)
    t = CURVATURE / (n * ridge)
    left = epsilon - math.log(1 + 2 * t + t * t)
    if source.off:
        return np.zeros(dim), ridge
    length = dp_noise(1, 2 / left, "gamma", 1.0, source)[0]
    direction = np.array(dp_noise(dim, 1.0, "gaussian", source=source))
    return length * direction / np.linalg.norm(direction), ridge


@dataclass
class GlmSpec:
    """objective: logit, probit, poisson or ols. With ``n_boot``, that many releases on resampled rows, each with an equal part of epsilon."""

    formula: str
    objective: str
    n: int
    rng: Sequence[Sequence[float]]
    var_type: str = "numeric"
    epsilon: float | None = None
    accuracy: float | None = None
    impute_rng: Sequence | None = None
    intercept: bool = True
    n_boot: int | None = None
    alpha: float = 0.05
    names: list[str] = field(init=False)

    def __post_init__(self):
        self.y, self.xs = parse_formula(self.formula)
        self.var_type = v.check_variable_type(self.var_type, ("numeric", "integer", "logical"))
        v.check_n(self.n)
        self.rng = v.check_ranges(self.rng, self.var_type, 1 + len(self.xs))
        self.impute_rng = [v.check_impute_range(i, r, self.var_type) for i, r in zip(self.impute_rng or [None] * len(self.rng), self.rng)]
        if self.epsilon is None:
            v.check_accuracy(self.accuracy)
            self.epsilon = cal.glm_epsilon(self.accuracy, self.n, self.alpha)
        v.check_epsilon(self.epsilon)
        self.accuracy = cal.glm_accuracy(self.epsilon, self.n, self.alpha)
        self.names = ["intercept"] * self.intercept + self.xs

    def fit(self, df: DataFrame, epsilon: float, source: Uniforms | None, weight: Column | None = None) -> list[float]:
        """Coefficients, for ols followed by the variance. ``df`` has bounded, imputed columns."""
        w = weight if weight is not None else F.lit(1.0)
        scale = df.agg(F.max(clean.row_norm(self.xs))).first()[0] or 1.0
        y_scale = (df.agg(F.sqrt(F.sum(F.col(self.y) ** 2))).first()[0] or 1.0) if self.objective == "ols" else 1.0
        xs = [F.lit(1.0)] * self.intercept + [F.col(x) / scale for x in self.xs]
        y = F.col(self.y) / y_scale
        dim = len(xs) + (self.objective == "ols")
        b, ridge = perturbation(dim, epsilon, self.n, source)
        if self.objective == "ols":
            terms = [*xs, y]
            pairs = [(i, j) for i in range(len(terms)) for j in range(i + 1)]
            row = df.agg(*[F.sum(w * terms[i] * terms[j]) for i, j in pairs]).first()
            g = np.zeros((len(terms),) * 2)
            for (i, j), value in zip(pairs, row):
                g[i, j] = g[j, i] = value

            def objective(theta: np.ndarray) -> Step:
                """In the coefficients over the standard deviation, and one over that, least squares is convex."""
                v = np.append(-theta[:-1], theta[-1])
                value = -math.log(theta[-1]) + v @ g @ v / (2 * self.n) if theta[-1] > 0 else math.inf
                turn = np.append(-np.ones(len(theta) - 1), 1.0)
                slope, curve = turn * (g @ v) / self.n, turn[:, None] * g * turn / self.n
                if theta[-1] > 0:
                    slope[-1] -= 1 / theta[-1]
                    curve[-1, -1] += theta[-1] ** -2
                return value - b @ theta / self.n, slope - b / self.n, curve

            theta = newton(objective, np.append(np.zeros(dim - 1), 1 / math.sqrt(max(g[-1, -1] / self.n, 1e-12))))
            theta = np.append(theta[:-1] / theta[-1], -2 * math.log(theta[-1]))
        else:
            pairs = [(i, j) for i in range(dim) for j in range(i + 1)]

            def objective(theta: np.ndarray) -> Step:
                z = sum((x * float(t) for x, t in zip(xs, theta)), F.lit(0.0))
                like, first, second = loss_terms(self.objective, F.col("__y"), F.col("__z"))
                rows = df.select(y.alias("__y"), z.alias("__z"), w.alias("__w"), *[x.alias(f"__x{k}") for k, x in enumerate(xs)])
                rows = rows.select("*", like.alias("__l"), (F.col("__w") * first).alias("__f"), (F.col("__w") * second).alias("__s"))
                x = [F.col(f"__x{k}") for k in range(dim)]
                row = rows.agg(F.sum(F.col("__w") * F.col("__l")), *[F.sum(F.col("__f") * c) for c in x], *[F.sum(F.col("__s") * x[i] * x[j]) for i, j in pairs]).first()
                got = np.array([0.0 if r is None else r for r in row])
                curve = np.zeros((dim, dim))
                for (i, j), value in zip(pairs, got[1 + dim :]):
                    curve[i, j] = curve[j, i] = value
                own = ridge if self.objective == "logit" else 0.0
                return (own / 2 * theta @ theta - b @ theta - got[0]) / self.n, (own * theta - b - got[1 : 1 + dim]) / self.n, (curve + own * np.eye(dim)) / self.n

            theta = newton(objective, np.zeros(dim))
        out = [t * (y_scale if self.objective == "ols" else 1.0) / (1.0 if self.intercept and i == 0 else scale) for i, t in enumerate(theta[: len(xs)])]
        return out + ([math.exp(theta[-1]) * y_scale**2] if self.objective == "ols" else [])

    def release(self, df: DataFrame, source: Uniforms | None = None, uniform: Column | None = None, seed: int | None = None) -> dict[str, Any]:
        own = mechanisms.prepared(df, [self.y, *self.xs], self.var_type, self.rng, self.impute_rng, uniform=uniform)
        with written(mechanisms.placed(own)) as held:
            if not self.n_boot:
                got = self.fit(held, self.epsilon, source)
                return {"coefficients": dict(zip(self.names, got)), "epsilon": self.epsilon, "accuracy": self.accuracy} | ({"variance": got[-1]} if self.objective == "ols" else {})
            rows, found = mechanisms.numbered(held)
            mechanisms.check_rows(found, self.n)
            with written(mechanisms.drawn_rows(rows, self.n, self.n_boot, seed)) as drawn:
                draws = [self.fit(drawn.where(F.col("__replica") == k), self.epsilon / self.n_boot, source, F.col("__times")) for k in range(self.n_boot)]
            return {"draws": draws, "summary": summarize(draws, self.names + ["variance"] * (self.objective == "ols"), self.alpha), "epsilon": self.epsilon}


def summarize(draws: Sequence[Sequence[float]], names: Sequence[str], alpha: float = 0.05) -> dict[str, dict[str, float]]:
    """Mean, spread and 95 % limits of each coefficient over the releases, after trimming alpha of them."""
    out = {}
    for name, values in zip(names, np.asarray(draws, float).T):
        low, high = np.quantile(values, [alpha / 2, 1 - alpha / 2])
        kept = values[(values >= low) & (values <= high)]
        out[name] = {"estimate": float(kept.mean()), "std_error": float(kept.std(ddof=1)) if len(kept) > 1 else 0.0, "lower": float(np.quantile(kept, 0.025)), "upper": float(np.quantile(kept, 0.975))}
    return out


def scale_release(estimates: Sequence[float], x_scale: float, y_scale: float | None = None) -> list[float]:
    """All times the scale of y, all but the first over the scale of x."""
    return [e * (y_scale if y_scale is not None else 1.0) / (1.0 if i == 0 else x_scale) for i, e in enumerate(estimates)]
