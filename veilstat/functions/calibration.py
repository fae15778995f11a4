"""Noise scales, sensitivities, and the exchange of accuracy for epsilon. Floats or Columns.

Accuracy a at level alpha means: with probability 1 - alpha the released value is within a of the true one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .noise import Number, _log, laplace_quantile

DEFAULT_DELTA = 2.0**-30


def _sqrt(x: Number) -> Number:
    return F.sqrt(x) if isinstance(x, Column) else math.sqrt(x)


def laplace_accuracy(sens: Number, epsilon: Number, alpha: Number = 0.05) -> Number:
    return -1 * _log(alpha) * sens / epsilon


def laplace_epsilon(sens: Number, accuracy: Number, alpha: Number = 0.05) -> Number:
    return -1 * _log(alpha) * sens / accuracy


def stability_accuracy(sens: Number, epsilon: Number, delta: Number = DEFAULT_DELTA, alpha: Number = 0.05) -> Number:
    return sens * _log(2 / (alpha * delta)) / epsilon + 1


def stability_epsilon(sens: Number, accuracy: Number, delta: Number = DEFAULT_DELTA, alpha: Number = 0.05) -> Number:
    return sens * _log(2 / (alpha * delta)) / (accuracy - 1)


def histogram_accuracy(mechanism: str, sens: float, epsilon: float, delta: float = DEFAULT_DELTA, alpha: float = 0.05) -> float:
    return stability_accuracy(sens, epsilon, delta, alpha) if mechanism == "mechanismStability" else laplace_accuracy(sens, epsilon, alpha)


def histogram_epsilon(mechanism: str, sens: float, accuracy: float, delta: float = DEFAULT_DELTA, alpha: float = 0.05) -> float:
    return stability_epsilon(sens, accuracy, delta, alpha) if mechanism == "mechanismStability" else laplace_epsilon(sens, accuracy, alpha)


def stability_threshold(epsilon: Number, delta: Number) -> Number:
    return 1 + 2 * _log(2 / delta) / epsilon


def glm_accuracy(epsilon: Number, n: Number, alpha: Number = 0.05) -> Number:
    return -1 * _log(alpha) / (n * epsilon)


def glm_epsilon(accuracy: Number, n: Number, alpha: Number = 0.05) -> Number:
    return -1 * _log(alpha) / (n * accuracy)


def _tree_factor(low: Number, high: Number, gran: Number, alpha: Number) -> Number:
    size = (high - low) / gran + 1
    levels = _log(size) / math.log(2)
    return 2 * math.sqrt(2) * _sqrt(_log(2 / alpha)) * levels * _sqrt(levels)


def tree_accuracy(epsilon: Number, low: Number, high: Number, gran: Number, alpha: Number = 0.05) -> Number:
    return _tree_factor(low, high, gran, alpha) / epsilon


def tree_epsilon(accuracy: Number, low: Number, high: Number, gran: Number, alpha: Number = 0.05) -> Number:
    return _tree_factor(low, high, gran, alpha) / accuracy


def mean_sensitivity(low: Number, high: Number, n: Number) -> Number:
    return (high - low) / n


def variance_sensitivity(n: Number, low: Number, high: Number) -> Number:
    return (high - low) * (high - low) / n


def covariance_sensitivity(n: int, ranges: list[tuple[float, float]], intercept: bool = False) -> list[float]:
    """Of the entries of the lower triangle, column by column; those of an intercept are 0."""
    width = [0.0] * intercept + [high - low for low, high in ranges]
    return [2 / n * width[i] * width[j] for j in range(len(width)) for i in range(j, len(width))]


HISTOGRAM_SENSITIVITY = 2.0


def tree_sensitivity(low: Number, high: Number, gran: Number) -> Number:
    return 2 * _log((high - low) / gran + 1) / math.log(2)


def gaussian_scale(sens: Number, epsilon: Number, delta: Number) -> Number:
    return sens * _sqrt(2 * _log(1.25 / delta)) / epsilon


def laplace_half_width(sens: Number, epsilon: Number, alpha: float) -> Number:
    """Half the width of a 1 - alpha interval around a value with Laplace noise."""
    return laplace_quantile(1 - alpha / 2) * sens / epsilon
