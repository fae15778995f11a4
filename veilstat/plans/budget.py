"""Splitting a privacy budget over releases, and a ledger of what was spent."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .composition import is_private

LEDGER = "stat string, epsilon double, delta double, held boolean"


class HeldOverBudget(ValueError):
    """What is held exceeds the budget by itself."""


def scale_epsilons(eps: Sequence[float], deltas: Sequence[float], budget: float, delta: float, free: Sequence[int], err: float = 0.01, tolerance: float = 1e-4) -> list[float]:
    """The free epsilons times the largest common factor under which all releases are within the budget, found to the tolerance;
    where their sum is still below it, the rest is handed out evenly."""
    low, high, best = 0.0, budget / max(eps), [0.0 if i in set(free) else e for i, e in enumerate(eps)]
    while high - low > tolerance:
        factor = (low + high) / 2
        trial = [e * factor if i in set(free) else e for i, e in enumerate(eps)]
        if is_private(list(zip(trial, deltas, strict=True)), delta, budget, err):
            low, best = factor, trial
        else:
            high = factor
    missing = budget - sum(best)
    if missing > 0 and free:
        best = [e + missing / len(free) if i in set(free) else e for i, e in enumerate(best)]
    return best


def update_parameters(params: Sequence[tuple[float | None, float]], hold: Sequence[int], epsilon: float, delta: float, err: float = 0.01) -> list[tuple[float, float]]:
    """New pairs (epsilon, delta) after releases were added or dropped; those at the places ``hold`` keep theirs.

    Whatever is free is scaled by one factor, so only two things are to be found: which releases are free, and what they start from.
    New ones (no epsilon yet) start at the mean of the free ones that have one. Where those differ, new ones are first given their
    share beside an even split, and then stay while the others are scaled in proportion. A single release gets everything.
    """
    k = len(params)
    if k == 1:
        return [(epsilon, delta)]
    deltas = [d for _, d in params]
    free = set(range(k)) - set(hold)
    new = {i for i, (e, _) in enumerate(params) if not e}

    def scaled(start: dict[int, float], over: set[int]) -> list[float]:
        return scale_epsilons([start[i] for i in range(k)], deltas, epsilon, delta, sorted(over), err)

    known = {i: params[i][0] for i in range(k) if i not in new}
    old = [known[i] for i in sorted(free - new)]
    if not new:
        if hold and not is_private([(0.0 if i in free else known[i], deltas[i]) for i in range(k)], delta, epsilon, err):
            raise HeldOverBudget("the releases that are held need more than the whole budget")
        found = scaled(known, free)
    else:
        level = sum(old) / len(old) if old else 1.0
        found = scaled({i: level if i in free or not known else known.get(i, 0.0) for i in range(k)}, free)
        if old and min(old) < max(old):
            share = found[min(free)]
            found = scaled(known | dict.fromkeys(new, share), free - new)
    return list(zip(found, deltas))


class Ledger:
    """A table of releases under one global budget. Spending is checked before a release is made."""

    def __init__(self, spark: SparkSession, epsilon: float, delta: float, rows: Sequence[tuple[str, float, float, bool]] = ()):
        self.spark, self.epsilon, self.delta, self.rows = spark, epsilon, delta, list(rows)

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, LEDGER)

    def totals(self) -> DataFrame:
        return self.frame().agg(F.sum("epsilon").alias("epsilon"), F.sum("delta").alias("delta"))

    def fits(self, epsilon: float, delta: float) -> bool:
        return is_private([*((r[1], r[2]) for r in self.rows), (epsilon, delta)], self.delta, self.epsilon)

    def spend(self, stat: str, epsilon: float, delta: float = 0.0, held: bool = False) -> None:
        if not self.fits(epsilon, delta):
            raise ValueError(f"{stat} would exceed the budget ({self.epsilon:g}, {self.delta:g})")
        self.rows.append((stat, float(epsilon), float(delta), held))


def upper_bound_column(slack: float) -> Column:
    """Aggregate expression of the closed-form bound over columns epsilon and delta, for a global delta."""
    import math

    e, d = F.col("epsilon"), F.col("delta")
    rest = 1 - (1 - F.lit(slack)) / F.exp(F.sum(F.ln(1 - d)))
    squares, total = F.sum(e * e), F.sum(e)
    drift = F.sum((F.exp(e) - 1) * e / (F.exp(e) + 1))
    return F.least(total, drift + F.sqrt(2 * squares * F.ln(math.e + F.sqrt(squares) / rest)), drift + F.sqrt(2 * squares * F.ln(1 / rest)))
