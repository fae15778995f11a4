"""Checks of arguments. They touch no data; each returns the value to use, warns, or raises ValueError."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from numbers import Real
from typing import Any

from . import messages as say
from .calibration import DEFAULT_DELTA

VARIABLE_TYPES = ("numeric", "integer", "logical", "character", "factor", "double")
MECHANISMS = ("mechanismLaplace", "mechanismGaussian", "mechanismStability", "mechanismBootstrap", "mechanismObjective")
DELTA_MECHANISMS = ("mechanismStability", "mechanismGaussian")


def is_vector(x: Any) -> bool:
    return isinstance(x, Sequence) and not isinstance(x, (str, bytes))


def as_list(x: Any) -> list:
    """Scalars, sequences and rows of a matrix as a list; nothing as an empty one."""
    if x is None:
        return []
    if hasattr(x, "tolist"):
        x = x.tolist()
    return list(x) if is_vector(x) else [x]


def _missing(x: Any) -> bool:
    return x is None or (isinstance(x, float) and math.isnan(x))


def _numeric(x: Any) -> bool:
    return isinstance(x, Real) and not isinstance(x, bool)


def _shown(x: Any) -> str:
    return f"{x:g}" if _numeric(x) else "NA" if _missing(x) else str(x)


def check_empty(x: Any, empty_okay: bool = False) -> Any:
    values = as_list(x)
    if (not values or any(_missing(v) for v in values)) and not empty_okay:
        raise ValueError(say.EMPTY)
    return x


def check_numeric(x: Any, empty_okay: bool = False) -> Any:
    check_empty(x, empty_okay)
    for v in as_list(x):
        if not _missing(v) and not _numeric(v):
            raise ValueError(f"{_shown(v)} is no number")
    return x


def check_length(x: Any, n: int) -> Any:
    if len(as_list(x)) != n:
        raise ValueError(say.LENGTH.format(n, len(as_list(x))))
    return x


def check_n(n: Any, expected_length: int = 1, empty_okay: bool = False) -> Any:
    values = as_list(n)
    if not values or any(_missing(v) for v in values):
        if empty_okay:
            return None
        raise ValueError(say.N_EMPTY)
    check_length(values, expected_length)
    for v in values:
        if not _numeric(v) or v <= 0 or v != int(v):
            raise ValueError(say.N_WHOLE)
    return n


def check_range(rng: Any, var_type: str = "numeric", empty_okay: bool = False) -> tuple[float, float] | None:
    """One range: sorted; of a logical variable always (0, 1); of more than two values the extremes, with a warning."""
    if var_type == "logical":
        return (0, 1)
    values = as_list(rng)
    if not values:
        if empty_okay:
            return None
        raise ValueError(say.RANGE_EMPTY)
    shown = f"c( {', '.join(map(_shown, values))} )"
    if any(_missing(v) for v in values):
        if empty_okay:
            warnings.warn(say.RANGE_DROPPED.format(shown), stacklevel=2)
            return None
        raise ValueError(say.RANGE_MISSING)
    if len(values) < 2:
        raise ValueError(say.RANGE_SHORT.format(shown))
    if len(values) > 2:
        warnings.warn(say.RANGE_LONG.format(shown), stacklevel=2)
    return (min(values), max(values))


def check_ranges(rngs: Any, var_types: str | Sequence[str], expected_length: int, empty_okay: bool = False) -> list[tuple[float, float] | None]:
    """A list of ranges, one for each column."""
    if rngs is None:
        rngs = [None] * expected_length
    if not is_vector(rngs) and not hasattr(rngs, "tolist"):
        raise ValueError("ranges come as a list with one pair for each column")
    rngs = as_list(rngs)
    if expected_length == 1 and rngs and not is_vector(rngs[0]) and rngs[0] is not None:
        rngs = [rngs]
    types = [var_types] * expected_length if isinstance(var_types, str) else list(var_types)
    check_length(rngs, expected_length)
    return [check_range(r, t, empty_okay) for r, t in zip(rngs, types)]


def check_impute_range(impute: Any, rng: Any, var_type: str) -> Any:
    """The range to impute from: the given one inside the data range, else the data range."""
    if impute is None:
        return rng
    if var_type not in ("numeric", "integer", "double"):
        warnings.warn(say.IMPUTE_TYPE, stacklevel=2)
        return rng
    if not all(_numeric(v) for v in as_list(impute)):
        warnings.warn("bounds for imputed numbers are numbers; the data range is used instead", stacklevel=2)
        return rng
    values = as_list(impute)
    if len(values) != 2:
        raise ValueError("a range for imputation has a lower and an upper bound")
    low, high = values
    if low < rng[0]:
        warnings.warn(say.IMPUTE_LOW, stacklevel=2)
        low = rng[0]
    if high > rng[1]:
        warnings.warn(say.IMPUTE_HIGH, stacklevel=2)
        high = rng[1]
    return (low, high)


def check_epsilon(epsilon: Any, expected_length: int = 1) -> Any:
    check_numeric(epsilon)
    values = as_list(epsilon)
    if expected_length == 1 and len(values) > 1:
        raise ValueError(f"one epsilon is wanted here, not {len(values)}")
    for e in values:
        if e <= 0:
            raise ValueError(say.EPSILON_POSITIVE)
        if e >= 3:
            warnings.warn(f"an epsilon of {_shown(e)} protects little; most uses want less than 3", stacklevel=2)
    if len(values) != expected_length:
        raise ValueError(f"{expected_length} epsilons are wanted, but there are {len(values)}")
    return epsilon


def check_accuracy(accuracy: Any, expected_length: int = 1) -> Any:
    check_numeric(accuracy)
    check_length(accuracy, expected_length)
    if any(a <= 0 for a in as_list(accuracy)):
        raise ValueError("an accuracy is a positive number")
    return accuracy


def check_delta(mechanism: str, delta: float | None) -> float:
    if mechanism in DELTA_MECHANISMS:
        return DEFAULT_DELTA if delta is None else delta
    if delta:
        warnings.warn(say.DELTA_UNUSED, stacklevel=2)
    return 0.0


def check_variable_type(var_type: str, allowed: Sequence[str]) -> str:
    if not isinstance(var_type, str) or var_type.lower() not in allowed:
        raise ValueError(say.VARIABLE_TYPE.format(var_type, ", ".join(allowed)))
    return var_type.lower()


def check_mechanism(mechanism: str, allowed: Sequence[str] = MECHANISMS) -> str:
    for name in allowed:
        if isinstance(mechanism, str) and mechanism.lower() == name.lower():
            return name
    raise ValueError(f"no mechanism {mechanism!r} here; there are {', '.join(allowed)}")


def check_epsilon_dist(shares: Sequence[float], expected_length: int) -> list[float]:
    if any(s <= 0 for s in shares) or abs(sum(shares) - 1) > 1e-9:
        raise ValueError("shares of epsilon are positive and add up to 1")
    if len(shares) != expected_length:
        raise ValueError(f"{expected_length} shares of epsilon are wanted, but there are {len(shares)}")
    return list(shares)


def check_accuracy_vals(accuracy: Sequence[float], expected_length: int) -> list[float]:
    if len(accuracy) != expected_length:
        raise ValueError(f"{expected_length} accuracies are wanted, but there are {len(accuracy)}")
    if any(a <= 0 for a in accuracy):
        raise ValueError("accuracies are positive numbers")
    return list(accuracy)


def check_stability_delta(delta: float, n: int) -> float:
    if delta >= 1 / n**2:
        raise ValueError(say.DELTA_RISK)
    return delta
