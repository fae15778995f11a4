"""Rules that turn a histogram's arguments into a mechanism and bins, before any data is read."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

from ..functions import messages as say
from ..functions.validate import is_vector


def mechanism_of(var_type: str, rng: Sequence | None, bins: Sequence | None, n_bins: float | None, granularity: float | None) -> str:
    """Laplace where the bins are known beforehand, stability where they come from the data."""
    check_histogram_type("numeric" if var_type == "double" else "character" if var_type == "factor" else var_type)
    if bins is not None or var_type == "logical":
        return "mechanismLaplace"
    if var_type in ("numeric", "integer", "double"):
        if n_bins is None and granularity is None:
            raise ValueError(say.BINS_UNKNOWN)
        return "mechanismStability" if rng is None else "mechanismLaplace"
    return "mechanismStability"


def check_bins(bins: Sequence | None, rng: Sequence | None, var_type: str) -> None:
    if bins is None:
        return
    if var_type in ("character", "factor") and not all(b is None or isinstance(b, str) for b in bins):
        raise ValueError(say.BINS_CHARACTER)
    if var_type in ("numeric", "integer", "double") and not all(isinstance(b, (int, float)) for b in bins):
        raise ValueError(say.BINS_NUMERIC)
    if var_type == "logical" and not all(b in (0, 1, None) for b in bins):
        raise ValueError(say.BINS_LOGICAL)
    if rng is not None and var_type != "logical":
        warnings.warn(say.BINS_AND_RANGE, stacklevel=3)


def check_n_bins(n_bins: float | None) -> int | None:
    if n_bins is None:
        return None
    if n_bins < 2:
        raise ValueError(say.BINS_FEW)
    if n_bins != int(n_bins):
        warnings.warn(say.BINS_WHOLE, stacklevel=3)
    return math.ceil(n_bins)


def check_histogram_type(var_type: str) -> None:
    if var_type not in ("numeric", "integer", "logical", "character"):
        raise ValueError(f"no histogram of type {var_type!r}; there are numeric, integer, logical and character")


def number_of_bins(n: int, n_bins: int | None, granularity: float | None) -> int:
    return n_bins if n_bins is not None else math.ceil(n / granularity)


def bins_of(var_type: str, rng: Sequence | None, bins: Sequence | None, n_bins: int | None, impute: bool, granularity: float | None, n: int) -> list | None:
    """Break points of a numeric variable, values of any other; None where the data has to tell."""
    if bins is not None:
        return list(bins)
    if var_type == "logical":
        return [0, 1] if impute else [0, 1, None]
    if var_type in ("numeric", "integer", "double") and rng is not None:
        k = number_of_bins(n, n_bins, granularity)
        return [rng[0] + (rng[1] - rng[0]) * i / k for i in range(k + 1)]
    return None


def range_of(var_type: str, rng: Sequence | None, bins: Sequence | None) -> tuple | None:
    if var_type == "logical":
        return (0, 1)
    if var_type in ("numeric", "integer", "double") and bins is not None:
        return (bins[0], bins[-1])
    return tuple(rng) if rng is not None else None


def bin_count(var_type: str, n: int, bins: Sequence | None, n_bins: int | None, granularity: float | None) -> int | None:
    if n_bins is not None:
        return n_bins
    if bins is not None:
        return len(bins) - (var_type in ("numeric", "integer", "double"))
    return math.ceil(n / granularity) if granularity else None


def imputation_bins(impute_bins: Sequence | None, bins: Sequence | None, var_type: str) -> list | None:
    if impute_bins is None:
        return list(bins) if bins is not None else None
    if var_type not in ("logical", "factor", "character"):
        warnings.warn("only categories are imputed from bins; the histogram's own are used", stacklevel=3)
        return list(bins) if bins is not None else None
    given = list(impute_bins) if is_vector(impute_bins) else [impute_bins]
    kept = [b for b in given if b in bins]
    for _ in range(len(given) - len(kept)):
        warnings.warn("a bin to impute from is none of the histogram's and is left out", stacklevel=3)
    return kept or list(bins)


def normalize(counts: Sequence[float], n: int) -> list[float]:
    """Counts clamped into [0, n], then scaled to sum to n; all zero if nothing is left."""
    held = [min(max(c, 0.0), float(n)) for c in counts]
    total = sum(held)
    return [c / total * n if total > 0 else 0.0 for c in held]


def intervals(counts: Sequence[float], accuracy: float) -> list[tuple[float, float]]:
    return [(0.0, accuracy) if c == 0 else (max(0.0, c - accuracy), c + accuracy) for c in counts]


def herfindahl(counts: Sequence[float], n: int) -> float:
    return sum((c / n) ** 2 for c in counts)


def logical_moments(zero: float, one: float) -> dict[str, float]:
    """Mean, median, variance and standard deviation from the counts of 0 and 1; missing values have no part in them."""
    mean = one / (zero + one) if zero + one > 0 else 0.0
    return {"mean": mean, "median": 0.0 if mean < 0.5 else 1.0, "variance": mean * (1 - mean), "std_dev": math.sqrt(max(mean * (1 - mean), 0.0))}
