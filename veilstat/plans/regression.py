"""Linear regressions from a released covariance matrix: no data is read and no privacy is spent."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from ..operators.aggregate import lower_triangle

INTERCEPT = "intercept"


def parse_formula(formula: str) -> tuple[str, list[str]]:
    """Response and predictors of 'y ~ x1 + x2'."""
    left, mark, right = formula.partition("~")
    y, xs = left.strip(), [x.strip() for x in right.split("+") if x.strip()]
    if not mark or not y or not xs:
        raise ValueError(f"formula {formula!r} should have the form 'y ~ x1 + x2'")
    return y, xs


def symmetric(values: Sequence[float], columns: Sequence[str]) -> np.ndarray:
    """The matrix of a lower triangle given column by column."""
    at, out = {c: i for i, c in enumerate(columns)}, np.zeros((len(columns),) * 2)
    for (a, b), v in zip(lower_triangle(columns), values, strict=True):
        out[at[a], at[b]] = out[at[b], at[a]] = v
    return out


def sweep(g: np.ndarray, chosen: Sequence[bool], reverse: bool = False) -> np.ndarray:
    """G swept on the chosen rows: -A^-1, A^-1 B and C - B' A^-1 B in their places. A singular A is inverted as far as it can be."""
    g, m = np.asarray(g, float), np.asarray(chosen, bool)
    if not m.any():
        return g.copy()
    a = g[np.ix_(m, m)]
    inverse = np.linalg.inv(a) if np.linalg.matrix_rank(a) == len(a) else np.linalg.pinv(a)
    out = np.empty_like(g)
    b = inverse @ g[np.ix_(m, ~m)] * (-1 if reverse else 1)
    out[np.ix_(m, m)] = -inverse
    out[np.ix_(m, ~m)], out[np.ix_(~m, m)] = b, b.T
    out[np.ix_(~m, ~m)] = g[np.ix_(~m, ~m)] - g[np.ix_(~m, m)] @ inverse @ g[np.ix_(m, ~m)]
    return out


NOT_INVERTIBLE = "The input matrix is not invertible"
NOT_POSITIVE = "The input covariance matrix is not positive definite due to noise addition so linear regression will not be run."


def linear_regression(formula: str, matrix: np.ndarray, columns: Sequence[str], n: int) -> dict[str, tuple[float, float]] | str:
    """Estimate and standard error of each predictor, or why there are none. A constant column has no part in it."""
    keep = [i for i, c in enumerate(columns) if c != INTERCEPT]
    matrix, columns = np.asarray(matrix, float)[np.ix_(keep, keep)], [columns[i] for i in keep]
    values = np.linalg.eigvalsh(matrix)
    if not np.all(np.abs(values) > 1e-16 * len(values) * float(np.abs(values).max())):
        return NOT_INVERTIBLE
    if not np.all(values > 0):
        return NOT_POSITIVE
    y, xs = parse_formula(formula)
    unknown = [c for c in (y, *xs) if c not in columns]
    if unknown:
        raise ValueError(f"formula {formula!r} names columns that were not released: {', '.join(unknown)}")
    at, to = [columns.index(x) for x in xs], columns.index(y)
    swept = sweep(matrix / n, [i in at for i in range(len(columns))])
    error = np.sqrt(swept[to, to] * np.diag(np.linalg.inv(matrix[np.ix_(at, at)])))
    return {x: (float(swept[to, i]), float(e)) for x, i, e in zip(xs, at, error)}


def coefficient_release(formulas: str | Sequence[str], release: dict, n: int) -> list[dict[str, tuple[float, float]] | str]:
    """Regressions from a covariance release ({'columns': ..., 'matrix': ...}) made before."""
    return [linear_regression(f, release["matrix"], release["columns"], n) for f in ([formulas] if isinstance(formulas, str) else formulas)]
