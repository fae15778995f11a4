"""Mechanisms: a true aggregate of bounded and imputed columns, plus calibrated noise.

The data-scale part is one plan and one action; its result has one value for each released number. ``fun`` is any list of
aggregate columns with a declared sensitivity, so a caller's own statistic is released like a built-in one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calibration import gaussian_scale, stability_threshold
from ..functions.noise import Uniforms, chi_squared_quantile, dp_noise, laplace_quantile
from ..functions.validate import check_delta, check_mechanism, check_stability_delta
from ..sources.shared import written
from . import clean


def prepared(df: DataFrame, columns: Sequence[str], var_type: str, rngs: Sequence | None = None, impute_rngs: Sequence | None = None, levels: Sequence | None = None, impute_levels: Sequence | None = None, uniform: Column | None = None) -> DataFrame:
    """Selected, bounded and imputed columns. Imputed values come from ``impute_rngs`` where given, else from the ranges; levels
    that include a null make missing a category of its own, and without levels a missing category stays one too."""
    categorical = var_type in ("character", "factor")
    bounded = [clean.censor(df, [c], var_type, None if categorical else rngs[k], levels)[0] for k, c in enumerate(columns)]
    if categorical and (not levels or any(v is None for v in levels)):
        return df.select(*bounded)
    u = uniform if uniform is not None else clean.secure_uniform()
    out = []
    for k, (c, x) in enumerate(zip(columns, bounded)):
        low, high = (None, None) if categorical else (impute_rngs or rngs)[k]
        out.append(clean.impute(x, u, var_type, low, high, list(impute_levels or levels or []) or None).alias(c))
    return df.select(*out)


def laplace(values: Sequence[float], sens: float | Sequence[float], epsilon: float | Sequence[float], source: Uniforms | None = None) -> list[float]:
    """Values with Laplace noise of scale sens/epsilon each; a null value (an aggregate over no rows) gives NaN."""
    n, values = len(values), [math.nan if x is None else float(x) for x in values]
    s = list(sens) if isinstance(sens, Sequence) else [sens] * n
    e = list(epsilon) if isinstance(epsilon, Sequence) else [epsilon] * n
    return [v + z for v, z in zip(values, dp_noise(n, [a / b for a, b in zip(s, e, strict=True)], "laplace", source=source))]


def gaussian(values: Sequence[float], sens: float, epsilon: float, delta: float, source: Uniforms | None = None) -> list[float]:
    values = [math.nan if x is None else float(x) for x in values]
    return [v + z for v, z in zip(values, dp_noise(len(values), gaussian_scale(sens, epsilon, delta) if sens else 0.0, "gaussian", source=source))]


def evaluate(df: DataFrame, fun: Sequence[Column] | Callable[[DataFrame], Sequence[Column]]) -> list[float]:
    """The aggregates of a frame in one action; a null (no rows) is NaN."""
    row = df.agg(*(fun(df) if callable(fun) else fun)).first()
    return [math.nan if v is None else float(v) for v in row]


def released(df: DataFrame, columns: Sequence[str], var_type: str, rngs: Sequence, fun: Sequence[Column], sens: float, epsilon: float, delta: float | None = None, mechanism: str = "mechanismLaplace", impute_rngs: Sequence | None = None, source: Uniforms | None = None, uniform: Column | None = None) -> list[float]:
    """A whole release of any aggregates of declared sensitivity: columns bounded and imputed, one aggregate, Laplace or normal noise."""
    mechanism = check_mechanism(mechanism, ("mechanismLaplace", "mechanismGaussian"))
    values = evaluate(prepared(df, columns, var_type, rngs, impute_rngs, uniform=uniform), fun)
    if mechanism == "mechanismGaussian":
        return gaussian(values, sens, epsilon, check_delta(mechanism, delta), source)
    return laplace(values, sens, epsilon, source)


def stability_histogram(counts: DataFrame, n: int, epsilon: float, delta: float, sens: float = 2.0, source: Uniforms | None = None) -> list[tuple[str, float]]:
    """(bin, noisy count) of the bins that occur and whose noisy count is over 1 + 2 ln(2/delta)/epsilon.

    Without a ``source`` the noise is secure and drawn on executors, and only what is over the threshold comes to the driver; a
    source of uniforms, for tests, gives its noise in the order of the bins.
    """
    check_stability_delta(delta, n)
    if source is None:
        noise = laplace_quantile(clean.secure_uniform(), b=sens / epsilon)
        held = counts.where("count > 0").select("bin", (F.col("count") + noise).alias("noisy")).where(F.col("noisy") > stability_threshold(epsilon, delta))
        return sorted((r["bin"], r["noisy"]) for r in held.collect())
    rows = sorted((r["bin"], r["count"]) for r in counts.where("count > 0").collect())
    noisy = laplace([float(c) for _, c in rows], sens, epsilon, source)
    return [(b, v) for (b, _), v in zip(rows, noisy) if v > stability_threshold(epsilon, delta)]


def observed_breaks(df: DataFrame, column: str, n_bins: int) -> list[float]:
    """Equal bins over the smallest and largest value found. These come from the data and are released without noise: declare
    bounds where they are known."""
    low, high = df.agg(F.min(clean.null_of_nan(df, column)), F.max(clean.null_of_nan(df, column))).first()
    return [low + (high - low) * k / n_bins for k in range(n_bins + 1)]


def placed(df: DataFrame) -> DataFrame:
    """The frame with each row's partition ``__part`` and place in it ``__at``: to be written, then ``numbered``."""
    rows = df.withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id())
    return rows.withColumn("__at", F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id")


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows of a written frame of ``placed`` with a dense number ``__row`` from 0, and how many there are; no global sort."""
    first, total = [(-1, 0)], 0
    for part, count in sorted((r["__part"], r["count"]) for r in rows.groupBy("__part").count().collect()):
        first.append((part, total))
        total += count
    places = rows.sparkSession.createDataFrame(first, "__part int, __first long")
    return rows.join(F.broadcast(places), "__part").withColumn("__row", F.col("__first") + F.col("__at")).drop("__part", "__at", "__first"), total


def check_rows(found: int, n: int) -> None:
    """Raises where n is not the number of rows: with fewer some could not be drawn, with more some draws would find no row."""
    if found != n:
        raise ValueError(f"n is {n}, but there are {found} rows to draw from")


def drawn_rows(rows: DataFrame, n: int, n_boot: int, seed: int | None = None) -> DataFrame:
    """Rows of a numbered frame for each ``__replica``, with ``__times``: how often n draws with replacement take each.

    All replicas are one plan. Draws are made where they are counted, by the secure generator or, for tests, by a seed.
    """
    u = clean.secure_uniform() if seed is None else F.rand(seed)
    draws = rows.sparkSession.range(n * n_boot).select((F.col("id") % n_boot).cast("int").alias("__replica"), F.least(F.floor(u * n).cast("long"), F.lit(n - 1)).alias("__row"))
    return rows.join(draws.groupBy("__replica", "__row").agg(F.count("*").alias("__times")), "__row")


def bootstrap_pieces(drawn: DataFrame, piece: Column) -> DataFrame:
    """replica, times, value: an aggregate of the rows drawn that many times."""
    return drawn.groupBy(F.col("__replica").alias("replica"), F.col("__times").alias("times")).agg(piece.alias("value"))


def bootstrap_replication(pieces: Sequence[tuple[int, float]], n: int, sens: float, epsilon: float, source: Uniforms | None = None) -> float:
    """One release: for each number of draws i up to the largest, i times the value of the rows drawn i times, plus normal noise of
    variance i p_i sens^2 / (2 epsilon), p_i being the chance of i draws."""
    values = dict(pieces)
    total = 0.0
    for i in range(1, max(values, default=0) + 1):
        log_p = math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - i * math.log(n) + (n - i) * math.log1p(-1 / n) if n > 1 else 0.0
        var = i * math.exp(log_p) * sens**2 / (2 * epsilon)
        total += i * values.get(i, 0.0) + dp_noise(1, math.sqrt(var), "gaussian", source=source)[0]
    return total


def bootstrap(df: DataFrame, pieces: Sequence[Column], n: int, sens: float, epsilon: float, n_boot: int, source: Uniforms | None = None, seed: int | None = None) -> list[list[float]]:
    """n_boot releases of each aggregate, each release with an equal part of epsilon. Imputed values are drawn once and written."""
    with written(placed(df)) as held:
        rows, found = numbered(held)
        check_rows(found, n)
        drawn = drawn_rows(rows, n, n_boot, seed)
        got = drawn.groupBy("__replica", "__times").agg(*[p.alias(f"v{k}") for k, p in enumerate(pieces)]).collect()
    out = []
    for k in range(len(pieces)):
        parts = [[(r["__times"], float(r[f"v{k}"] or 0.0)) for r in got if r["__replica"] == j] for j in range(n_boot)]
        out.append([bootstrap_replication(p, n, sens, epsilon / n_boot, source) for p in parts])
    return out


def bootstrap_error(release: Sequence[float], n_boot: int, epsilon: float, sens: float) -> dict[str, float]:
    """Standard deviation of the releases, and with the noise taken out: naively, and at most with 99 % confidence."""
    sd = float(np.std(release, ddof=1))
    noise = sens**2 * n_boot / (2 * epsilon)
    c = chi_squared_quantile(0.01, n_boot - 1)
    return {"sd": sd, "conservative": math.sqrt(max(sd**2 - c * noise / (n_boot - 1), 0.0)), "naive": math.sqrt(max(sd**2 - noise, 0.0))}
