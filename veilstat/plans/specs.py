"""Release specifications. Making one checks and calibrates and reads no data; ``release(df)`` reads it once.

n, bounds and bins are declared. Sensitivities use the declared n, true means divide by the rows there are, so that no
release counts rows for free. ``source`` gives the noise (see ``Uniforms``), ``uniform`` the values imputed on executors;
without them both are secure.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calibration as cal
from ..functions import validate as v
from ..functions.noise import Uniforms
from ..operators import aggregate, clean, mechanisms
from . import histograms, regression, trees

ALPHA = 0.05


@dataclass
class _Spec:
    def _exchange(self, accuracy_of, epsilon_of) -> None:
        """Epsilon gives the accuracy, or the reverse; epsilon wins."""
        if self.epsilon is not None:
            v.check_epsilon(self.epsilon)
            self.accuracy = accuracy_of(self.epsilon)
        else:
            v.check_accuracy(self.accuracy)
            self.epsilon = epsilon_of(self.accuracy)
            v.check_epsilon(self.epsilon)

    def _column(self, df: DataFrame, uniform: Column | None) -> DataFrame:
        return mechanisms.prepared(df, [self.variable], self.var_type, [self.rng], [self.impute_rng], uniform=uniform)


@dataclass
class MeanSpec(_Spec):
    mechanism: str
    var_type: str
    variable: str
    n: int
    rng: Sequence[float] | None = None
    epsilon: float | None = None
    accuracy: float | None = None
    impute_rng: Sequence[float] | None = None
    alpha: float = ALPHA
    n_boot: int = 20
    sens: float = field(init=False)

    def __post_init__(self):
        self.mechanism = v.check_mechanism(self.mechanism, ("mechanismLaplace", "mechanismBootstrap"))
        self.var_type = v.check_variable_type(self.var_type, ("numeric", "integer", "logical"))
        v.check_n(self.n)
        self.rng = v.check_range(self.rng, self.var_type)
        self.sens = cal.mean_sensitivity(*self.rng, self.n)
        self.impute_rng = v.check_impute_range(self.impute_rng, self.rng, self.var_type)
        self._exchange(lambda e: cal.laplace_accuracy(self.sens, e, self.alpha), lambda a: cal.laplace_epsilon(self.sens, a, self.alpha))

    def true(self, df: DataFrame, uniform: Column | None = None) -> DataFrame:
        """The mean before noise."""
        return self._column(df, uniform).agg(F.avg(self.variable).alias("mean"))

    def release(self, df: DataFrame, source: Uniforms | None = None, uniform: Column | None = None, seed: int | None = None) -> dict[str, Any]:
        out = {"variable": self.variable, "epsilon": self.epsilon, "accuracy": self.accuracy}
        if self.mechanism == "mechanismBootstrap":
            x = self._column(df, uniform)
            (values,) = mechanisms.bootstrap(x, [aggregate.declared_mean(F.col(self.variable), self.n)], self.n, self.sens, self.epsilon, self.n_boot, source, seed)
            return out | {"release": values, "mean": sum(values) / len(values)} | mechanisms.bootstrap_error(values, self.n_boot, self.epsilon, self.sens)
        (value,) = mechanisms.laplace([self.true(df, uniform).first()[0]], self.sens, self.epsilon, source)
        half = cal.laplace_half_width(self.sens, self.epsilon, self.alpha)
        out |= {"release": value, "lower": value - half, "upper": value + half}
        return out | (self.logical(value) if self.var_type == "logical" else {})

    def logical(self, p: float) -> dict[str, Any]:
        """Standard deviation (none outside (0, 1)), median and counts of 0 and 1 that a mean of 0 and 1 implies; none of them for NaN."""
        if math.isnan(p):
            return {"std_dev": None, "median": None, "histogram": None}
        ones = round(p * self.n)
        return {"std_dev": math.sqrt(p * (1 - p)) if p * (1 - p) > 0 else None, "median": 0 if p < 0.5 else 1, "histogram": {0: self.n - ones, 1: ones}}


@dataclass
class VarianceSpec(_Spec):
    mechanism: str
    var_type: str
    variable: str
    n: int
    rng: Sequence[float] | None = None
    epsilon: float | None = None
    accuracy: float | None = None
    impute_rng: Sequence[float] | None = None
    alpha: float = ALPHA
    sens: float = field(init=False)

    def __post_init__(self):
        self.mechanism = v.check_mechanism(self.mechanism, ("mechanismLaplace",))
        self.var_type = v.check_variable_type(self.var_type, ("numeric", "integer", "logical", "double"))
        v.check_n(self.n)
        self.rng = v.check_range(self.rng, self.var_type)
        self.sens = cal.variance_sensitivity(self.n, *self.rng)
        self.impute_rng = v.check_impute_range(self.impute_rng, self.rng, self.var_type)
        self._exchange(lambda e: cal.laplace_accuracy(self.sens, e, self.alpha), lambda a: cal.laplace_epsilon(self.sens, a, self.alpha))

    def true(self, df: DataFrame, uniform: Column | None = None) -> DataFrame:
        return self._column(df, uniform).agg(F.var_samp(self.variable).alias("variance"))

    def release(self, df: DataFrame, source: Uniforms | None = None, uniform: Column | None = None) -> dict[str, Any]:
        (value,) = mechanisms.laplace([self.true(df, uniform).first()[0]], self.sens, self.epsilon, source)
        return {"variable": self.variable, "epsilon": self.epsilon, "accuracy": self.accuracy, "release": value, "std_dev": math.sqrt(value) if value >= 0 else None}


@dataclass
class HistogramSpec(_Spec):
    var_type: str
    variable: str
    n: int
    epsilon: float | None = None
    accuracy: float | None = None
    rng: Sequence[float] | None = None
    bins: Sequence | None = None
    n_bins: float | None = None
    granularity: float | None = None
    alpha: float = ALPHA
    delta: float | None = None
    impute_rng: Sequence[float] | None = None
    impute_bins: Sequence | None = None
    impute: bool = False
    mechanism: str | None = None
    n_boot: int = 20
    sens: float = field(init=False, default=cal.HISTOGRAM_SENSITIVITY)

    def __post_init__(self):
        self.var_type = v.check_variable_type(self.var_type, ("numeric", "integer", "logical", "character"))
        v.check_n(self.n)
        histograms.check_bins(self.bins, self.rng, self.var_type)
        self.n_bins = histograms.check_n_bins(self.n_bins)
        if self.rng is not None or self.var_type == "logical":
            self.rng = v.check_range(self.rng, self.var_type, empty_okay=True)
        chosen = histograms.mechanism_of(self.var_type, self.rng, self.bins, self.n_bins, self.granularity)
        self.mechanism = v.check_mechanism(self.mechanism or chosen, ("mechanismLaplace", "mechanismStability", "mechanismBootstrap"))
        if self.mechanism == "mechanismBootstrap" and chosen == "mechanismStability":
            raise ValueError("the bootstrap needs declared bins or a range")
        self.bins = histograms.bins_of(self.var_type, self.rng, self.bins, self.n_bins, self.impute, self.granularity, self.n) if self.mechanism != "mechanismStability" else self.bins
        if self.var_type == "logical" and not self.impute:
            self.var_type = "factor"
        self.rng = histograms.range_of(self.var_type, self.rng, self.bins)
        self.n_bins = histograms.bin_count(self.var_type, self.n, self.bins, self.n_bins, self.granularity)
        numeric = self.var_type in clean.NUMERIC
        self.impute_rng = v.check_impute_range(self.impute_rng, self.rng, self.var_type) if numeric and self.rng else self.rng
        self.impute_bins = histograms.imputation_bins(self.impute_bins, self.bins, self.var_type) if not numeric else None
        # Delta first: the accuracy of the stability mechanism needs it.
        self.delta = v.check_delta(self.mechanism, self.delta)
        if self.mechanism == "mechanismStability":
            v.check_stability_delta(self.delta, self.n)
        self._exchange(
            lambda e: cal.histogram_accuracy(self.mechanism, self.sens, e, self.delta, self.alpha),
            lambda a: cal.histogram_epsilon(self.mechanism, self.sens, a, self.delta, self.alpha),
        )

    def _bounded(self, df: DataFrame, uniform: Column | None, breaks: Sequence[float] | None = None) -> tuple[Column, DataFrame]:
        """The variable as it is counted, and the bounded and imputed frame it comes from."""
        x = F.col(self.variable)
        if self.var_type in clean.NUMERIC:
            rng = self.rng or (breaks[0], breaks[-1])
            return x, mechanisms.prepared(df, [self.variable], self.var_type, [rng], [self.impute_rng or rng], uniform=uniform)
        if self.var_type == "logical":
            return x.cast("int"), mechanisms.prepared(df, [self.variable], "logical", [(0, 1)], [(0, 1)], uniform=uniform)
        if self.var_type == "factor":
            return x, df.select(clean.clamp(x.cast("int"), 0, 1).alias(self.variable))
        return x, mechanisms.prepared(df, [self.variable], self.var_type, levels=self.bins, impute_levels=self.impute_bins, uniform=uniform)

    def true(self, df: DataFrame, uniform: Column | None = None) -> DataFrame:
        """bin, count before noise; for numbers also the bins' labels. Every declared bin is there."""
        if self.var_type not in clean.NUMERIC:
            x, own = self._bounded(df, uniform)
            return aggregate.category_counts(own, x, self.bins)
        breaks = list(self.bins) if self.rng is not None else mechanisms.observed_breaks(df, self.variable, self.n_bins)
        x, own = self._bounded(df, uniform, breaks)
        return aggregate.binned_counts(own, x, breaks)

    def _order(self) -> list[str]:
        return aggregate.bin_labels(self.bins) if self.var_type in clean.NUMERIC else ["NA" if b is None else str(b) for b in self.bins]

    def _replicas(self, df: DataFrame, source: Uniforms | None, uniform: Column | None, seed: int | None) -> dict[str, Any]:
        """``n_boot`` releases of every bin from resampled rows, normalised each; their means are the release."""
        x, own = self._bounded(df, uniform)
        if self.var_type in clean.NUMERIC:
            bin_ = aggregate.right_closed_bin(x, list(self.bins))
            hits = [bin_ == k for k in range(len(self.bins) - 1)]
        else:
            shown = F.coalesce(x.cast("string"), F.lit("NA"))
            hits = [shown == label for label in self._order()]
        counts = mechanisms.bootstrap(own, [F.count_if(h).cast("double") for h in hits], self.n, self.sens, self.epsilon, self.n_boot, source, seed)
        rows = [histograms.normalize(row, self.n) for row in zip(*counts)]
        labels = self._order()
        errors = [mechanisms.bootstrap_error(c, self.n_boot, self.epsilon, self.sens) for c in counts]
        out = self.finish([(b, sum(r[k] for r in rows) / len(rows)) for k, b in enumerate(labels)])
        return out | {"replicas": [dict(zip(labels, r)) for r in rows], "errors": dict(zip(labels, errors))}

    def release(self, df: DataFrame, source: Uniforms | None = None, uniform: Column | None = None, seed: int | None = None) -> dict[str, Any]:
        if self.mechanism == "mechanismBootstrap":
            return self._replicas(df, source, uniform, seed)
        if self.mechanism == "mechanismStability":
            breaks = mechanisms.observed_breaks(df, self.variable, self.n_bins) if self.var_type in clean.NUMERIC else None
            if breaks:
                rng = (breaks[0], breaks[-1])
                own = mechanisms.prepared(df, [self.variable], self.var_type, [rng], [rng], uniform=uniform)
                counts = aggregate.binned_counts(own, F.col(self.variable), breaks).select(F.col("label").alias("bin"), "count")
            else:
                counts = self.true(df, uniform)
            noisy = mechanisms.stability_histogram(counts, self.n, self.epsilon, self.delta, self.sens, source)
        else:
            label = "label" if self.var_type in clean.NUMERIC else "bin"
            found = {r[label]: float(r["count"]) for r in self.true(df, uniform).collect()}
            order = self._order()
            noisy = list(zip(order, mechanisms.laplace([found[b] for b in order], self.sens, self.epsilon, source)))
        return self.finish(noisy)

    def finish(self, noisy: Sequence[tuple[str, float]]) -> dict[str, Any]:
        """Normalised counts and what follows from them."""
        labels, counts = [b for b, _ in noisy], histograms.normalize([c for _, c in noisy], self.n)
        out: dict[str, Any] = {"variable": self.variable, "epsilon": self.epsilon, "delta": self.delta, "accuracy": self.accuracy, "mechanism": self.mechanism, "release": dict(zip(labels, counts))}
        if self.mechanism == "mechanismLaplace":
            out["intervals"] = dict(zip(labels, histograms.intervals(counts, self.accuracy)))
        if self.var_type in ("character", "factor") and set(labels) != {"0", "1", "NA"}:
            out["herfindahl"] = histograms.herfindahl(counts, self.n)
        if {"0", "1"} <= set(labels) and self.var_type in ("logical", "factor"):
            held = dict(zip(labels, counts))
            out |= histograms.logical_moments(held["0"], held["1"])
        return out


@dataclass
class CovarianceSpec(_Spec):
    """Epsilon for each entry of the lower triangle, or a global one (shared out evenly or as given), or accuracies."""

    mechanism: str
    var_type: str
    n: int
    columns: Sequence[str]
    rng: Sequence[Sequence[float]]
    epsilon: Sequence[float] | None = None
    global_eps: float | None = None
    epsilon_dist: Sequence[float] | None = None
    accuracy: float | None = None
    accuracy_vals: Sequence[float] | None = None
    impute_rng: Sequence | None = None
    formula: str | Sequence[str] | None = None
    intercept: bool = False
    alpha: float = ALPHA
    sens: list[float] = field(init=False)

    def __post_init__(self):
        self.mechanism = v.check_mechanism(self.mechanism, ("mechanismLaplace",))
        self.var_type = v.check_variable_type(self.var_type, ("numeric", "integer", "logical", "double"))
        v.check_n(self.n)
        self.columns = list(self.columns)
        self.rng = v.check_ranges(self.rng, self.var_type, len(self.columns))
        impute = self.impute_rng or [None] * len(self.columns)
        self.impute_rng = [v.check_impute_range(i, r, self.var_type) for i, r in zip(impute, self.rng, strict=True)]
        self.sens = cal.covariance_sensitivity(self.n, self.rng, self.intercept)
        size = len(self.columns) * (len(self.columns) + 1) // 2
        noisy = [s for s in self.sens if s > 0] if self.intercept else self.sens
        if self.epsilon is not None:
            eps = [self.epsilon] if not v.is_vector(self.epsilon) else list(self.epsilon)
            v.check_epsilon(eps, size)
            self.global_eps = sum(eps)
        elif self.global_eps is not None:
            v.check_epsilon(self.global_eps)
            shares = v.check_epsilon_dist(self.epsilon_dist, size) if self.epsilon_dist is not None else [1 / size] * size
            eps = [self.global_eps * s for s in shares]
        else:
            accuracy = v.check_accuracy_vals(self.accuracy_vals, size) if self.accuracy_vals is not None else [v.check_accuracy(self.accuracy)] * size
            eps = [cal.laplace_epsilon(s, a, self.alpha) for s, a in zip(noisy, accuracy)]
            self.global_eps = sum(eps)
        self.epsilon = eps
        self.accuracy = [cal.laplace_accuracy(s, e, self.alpha) for s, e in zip(noisy, eps)]

    @property
    def names(self) -> list[str]:
        return [regression.INTERCEPT] * self.intercept + self.columns

    def true(self, df: DataFrame, uniform: Column | None = None) -> DataFrame:
        """One row with the sample covariances of the lower triangle, from one pass."""
        own = mechanisms.prepared(df, self.columns, self.var_type, self.rng, self.impute_rng, uniform=uniform)
        if self.intercept:
            own = own.withColumn(regression.INTERCEPT, F.lit(1.0))
        return own.agg(*aggregate.covariances(self.names))

    def release(self, df: DataFrame, source: Uniforms | None = None, uniform: Column | None = None) -> dict[str, Any]:
        values, eps = list(self.true(df, uniform).first()), iter(self.epsilon)
        scale = [next(eps) if s > 0 or not self.intercept else 1.0 for s in self.sens]
        matrix = regression.symmetric(mechanisms.laplace(values, self.sens, scale, source), self.names)
        out: dict[str, Any] = {"columns": self.names, "matrix": matrix, "epsilon": self.epsilon, "accuracy": self.accuracy, "global_eps": self.global_eps}
        if self.formula:
            out["regression"] = regression.coefficient_release(self.formula, out, self.n)
        return out


@dataclass
class TreeSpec(_Spec):
    """Counts of a dyadic tree over a range in steps of ``gran``; from them distribution, mean and quantiles.

    Every node is a released number that the sweeps need on the driver, so a tree of over 2^22 nodes is refused: take larger steps.
    """

    variable: str
    n: int
    rng: Sequence[float]
    gran: float
    var_type: str = "numeric"
    epsilon: float | None = None
    accuracy: float | None = None
    impute_rng: Sequence[float] | None = None
    percentiles: Sequence[float] = ()
    alpha: float = ALPHA
    mechanism: str = "mechanismLaplace"
    sens: float = field(init=False)

    def __post_init__(self):
        self.var_type = v.check_variable_type(self.var_type, ("numeric", "integer", "logical"))
        v.check_n(self.n)
        self.rng = v.check_range(self.rng, self.var_type)
        if aggregate.tree_depth(*self.rng, self.gran) > 22:
            raise ValueError("a tree of over 2^22 nodes; take larger steps")
        self.sens = cal.tree_sensitivity(*self.rng, self.gran)
        self.impute_rng = v.check_impute_range(self.impute_rng, self.rng, self.var_type)
        self._exchange(lambda e: cal.tree_accuracy(e, *self.rng, self.gran, self.alpha), lambda a: cal.tree_epsilon(a, *self.rng, self.gran, self.alpha))

    @property
    def sigma(self) -> float:
        """Standard deviation of the noise of a node."""
        return math.sqrt(2) * self.sens / self.epsilon

    def true(self, df: DataFrame, uniform: Column | None = None) -> DataFrame:
        return aggregate.tree_nodes(self._column(df, uniform), F.col(self.variable), *self.rng, self.gran)

    def release(self, df: DataFrame, source: Uniforms | None = None, uniform: Column | None = None) -> dict[str, Any]:
        counts = [float(r["count"]) for r in sorted(self.true(df, uniform).collect(), key=lambda r: r["node"])]
        noisy = mechanisms.laplace(counts, self.sens, self.epsilon, source)
        nodes = trees.rounded(noisy)
        better = trees.efficient(nodes, self.n, self.sigma)
        points = trees.cdf(better[len(better) // 2 :], *self.rng, self.gran)
        return {"variable": self.variable, "epsilon": self.epsilon, "accuracy": self.accuracy, "release": nodes.tolist(), "efficient": better.tolist(), "cdf": points, "mean": trees.mean(points), "median": trees.median(points), "percentiles": trees.percentiles(points, self.percentiles)}


def release_frame(df: DataFrame, result: dict[str, Any]) -> DataFrame:
    """The scalar fields of a release as a frame of one row."""
    flat = {k: float(x) if isinstance(x, (int, float)) else x for k, x in result.items() if isinstance(x, (int, float, str)) and not isinstance(x, bool)}
    schema = ", ".join(f"`{k}` {'string' if isinstance(x, str) else 'double'}" for k, x in flat.items())
    return df.sparkSession.createDataFrame([tuple(flat.values())], schema)


def fused(df: DataFrame, specs: Sequence[MeanSpec | VarianceSpec], uniform: Column | None = None) -> list[float]:
    """True values of several means and variances in one pass over the data."""
    u = uniform if uniform is not None else clean.secure_uniform()
    own = df.select(*[clean.impute(clean.clamp(clean.null_of_nan(df, s.variable), *s.rng), u, s.var_type, *s.impute_rng).alias(f"x{k}") for k, s in enumerate(specs)])
    row = own.agg(*[(F.avg if isinstance(s, MeanSpec) else F.var_samp)(f"x{k}") for k, s in enumerate(specs)]).first()
    return [math.nan if x is None else float(x) for x in row]
