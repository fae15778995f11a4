"""Releases and statistics as JSON."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timezone
from typing import Any


def plot_fields(var_type: str, name: str) -> dict[str, Any]:
    """How to draw a variable."""
    if var_type == "logical":
        return {"plottype": "bar", "varNamesSumStat": name, "uniques": 2}
    if var_type in ("factor", "character"):
        return {"plottype": "continuous", "varNamesSumStat": name}
    return {}


def _plain(x: Any) -> Any:
    if hasattr(x, "tolist"):
        return _plain(x.tolist())
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return round(x, 8) if isinstance(x, float) else x


def releases_json(releases: Sequence[tuple[str, str, dict[str, Any]]]) -> str:
    """One document for (variable, type, release): the fields of all releases of a variable together, later ones over earlier."""
    variables: dict[str, dict[str, Any]] = {}
    for name, var_type, result in releases:
        variables.setdefault(name, plot_fields(var_type, name)).update(_plain(result))
    return json.dumps({"dataset": {"private": True}, "variables": variables})


#: The published description of each statistic.
CATALOG = {
    "Histogram": {
        "statistic": "Histogram",
        "description": "Differentially Private Histogram",
        "mechanisms": ["noisy", "random", "stability"],
        "variableTypes": {
            "numeric": {"rTypes": ["numeric", "integer"], "fields": {"n": "Number of observations", "range": "Ordered pair indicating effective lower and upper bounds", "n_bins": "Number of cells in output (optional, default Sturges method)"}},
            "categorical": {"rTypes": ["character", "factor"], "fields": {"n": "Number of observations", "bins": "Vector indicating levels for which to produce frequencies"}},
        },
    },
    "Mean": {
        "statistic": "Mean",
        "description": "Differentially Private Mean",
        "mechanisms": ["Laplace"],
        "variableTypes": {
            "numeric": {"rTypes": ["numeric", "integer"], "fields": {"n": "Number of observations", "range": "Ordered pair indicating effective lower and upper bounds"}},
            "categorical": {"rTypes": ["logical"], "fields": {"n": "Number of observations", "range": "Should be (0, 1)"}},
        },
    },
}


def statistic_json(name: str) -> str:
    return json.dumps(CATALOG[name])


def catalog_json() -> str:
    return json.dumps({"DP Statistics": [{name.lower(): entry} for name, entry in CATALOG.items()]})


#: What the exchange format has names for. Stability histograms are Laplace noise and a threshold.
MECHANISM_NAMES = {"mechanismLaplace": "Laplace", "mechanismStability": "Laplace", "mechanismGaussian": "Gaussian", "mechanismBootstrap": "Bootstrap"}
STATISTICS = ("mean", "histogram", "covariance", "variance")


def _constraint(spec: Any, value: Any) -> dict[str, Any]:
    """The declared bounds and the number of rows. The format wants two numbers: categories count as 0, 1, ... and are listed beside."""
    rng = getattr(spec, "rng", None)
    if rng is not None:
        low, high = rng[0] if isinstance(rng[0], (list, tuple)) else rng
        return {"constraint": {"lowerbound": low, "upperbound": high}, "n": spec.n}
    bins = ["NA" if b is None else b for b in spec.bins] if getattr(spec, "bins", None) else list(value)
    return {"constraint": {"lowerbound": 0, "upperbound": max(len(bins) - 1, 0)}, "n": spec.n, "bins": bins}


def release_entry(statistic: str, spec: Any, result: dict[str, Any], batch: int = 1, node: int = 0) -> dict[str, Any]:
    """One release in the exchange format: what was asked, its privacy loss, accuracy and value.

    The format knows means, variances, histograms and covariances; anything else, such as a tree, is a ValueError.
    """
    if statistic not in STATISTICS:
        raise ValueError(f"the exchange format has no statistic {statistic!r}; it has {', '.join(STATISTICS)}")
    delta = getattr(spec, "delta", 0.0) or 0.0
    epsilon = sum(spec.epsilon) if isinstance(spec.epsilon, list) else spec.epsilon
    loss = {"name": "approx dp", "epsilon": epsilon, "delta": delta} if delta else {"name": "pure", "epsilon": epsilon}
    accuracy = max(spec.accuracy) if isinstance(spec.accuracy, list) else spec.accuracy
    value = result.get("release", result.get("matrix"))
    return {
        "statistic": statistic,
        "variables": list(getattr(spec, "columns", None) or [spec.variable]),
        "batch": batch,
        "nodeId": node,
        "accuracy": {"accuracyValue": accuracy, "alpha": spec.alpha},
        "algorithmInfo": {"name": statistic, "argument": _constraint(spec, value)},
        "privacyLoss": loss,
        "releaseInfo": {"mechanism": MECHANISM_NAMES[spec.mechanism], "releaseValue": _plain(value)},
        "postprocess": False,
    }


def release_document(entries: Sequence[dict[str, Any]], description: str, unit: str, variables: int, schema: str, structure: str = "wide", created: datetime | None = None) -> str:
    """A document of releases in the exchange format. The number of rows stays private."""
    when = created or datetime.now(timezone.utc)
    return json.dumps({"self": {"schema_version": schema, "created": when.isoformat()}, "dataset": {"description": description, "unitOfAnalysis": unit, "structure": structure, "rowCount": "private", "variableCount": variables}, "dp-releases": list(entries)})
