"""Bounding, imputing and recoding columns. A missing value is a null, or a NaN of a floating column."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

NUMERIC = ("numeric", "integer", "double")


def null_of_nan(df: DataFrame, name: str) -> Column:
    """The column with NaN as null, where its type has NaN."""
    c = F.col(name)
    return F.when(~F.isnan(c), c) if isinstance(df.schema[name].dataType, (DoubleType, FloatType)) else c


def clamp(x: Column, low: float, high: float) -> Column:
    """Into [low, high]; null stays null (which least and greatest would not keep)."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def restrict(x: Column, levels: Sequence) -> Column:
    """Values outside the levels become null; a null among the levels changes nothing, null being kept anyway."""
    return F.when(x.isin([v for v in levels if v is not None]), x)


def censor(df: DataFrame, columns: Sequence[str], var_type: str, rng: Sequence | None = None, levels: Sequence | None = None, rng_format: str = "vector") -> list[Column]:
    """Bounded columns: one range for one column ('vector'), or a list with one for each ('list'); levels for categories."""
    if var_type in ("character", "factor"):
        return [restrict(F.col(c), levels).alias(c) if levels else F.col(c) for c in columns]
    if var_type not in (*NUMERIC, "logical"):
        raise ValueError("Input data x and varType do not match.")
    if rng_format not in ("vector", "list"):
        raise ValueError("range Format (rngFormat) must be either 'list' or 'vector'. If range is a tuple of multiple ranges, it must be formatted as a list.")
    ranges = [rng] * len(columns) if rng_format == "vector" else rng
    return [clamp(null_of_nan(df, c), *r).alias(c) for c, r in zip(columns, ranges, strict=True)]


def scale_values(u: Column, var_type: str, low: float | None = None, high: float | None = None, categories: Sequence | None = None) -> Column:
    """A uniform as a value of a type: over the range, over its whole numbers (both ends included), 0 or 1, or over the categories."""
    if var_type in ("numeric", "double"):
        return u * (high - low) + F.lit(float(low))
    if var_type == "integer":
        return (F.floor(u * (int(high) - int(low) + 1)) + int(low)).cast("int")
    if var_type == "logical":
        return F.floor(u * 2).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in categories]), (F.floor(u * len(categories)) + 1).cast("int"))


def secure_uniform() -> Column:
    """A fresh uniform wherever it is evaluated, from the JVM's secure generator. It must be used in one action only.

    Thirteen random hexadecimal digits of a random UUID. No Python worker takes part, and a condition around it guards it.
    """
    digits = F.substring(F.replace(F.expr("reflect('java.util.UUID', 'randomUUID')"), F.lit("-"), F.lit("")), 18, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def impute(x: Column, u: Column, var_type: str, low: float | None = None, high: float | None = None, categories: Sequence | None = None) -> Column:
    return F.when(x.isNull(), scale_values(u, var_type, low, high, categories)).otherwise(x)


def make_logical(df: DataFrame, name: str) -> DataFrame:
    """Two values to 0 and 1: of numbers the larger is 1, of categories the rarer (of equals the first in order)."""
    seen = [r for r in df.where(F.col(name).isNotNull()).groupBy(name).count().limit(3).collect()]
    if len(seen) > 2:
        raise ValueError("Variable has more than two values")
    if not seen:
        return df.withColumn(name, F.lit(None).cast("int"))
    numeric = not isinstance(seen[0][name], str)
    one = max(r[name] for r in seen) if numeric else min(seen, key=lambda r: (r["count"], r[name]))[name]
    return df.withColumn(name, F.when(F.col(name).isNotNull(), (F.col(name) == one).cast("int")))


def make_dummies(df: DataFrame, columns: Sequence[str], levels: dict[str, Sequence] | None = None) -> DataFrame:
    """Each column as 0/1 columns ``column_level`` of all its levels but the first; levels come sorted unless they are given."""
    out = [F.col(c) for c in df.columns if c not in columns]
    for c in columns:
        own = list(levels[c]) if levels and c in levels else sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect())
        out += [(F.col(c) == v).cast("double").alias(f"{c}_{v}") for v in own[1:]]
    return df.select(*out)


def order_statistics(df: DataFrame, name: str, ranks: Sequence[int], few: int = 1_000_000) -> list[float]:
    """The values at these places (from 0) of the sorted values that are not missing.

    Each is searched by brackets from approximate quantiles, counted exactly in one pass each. Where a bracket's ends are not the value, what
    lies strictly between them is searched on, so every pass leaves less, until a bracket holds at most ``few`` rows; no task sorts more than
    that, however many rows there are.
    """
    x = df.select(null_of_nan(df, name).cast("double").alias("x")).where("x is not null")
    n, out, v = x.count(), [], F.col("x")
    for rank in ranks:
        low, high, below, inside, width, value = -math.inf, math.inf, 0, n, 1e-3, None
        while inside > few and value is None:
            here = x.where(v.between(low, high))
            at = (rank - below) / (inside - 1)
            a, b = here.agg(F.percentile_approx("x", [max(0.0, at - width), min(1.0, at + width)], 10_000)).first()[0]
            under, on_a, upto, on_b, low_, high_ = here.agg(
                F.count_if(v < a), F.count_if(v == a), F.count_if(v <= b), F.count_if(v == b), F.min(F.when(v > a, v)), F.max(F.when(v < b, v))
            ).first()
            if not below + under <= rank < below + upto:
                width *= 2
            elif rank < below + under + on_a:
                value = a
            elif rank >= below + upto - on_b:
                value = b
            else:
                low, high, below, inside = low_, high_, below + under + on_a, upto - on_b - under - on_a
        if value is None:
            value = x.where(v.between(low, high)).agg(F.array_sort(F.collect_list("x"))[rank - below]).first()[0]
        out.append(value)
    return out


def quantiles(df: DataFrame, name: str, shares: Sequence[float]) -> list[float]:
    """Quantiles that interpolate between the two values beside them; NaN without values."""
    n = df.select(null_of_nan(df, name).alias("x")).where("x is not null").count()
    if not n:
        return [math.nan] * len(shares)
    places = [(n - 1) * s for s in shares]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    value = dict(zip(ranks, order_statistics(df, name, ranks)))
    return [value[math.floor(p)] + (value[math.ceil(p)] - value[math.floor(p)]) * (p - math.floor(p)) for p in places]


def trim(df: DataFrame, name: str, alpha: float) -> DataFrame:
    """Rows whose value is between the alpha/2 and the 1 - alpha/2 quantile, which interpolate."""
    low, high = quantiles(df, name, [alpha / 2, 1 - alpha / 2])
    return df.where(F.col(name).between(low, high))


def row_norm(columns: Sequence[str], p: float = 2) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + F.pow(F.abs(F.col(c)), F.lit(float(p)))
    return F.pow(total, F.lit(1.0 / p))


def column_norms(df: DataFrame, columns: Sequence[str], p: float = 2) -> DataFrame:
    return df.agg(*[F.pow(F.sum(F.pow(F.abs(F.col(c)), F.lit(float(p)))), F.lit(1.0 / p)).alias(c) for c in columns])


def unit_ball(df: DataFrame, columns: Sequence[str], p: float = 2) -> tuple[DataFrame, float]:
    """Columns over the largest row norm, and this norm. It comes from the data, so it is not private."""
    most = df.agg(F.max(row_norm(columns, p))).first()[0]
    return df.withColumns({c: F.col(c) / most for c in columns}), most
