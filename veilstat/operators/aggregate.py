"""True aggregates, before noise: one pass with partial sums on the map side, and small results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def right_closed_bin(x: Column, breaks: Sequence[float]) -> Column:
    """Number of the bin of x: [b0, b1], (b1, b2], ...; null outside, or for null. Few bins are compared, many are searched by halves."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(x <= breaks[mid + 1], search(low, mid)).otherwise(search(mid + 1, high))

    return F.when((x >= breaks[0]) & (x <= breaks[-1]), search(0, len(breaks) - 2))


def bin_labels(breaks: Sequence[float]) -> list[str]:
    return [("[" if i == 0 else "(") + f"{a:g},{b:g}]" for i, (a, b) in enumerate(zip(breaks, breaks[1:]))]


def binned_counts(values: DataFrame, x: Column, breaks: Sequence[float]) -> DataFrame:
    """bin, label, count for every bin, empty ones included."""
    labels = bin_labels(breaks)
    counts = values.select(right_closed_bin(x, breaks).alias("bin")).where("bin is not null").groupBy("bin").count()
    all_bins = values.sparkSession.createDataFrame(list(enumerate(labels)), "bin int, label string")
    return all_bins.join(counts, "bin", "left").select("bin", "label", F.coalesce("count", F.lit(0)).alias("count"))


def category_counts(values: DataFrame, x: Column, bins: Sequence | None) -> DataFrame:
    """bin (as text, null as NA), count: for every one of the bins, or without bins for every value that occurs."""
    shown = F.coalesce(x.cast("string"), F.lit("NA"))
    counts = values.select(shown.alias("bin")).groupBy("bin").count()
    if bins is None:
        return counts
    listed = values.sparkSession.createDataFrame([("NA" if b is None else str(b),) for b in bins], "bin string")
    return listed.join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))


def lower_triangle(columns: Sequence[str]) -> list[tuple[str, str]]:
    """Pairs (row, column) of the lower triangle with its diagonal, column by column."""
    return [(columns[i], columns[j]) for j in range(len(columns)) for i in range(j, len(columns))]


def covariances(columns: Sequence[str], of: dict[str, Column] | None = None) -> list[Column]:
    """Sample covariances of the lower triangle, to be taken in one aggregate."""
    of = of or {c: F.col(c) for c in columns}
    return [F.covar_samp(of[a], of[b]).alias(f"cov_{a}_{b}") for a, b in lower_triangle(columns)]


def declared_mean(x: Column, n: int) -> Column:
    """Sum over the declared number of rows."""
    return F.sum(x) / n


def tree_depth(low: float, high: float, gran: float) -> int:
    size, depth = int((high - low) / gran + 1), 0
    while 1 << depth < size:
        depth += 1
    return depth


def tree_nodes(values: DataFrame, x: Column, low: float, high: float, gran: float) -> DataFrame:
    """node, count for nodes 1 to 2^depth - 1 of the dyadic tree over the range.

    A value's leaf is its step from ``low`` plus 2^depth; every ancestor counts it. Values are counted by leaf first, so
    each row is read once and only distinct leaves are spread over their levels.
    """
    depth = tree_depth(low, high, gran)
    leaf = (F.floor((x - low) / gran) + (1 << depth)).cast("long")
    leaves = values.select(leaf.alias("leaf")).where("leaf is not null").groupBy("leaf").count()
    spread = leaves.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(max(depth, 1))), lambda k: F.call_function("shiftright", F.col("leaf"), k))).alias("node"), "count")
    counts = spread.groupBy("node").agg(F.sum("count").alias("count"))
    return values.sparkSession.range(1, 1 << depth).select(F.col("id").alias("node")).join(counts, "node", "left").select("node", F.coalesce("count", F.lit(0)).alias("count"))
