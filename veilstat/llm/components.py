"""Connected components by alternating star contractions, all state in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, salt


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: each node's neighbours move to the smallest of them and itself.

    The large star moves the larger neighbours of every node; the small star moves the node and its smaller neighbours.
    The minimum is a partial aggregate. Its join back deals a node's links by their other end, so that a hub is not one task's; it
    goes only to the parts that a node's links are in, which for most nodes is one.
    """
    pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = pairs.groupBy("a", salt("b")).agg(F.min("b").alias("m")).groupBy("a").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))
    least = least.select("a", (F.least("a", "m") if large else F.col("m")).alias("m"), F.explode("salts").alias("salt"))
    met = pairs.select("*", salt("b")).join(least.hint("merge"), ["a", "salt"]).drop("salt")
    if large:
        moved = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return moved.where("a > b")


def _settled(state: DataFrame) -> bool:
    """Whether every link is from a node that has no other to one that has links to larger nodes only."""
    ends = state.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(state.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def stars(edges: DataFrame, scratch: Scratch, label: str = "cc", most: int = 60) -> DataFrame:
    """(a, b) links in, (a, b) out: each id but the smallest of its component beside the smallest.

    Rows with a null or with a = b say nothing and are ignored. Each round is written to the shared folder; two rounds
    are kept at a time. Rounds grow as the logarithm of the longest path; stars and a few new links take few.
    """
    flat = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state = scratch.save(f"{label}0", flat.distinct())
    for k in range(most):
        if _settled(state):
            return state
        state = scratch.save(f"{label}{k + 1}", _star(_star(state, True), False).distinct())
        scratch.drop(f"{label}{k}")
    raise RuntimeError(f"components did not settle in {most} rounds")


def labels(state: DataFrame) -> DataFrame:
    """(id, component) of every id in stars."""
    return state.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(state.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """(a, b) links in, (id, component) out for every id that has a link; component is the smallest reachable id."""
    return labels(stars(edges, scratch, label))
