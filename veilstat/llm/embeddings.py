"""Near-duplicate embeddings by a subspace pigeonhole join.

Vectors of length 1 with cosine c are at squared distance 2 - 2c. After a fixed rotation the dimensions are split into
blocks of ``WIDTH``; if a pair is within the squared distance, then in at least one block it is within that block's share
of it, in proportion to the block's dimensions. So each block is a range join in few dimensions, and the union of the
blocks' candidates misses no pair. Each candidate is then tested by its cosine in double precision.

The range join lays a grid of two radii over a block's first few dimensions: as many as it takes for the largest label
to have about ``FILL`` vectors in a cell. A vector is at home in one cell and a guest in those within one radius of it. Cells are
compared in pieces of at most ``PIECE`` home vectors with ``PIECE`` others, each pair of pieces a group of its own, so a crowded
cell is many tasks. Equal vectors of one label are one class, made before anything is joined, and count by their number.

No pair leaves a task. The range join says which vectors of a cell have a candidate there; only these are brought together with
their whole vectors. A pair is tested where one of them is at home, in the first block that has it as a candidate, and adds to that one's
number of links; of the links in a task those of a spanning forest come out, at most one for each vector.
"""

from __future__ import annotations

from functools import cache
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .store import Scratch, dealt
from .text import U, mix

WIDTH, FILL, PIECE, SLACK = 16, 500, 1024, 1e-9
#: What a squared distance between parts of unit vectors may change when they are kept in single precision, and more.
ROUGH = 1e-6
_KEY = ["label", "block", "cell"]


@cache
def rotation(dim: int) -> np.ndarray:
    """An orthogonal matrix drawn from the dimension's number."""
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def turned(x: np.ndarray) -> np.ndarray:
    """The vectors (rows) at length 1, rotated."""
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(x.shape[1]).T


def blocks(dim: int, limit: float) -> list[tuple[slice, float]]:
    """Dimensions and squared distance of each block."""
    cuts = [slice(a, min(a + WIDTH, dim)) for a in range(0, dim, WIDTH)]
    return [(c, limit * (c.stop - c.start) / dim) for c in cuts]


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T


def matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as rows."""
    flat = lists.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def _cells(limit: float, grid: int):
    """id, label, block and cell of a vector's homes and visits, whether it is at home there, and its part in the block."""

    def run(batches):
        for batch in batches:
            vec = batch.column("vec")
            size = np.diff(vec.offsets.to_numpy())
            for dim in np.unique(size).tolist():
                own = pa.array(np.flatnonzero(size == dim))
                x = turned(vec.take(own).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                for k, (cut, budget) in enumerate(blocks(dim, limit)):
                    part = np.ascontiguousarray(x[:, cut])
                    at = part[:, :grid] / (2 * (budget + 2 * ROUGH) ** 0.5)
                    low, home = np.floor(at - 0.5).astype(np.int64), np.floor(at).astype(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1]), pa.int32()), pa.array(part.ravel().astype(np.float32)))
                    for corner in range(1 << at.shape[1]):
                        here = low + [corner >> j & 1 for j in range(at.shape[1])]
                        cell = np.full(len(x), dim, U)
                        for j in range(at.shape[1]):
                            cell = mix(cell + here[:, j].astype(U))
                        cols = [batch.column("id").take(own), batch.column("label").take(own), pa.array(np.full(len(x), k, np.int32)), pa.array(cell.view(np.int64)), pa.array((here == home).all(axis=1)), pa.array(np.full(len(x), dim, np.int32)), lists]
                        yield pa.RecordBatch.from_arrays(cols, ["id", "label", "block", "cell", "home", "dim", "part"])

    return run


def _active(limit: float):
    """The vectors of a pair of pieces that have another within the block's distance."""

    def run(table):
        side, ids, dims = table.column("side").to_numpy(), table.column("id").to_numpy(), table.column("dim").to_numpy()
        own, rest = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        some = np.zeros(len(ids), bool)
        if len(own) and len(rest):
            x, k = matrix(table.column("part")).astype(np.float64), table.column("block")[0].as_py()
            budget = blocks(int(dims[0]), limit)[k][1]
            for row in range(0, len(own), 256):
                part = own[row : row + 256]
                near = (squares(x[part], x[rest]) <= budget + ROUGH) & (ids[part][:, None] != ids[rest])
                some[part] |= near.any(axis=1)
                some[rest] |= near.any(axis=0)
        return table.filter(pa.array(some)).select([*_KEY, "id", "home"])

    return run


def _links(limit: float, least: float):
    """For each home vector the rows it links with here, and links that join what is linked here."""

    def run(table):
        side, ids, n = table.column("side").to_numpy(), table.column("id").to_numpy(), table.column("n").to_numpy()
        own, rest = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b, count = [], [], []
        if len(own) and len(rest):
            x, k = matrix(table.column("vec")), table.column("block")[0].as_py()
            size, t = np.linalg.norm(x, axis=1), turned(x)
            cuts = blocks(x.shape[1], limit)
            mark, linked = ids.copy(), []
            for row in range(0, len(own), 256):
                part = own[row : row + 256]
                cosine = (x[part] @ x[rest].T) / size[part][:, None] / size[rest]
                link = cosine >= least
                for i, j in zip(*np.nonzero(np.abs(cosine - least) < 1e-12)):
                    link[i, j] = plain_cosine(x[part[i]].tolist(), x[rest[j]].tolist()) >= least
                link &= ids[part][:, None] != ids[rest]
                linked.append((part, link.copy()))
                if link.any():
                    for cut, budget in cuts[:k]:
                        link &= squares(t[part][:, cut], t[rest][:, cut]) > budget + SLACK
                    link &= squares(t[part][:, cuts[k][0]], t[rest][:, cuts[k][0]]) <= cuts[k][1] + SLACK
                a.append(ids[part])
                b.append(ids[part])
                count.append((link * n[rest]).sum(axis=1))
            # The smallest id that each vector reaches inside this task.
            top, before = np.iinfo(np.int64).max, None
            while before is None or (mark != before).any():
                before = mark.copy()
                for part, link in linked:
                    mark[part] = np.minimum(mark[part], np.where(link, mark[rest], top).min(axis=1))
                    mark[rest] = np.minimum(mark[rest], np.where(link, mark[part][:, None], top).min(axis=0))
            moved = mark != ids
            a.append(ids[moved])
            b.append(mark[moved])
            count.append(np.zeros(moved.sum(), np.int64))
        flat = [np.concatenate([np.zeros(0, np.int64), *z]) for z in (a, b, count)]
        keep = (flat[0] != flat[1]) | (flat[2] > 0)
        return pa.table({name: pa.array(z[keep], pa.int64()) for name, z in zip(("a", "b", "n"), flat)})

    return run


def plain_cosine(x: list[float], y: list[float]) -> float:
    dot = lambda u, v: sum(p * q for p, q in zip(u, v))
    return dot(x, y) / (dot(x, x) ** 0.5 * dot(y, y) ** 0.5)


def pieces(rows: DataFrame, size: int) -> DataFrame:
    """Pairs of pieces: each home vector (side 0) beside every piece of its cell's vectors, and each vector (side 1) beside every home piece."""
    many = rows.groupBy(*_KEY).agg(F.count_if("home").alias("h"), F.count("*").alias("m")).where("h > 0 and m > 1")
    many = many.select(*_KEY, F.ceil(F.col("h") / size).cast("int").alias("homes"), F.ceil(F.col("m") / size).cast("int").alias("alls"))
    got = dealt(rows, many, _KEY, "id")

    def piece(n: str) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(3)), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    one = got.where("home").select(*rows.columns, piece("homes").alias("i"), every("alls").alias("j"), F.lit(0).alias("side"))
    two = got.select(*rows.columns, every("homes").alias("i"), piece("alls").alias("j"), F.lit(1).alias("side"))
    return one.unionByName(two)


class EmbeddingJoin:
    """Links, components and what is kept for rows of vec_id, embedding and label.

    Vectors link only under equal labels that are not null. A vector that is null or zero, or holds a null or a non-finite
    component, links with nothing; so does a row with a null vec_id, whose component is null and which is not kept. Vectors of
    different lengths don't link. Repeated rows are vectors of their own that link with each other; rows with one vec_id are one
    node of a component. Other columns are ignored; an empty table gives an empty result.
    """

    def __init__(self, spark: SparkSession, least: float = 0.98):
        self.spark, self.least, self.tmp = spark, least, Scratch(spark, "embeddings")

    def classes(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows (vec_id, key) with a null key where there is no vector to compare, and classes (id, key, label, vec, n)."""
        vec = F.col("embedding").cast("array<double>")
        bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        some = F.exists("vec", lambda x: x != 0)
        ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~bad & some, F.lit(False))
        got = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), vec.alias("vec"))
        # The label's length tells it from what follows, whatever it holds.
        named = F.concat_ws(",", F.length("label").cast("string"), F.col("label"), F.col("vec").cast("array<string>"))
        key = F.unhex(F.sha2(named.cast("binary"), 256))
        got = self.tmp.save("rows", got.select("vec_id", F.when(ok, key).alias("key"), F.when(ok, F.col("label")).alias("label"), F.when(ok, F.col("vec")).alias("vec")))
        made = got.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.any_value("label").alias("label"), F.any_value("vec").alias("vec"))
        return got.select("vec_id", "key"), self.tmp.save("classes", made)

    def links(self, classes: DataFrame) -> DataFrame:
        """(a, a, n): n rows of other classes link with class a; (a, b, 0): links that join all that is linked."""
        limit = 2 - 2 * self.least + SLACK
        most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
        grid = min(WIDTH, max(1, ceil(log(max(most / FILL, 1), 4))))
        cells = classes.select("id", "label", "vec").mapInArrow(_cells(limit, grid), "id long, label string, block int, cell long, home boolean, dim int, part array<float>")
        cells = self.tmp.save("cells", cells)
        near = pieces(cells, PIECE).groupBy(*_KEY, "i", "j").applyInArrow(_active(limit), "label string, block int, cell long, id long, home boolean")
        near = self.tmp.save("near", near.distinct())
        self.tmp.drop("cells")
        rows = pieces(near, 4 * PIECE).join(classes.select("id", "n", "vec").hint("merge"), "id")
        found = rows.groupBy(*_KEY, "i", "j").applyInArrow(_links(limit, self.least), "a long, b long, n long")
        found = found.groupBy("a", "b").agg(F.sum("n").alias("n"))
        found = self.tmp.save("links", found)
        self.tmp.drop("near")
        return found

    def run(self, rows: DataFrame) -> DataFrame:
        keys, classes = self.classes(rows)
        links = self.links(classes)
        joined = components(links.where("a <> b").select("a", "b"), self.tmp)
        others = links.where("a = b").select("a", F.col("n").alias("others"))
        named = classes.select("key", "id", "n").join(others.withColumnRenamed("a", "id"), "id", "left").join(joined, "id", "left")
        named = named.select("key", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
        # A class of one row without links says nothing.
        named = self.tmp.save("named", named.where("n_links > 0"))
        self.tmp.drop("links", "classes")
        out = dealt(keys, named, "key", "vec_id", "left")
        component = F.coalesce("component", "vec_id")
        return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
