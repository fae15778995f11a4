"""Exact Jaccard join of word-shingle sets as a metric-space join with pivots.

The distance is 1 - J; it is a metric on sets. Sets link when it is at most 1 - threshold (the radius).

1. Equal sets are one class (a digest of the sorted shingles); from here on only one set of a class takes part.
2. Sets with no link at all are told apart early. If A links with B, at most (1 - t) * |A| of A's shingles are missing
   from B, so a set with more shingles that no other class holds links with nothing. Counting is done first over the
   fixed fraction ``SAMPLE`` of all hash values (counting over part of the shingles can only keep more sets), then over
   all shingles of the sets left.
3. Neighbourhoods. In a space where nearly all sets are at distance 1 from each other, a few global pivots would put
   everything on one boundary. So a pivot serves the sets that can be near it: those which share one of their
   rarest (1 - t) * |A| + 1 shingles (linked sets always do). The pivot of such a shingle is the first set that holds it at
   all, so that sets of one kind meet at the same few pivots. A set is in the neighbourhood of every pivot it meets this way.
4. Sets inside the radius link with the first pivot they meet. With these links the components are known but for links
   between two of them, so of a neighbourhood only the sets outside its most frequent component, the core, are still in question.
5. Voronoi regions. A large neighbourhood gets ``PIVOTS`` pivots of its own. Each set is at home with the nearest and, as a boundary
   set, a guest of every pivot at most two radii further away than that: by the triangle inequality a set linked with A is in
   the region where A is at home. So core sets at home are compared with all sets of their region. Large regions are split again; a
   neighbourhood whose sets are about equally far from all pivots would only be copied, and stays whole.
6. In the regions left, core sets are compared with all others in blocks of at most ``BLOCK`` sets; only links leave a task.
7. Links between classes go to connected components.

A link inside a component that is already found is not looked for.

A region may hold a third of all sets: its rows are spread over tasks by set or by block, aggregates are partial, and
no task gets more than two blocks. Shingles are compared by 64-bit hashes, classes by 128-bit digests. What grows with the corpus is
joined by shuffles at every size, so that plans keep their shape.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import labels, stars
from .store import Scratch, dealt
from .text import U, mix, slices, words

SAMPLE = 0.3
BLOCK = 64
PIVOTS = 8
#: Shingles that a task holds before it hands them on.
HELD = 1 << 19
_JOIN = 0xA24BAED4963EE407


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: of all k-word runs, or of the one run when it has fewer words."""
    for row, stop, data, offsets in slices(texts):
        w = words(data, offsets, lower=True)
        gram, _ = w.grams(k)
        for d in range(stop - row):
            a, b = w.first[d], w.first[d + 1]
            if b - a >= k:
                yield np.unique(gram[a : b - k + 1])
            elif b > a:
                value = U(0)
                with np.errstate(over="ignore"):
                    for x in w.hash[a:b]:
                        value = mix(value * U(_JOIN) + x + U(1))
                    yield mix(np.array([value + U(b - a)], U))
            else:
                yield np.zeros(0, U)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _lists(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    flat = np.concatenate([*sets, np.zeros(0, U)]).astype(U).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _classes(k: int):
    def run(batches):
        for batch in batches:
            n, keys = [], []
            for s in shingle_sets(batch.column("text"), k):
                n.append(len(s))
                keys.append(digest(s) if len(s) else None)
            first = pa.array([key and int.from_bytes(key[:8], "big", signed=True) for key in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), first], ["doc_id", "n_shingles", "set_key", "key"])

    return run


def _low(k: int, share: float):
    """Class and hash of the shingles whose hash is in the lowest ``share`` of all values."""
    top = U(int(share * 2.0**64))

    def made(keys: list[int], low: list[np.ndarray]) -> pa.RecordBatch:
        key = np.repeat(np.array(keys, np.int64), np.array([len(x) for x in low], np.int64))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate([*low, np.zeros(0, U)]).view(np.int64))], ["key", "h"])

    def run(batches):
        for batch in batches:
            keys, low, held = [], [], 0
            for s in shingle_sets(batch.column("text"), k):
                if len(s):
                    low.append(s[: np.searchsorted(s, top)].copy())
                    keys.append(int.from_bytes(digest(s)[:8], "big", signed=True))
                    held += len(low[-1])
                    if held > HELD:
                        yield made(keys, low)
                        keys, low, held = [], [], 0
            yield made(keys, low)

    return run


def _full(k: int):
    def run(batches):
        for batch in batches:
            want, ids = batch.column("set_key").to_pylist(), batch.column("doc_id")
            rows, sets, held = [], [], 0

            def made():
                return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], ["id", "n", "shingles"])

            for i, s in enumerate(shingle_sets(batch.column("text"), k)):
                if len(s) and digest(s) == want[i]:
                    rows.append(i)
                    sets.append(s)
                    held += len(s)
                    if held > HELD:
                        yield made()
                        rows, sets, held = [], [], 0
            yield made()

    return run


def _compare(num: int, den: int):
    """Links of a block of core sets with a block of other sets."""

    def run(table):
        ids, core = table.column("id").to_numpy(), table.column("core").to_pylist()
        sets = [x.values.to_numpy() for x in table.column("shingles")]
        sizes = np.array([len(s) for s in sets])
        rest = np.array(sorted((i for i in range(len(ids)) if not core[i]), key=sizes.__getitem__), np.int64)
        links = set()
        for i in (i for i in range(len(ids)) if core[i]):
            a, b = np.searchsorted(sizes[rest] * den, sizes[i] * num), np.searchsorted(sizes[rest] * num, sizes[i] * den, "right")
            for j in rest[a:b]:
                if ids[i] != ids[j]:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if both * den >= num * (sizes[i] + sizes[j] - both):
                        links.add((int(max(ids[i], ids[j])), int(min(ids[i], ids[j]))))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


class JaccardJoin:
    """Classes of equal shingle sets, links between classes, and components over both.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Null, empty and blank texts have no set and link
    with nothing; every input row gets one output row, so a repeated row comes out as often as it went in and rows with
    one doc_id count as one node. A row with a null doc_id links with nothing and has a null component_id. An empty
    table gives an empty result. The threshold is num / den.
    """

    def __init__(self, spark: SparkSession, k: int = 5, num: int = 80, den: int = 100, block: int = BLOCK, rounds: int = 2):
        self.spark, self.k, self.num, self.den, self.block, self.rounds = spark, k, num, den, block, rounds
        self.tmp = Scratch(spark, "jaccard")

    def _distances(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs with the sizes of their intersection and union."""
        one = sets.select(F.col("id"), F.col("n"), F.col("shingles").alias("x")).hint("merge")
        two = sets.select(F.col("id").alias("pivot"), F.col("n").alias("pn"), F.col("shingles").alias("y")).hint("merge")
        both = F.size(F.array_intersect("x", "y")).cast("long")
        return pairs.join(one, "id").join(two, "pivot").withColumn("both", both).withColumn("either", F.col("n") + F.col("pn") - F.col("both")).drop("x", "y", "n", "pn")

    def _linked(self, at: DataFrame) -> DataFrame:
        return at.where(f"both * {self.den} >= {self.num} * either and id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))

    def _cores(self, members: DataFrame, joined: DataFrame) -> DataFrame:
        """region, id, core of region and id: the core is what lies outside the region's most frequent component.

        Only links between different components matter, and of two components one is not the most frequent.
        """
        rows = members.join(joined, "id", "left").select("region", "id", F.coalesce("component", "id").alias("component"))
        most = rows.groupBy("region", "component").agg(F.count("*").alias("m")).groupBy("region").agg(F.max(F.struct("m", "component")).alias("most"))
        return dealt(rows, most, "region", "id").select("region", "id", (F.col("component") != F.col("most.component")).alias("core"))

    def _split(self, regions: DataFrame, sets: DataFrame, state: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Voronoi regions with their boundaries, the regions that would not get smaller, and the components with the links found."""
        name = F.xxhash64("id", F.lit(k))
        pivots = regions.where("core").groupBy("region", F.pmod(name, F.lit(PIVOTS)).alias("part")).agg(F.min(F.struct(name, "id"))["id"].alias("pivot")).select("region", "pivot")
        at = self.tmp.save(f"at{k}", self._distances(dealt(regions, pivots, "region", "id"), sets))
        state = self._joined(state, self._linked(at), f"pivots{k}")
        far = at.withColumn("far", 1 - F.col("both") / F.col("either"))
        near = far.groupBy("region", "id").agg(F.min(F.struct("far", "pivot")).alias("near"))
        window = 2 * (self.den - self.num) / self.den + 1e-9
        inside = far.join(near, ["region", "id"]).where(F.col("far") <= F.col("near.far") + window)
        inside = self.tmp.save(f"inside{k}", inside.select("region", "pivot", "id", (F.col("core") & (F.col("pivot") == F.col("near.pivot"))).alias("core")))
        work = inside.groupBy("region", "pivot").agg((F.count("*") * F.count_if("core")).alias("w")).groupBy("region").agg(F.sum("w").alias("w"))
        whole = regions.groupBy("region").agg((F.count("*") * F.count_if("core")).alias("all"))
        good = self.tmp.save(f"good{k}", work.join(whole, "region").where("2 * w <= all").select("region"))
        made = dealt(inside, good, "region", "id").select(F.xxhash64("region", "pivot").alias("region"), "id", "core")
        made = self.tmp.save(f"voronoi{k}", made)
        self.tmp.drop(f"at{k}", f"inside{k}")
        return made, dealt(regions, good, "region", "id", "left_anti"), state

    def joined(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(doc_id, n_shingles, set_key) of every row, and the stars of the components of classes, which go by their smallest doc_id."""
        tmp, num, den = self.tmp, self.num, self.den
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        rows = tmp.save("rows", docs.mapInArrow(_classes(self.k), "doc_id long, n_shingles long, set_key binary, key long"))
        classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("set_key", "key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"))
        # A shingle that one class alone holds has one key; a class that has too many of them links with nothing.
        low = docs.where("doc_id is not null").mapInArrow(_low(self.k, SAMPLE), "key long, h long")
        own = low.groupBy("h").agg(F.min("key").alias("key"), F.max("key").alias("last")).where("key = last").groupBy("key").agg(F.count("*").alias("own"))
        left = classes.join(own.hint("merge"), "key", "left").where(f"coalesce(own, 0) * {den} <= n * {den - num}").select("id", "set_key")
        left = tmp.save("left", left)
        sets = docs.hint("merge").join(left.withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", "text", "set_key").distinct().mapInArrow(_full(self.k), "id long, n long, shingles array<long>")
        sets = tmp.save("sets", sets)
        # Rarest shared shingles of the sets that can still have a link.
        shingle = sets.select("id", "n", F.explode("shingles").alias("h"))
        often = shingle.groupBy("h").agg(F.count("*").alias("df"), F.min("id").alias("pivot")).where("df > 1")
        rare = (
            shingle.join(often.hint("merge"), "h")
            .groupBy("id", "n")
            .agg(F.count("*").alias("shared"), F.sort_array(F.collect_list(F.struct("df", "h", "pivot"))).alias("hs"))
            .where(f"shared * {den} >= n * {num}")
            .select("id", F.explode(F.expr(f"slice(hs, 1, cast(shared - ceil(n * {num} / {den}) + 1 as int))")).alias("r"))
            .select("id", "r.h", "r.pivot")
        )
        rare = tmp.save("rare", rare)
        lists = rare.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
        pairs = tmp.save("pairs", rare.join(lists.hint("merge"), "h").select("pivot", "id").distinct())
        used = pairs.select("id").unionByName(pairs.select(F.col("pivot").alias("id"))).distinct()
        sets = tmp.save("used", sets.join(used.hint("merge"), "id"))
        tmp.drop("left", "sets", "rare")
        # Most sets link with the first pivot they meet. Only neighbourhoods that hold several components after that are split and compared.
        first = pairs.where("pivot <> id").groupBy("id").agg(F.min("pivot").alias("pivot"))
        state = self._joined(None, self._linked(self._distances(first, sets)), "first")
        members = pairs.select(F.col("pivot").alias("region"), "id").unionByName(pairs.select(F.col("pivot").alias("region"), F.col("pivot").alias("id"))).distinct()
        regions = tmp.save("regions", self._cores(members, labels(state)))
        rest, k = [], 0
        while True:
            size = regions.groupBy("region").agg(F.count("*").alias("m"), F.count_if("core").alias("c")).where("c > 0")
            size = tmp.save(f"size{k}", size.withColumn("large", F.expr(f"m > {8 * self.block} and c > {self.block}")))
            if k >= self.rounds or size.where("large").isEmpty():
                rest.append(dealt(regions, size.select("region"), "region", "id", "left_semi"))
                break
            rest.append(dealt(regions, size.where("not large").select("region"), "region", "id", "left_semi"))
            regions, whole, state = self._split(dealt(regions, size.where("large").select("region"), "region", "id", "left_semi"), sets, state, k)
            rest.append(whole)
            k += 1
        last = rest[0]
        for more in rest[1:]:
            last = last.unionByName(more)
        state = self._joined(state, self._blocks(last, sets), "blocks")
        tmp.drop("pairs", "used", "regions", *(f"{name}{i}" for i in range(k + 1) for name in ("size", "good", "voronoi")))
        return rows.drop("key"), state

    def _joined(self, state: DataFrame | None, found: DataFrame, name: str) -> DataFrame:
        """The stars of the components with these links too."""
        found = self.tmp.save(name, found)
        if state is not None and found.isEmpty():
            return state
        out = stars(found if state is None else state.unionByName(found), self.tmp, f"{name}-")
        self.tmp.drop(name)
        return out

    def _blocks(self, regions: DataFrame, sets: DataFrame) -> DataFrame:
        """All links of core sets: blocks of core sets against blocks of all sets of the region, each pair a group of its own."""
        half = self.block // 2
        size = regions.groupBy("region").agg(F.count("*").alias("m"), F.count_if("core").alias("c")).where("c > 0 and m > 1")
        size = size.select("region", F.expr(f"cast(ceil(c / {half}) as int)").alias("cores"), F.expr(f"cast(ceil(m / {half}) as int)").alias("alls"))
        rows = dealt(regions, size, "region", "id")
        part = lambda n: F.expr(f"cast(pmod(xxhash64(id, 7), {n}) as int)")
        one = rows.where("core").select("region", "id", part("cores").alias("i"), F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("j"), F.lit(True).alias("core"))
        two = rows.select("region", "id", F.explode(F.sequence(F.lit(0), F.col("cores") - 1)).alias("i"), part("alls").alias("j"), F.lit(False).alias("core"))
        rows = one.unionByName(two).join(sets.select("id", "shingles").hint("merge"), "id")
        return rows.groupBy("region", "i", "j").applyInArrow(_compare(self.num, self.den), "a long, b long")

    def run(self, docs: DataFrame) -> DataFrame:
        rows, state = self.joined(docs)
        joined = labels(state)
        classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("last"))
        # A class of one doc_id without links says nothing.
        named = classes.join(joined.hint("merge"), "id", "left").where("id < last or component is not null").select("set_key", F.coalesce("component", "id").alias("component"))
        named = self.tmp.save("named", named)
        linked = dealt(rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")), named, "set_key", "doc_id", "left")
        return linked.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
