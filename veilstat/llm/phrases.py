"""Removal of passages that an earlier document has: windows of ``window`` words.

1. Seeds. Of the ``SEED``-word runs in a window the one with the smallest hash is the window's seed, so two equal windows have
   equal seeds, and about one run in twenty is a seed. Seeds that occur in two different texts are confirmed; a window can
   recur between different texts only if its seed does. A seed belongs to the smallest doc_id that has it.
2. Automata. The words of a confirmed seed are cut from the document it belongs to. These phrases are dealt into shards of about ``PHRASES``
   by the document they come from; each shard is compiled into an Aho-Corasick automaton. A document goes to the shards of which
   it has a seed (none others can have a phrase of it) and is streamed whole through their automata, which locate every occurrence. The
   documents of a shard are dealt into parts of about ``PART`` words, each with the shard's automaton.
3. Windows whose seed was located are hashed whole and counted over all documents: the smallest doc_id of a window owns it.
4. Every window that a smaller doc_id owns covers its words, and covered words go.

A copy of a whole text under a larger doc_id loses all its words and needs none of this; equal texts are found by a digest of their words.
A phrase in a third of all documents is that many rows but no single task's: owners are partial minima, the joins are on plain columns, and
shards are dealt into parts. Windows are compared by 64-bit hashes of their words.

Null texts are empty; a text of fewer words than a window keeps them all; a row with a null doc_id neither owns windows nor loses
words; rows with one doc_id are one document, so they take nothing from each other; repeated rows come out as often as they went
in; very long texts are taken whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from math import ceil

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch, dealt
from .text import U, Words, slices, words
from .tokenize import plain

SEED = 12
PHRASES = 5_000
PART = 2_000_000
_TOP = U(2**64 - 1)
_GAP = re.compile(rb"[\x20\x09-\x0d]+")


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n values in a row, by doubling."""
    done = 1
    while 2 * done <= n:
        x, done = np.minimum(x[:-done], x[done:]), 2 * done
    return np.minimum(x[: len(x) - (n - done)], x[n - done :]) if n > done else x


def seeds(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run hashes, the smallest of each window from each word on, and which windows lie in one text."""
    runs, inside = w.grams(SEED)
    runs = np.minimum(runs, _TOP - U(1))
    n = len(w.hash) - window + 1
    if n <= 0:
        return runs, np.zeros(0, U), np.zeros(0, bool)
    doc = w.doc
    low = sliding_min(np.where(inside, runs, _TOP), window - SEED + 1)
    return runs, low[:n], doc[window - 1 :] == doc[:n]


def plain_words(text: bytes) -> bytes:
    """The words with one space between two of them."""
    return _GAP.sub(b" ", text).strip(b" ")


def _emit(window: int):
    """doc_id, the first half of the digest of the words, their number, and the seeds of every text that has a window."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for row, stop, data, at in slices(batch.column("text")):
                w, raw = words(data, at), data.tobytes()
                _, low, whole = seeds(w, window)
                first, kept, own, sha, size = np.minimum(w.first, len(low)), [], [], [], np.diff(w.first)
                for d in np.flatnonzero(size >= window).tolist():
                    a, b = first[d], first[d + 1]
                    kept.append(row + d)
                    own.append(np.unique(low[a:b][whole[a:b]]).view(np.int64))
                    sha.append(int.from_bytes(hashlib.sha256(plain_words(raw[at[d] : at[d + 1]])).digest()[:8], "big", signed=True))
                if kept:
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in own])]), pa.int32()), pa.array(np.concatenate(own)))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept)), pa.array(sha, pa.int64()), pa.array(size[np.array(kept) - row], pa.int32()), lists], ["doc_id", "text_key", "n", "seeds"])

    return run


def compiled(phrases: list[bytes]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:
        automaton.add_word(f" {p.decode('latin-1')} ")
    automaton.make_automaton()
    return automaton


def occurrences(body: bytes, automaton: ahocorasick.Automaton) -> np.ndarray:
    """The words of the body at which one of the automaton's phrases begins."""
    found = np.array([end - n + 1 for end, n in automaton.iter(f" {body.decode('latin-1')} ")], np.int64)
    if not len(found):
        return found
    begins = np.concatenate([[0], np.flatnonzero(np.frombuffer(body, np.uint8) == 0x20) + 1])
    return np.unique(np.searchsorted(begins, found))


def _bodies(window: int):
    """Every row with its words' number and digest; its words where it may lose some; the phrases that belong to it; whether it is a copy."""

    def run(batches):
        part, row_id = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            shards, own, first = batch.column("shards"), batch.column("own"), batch.column("copies")
            for row, stop, data, at in slices(batch.column("text")):
                w, raw, n = words(data, at), data.tobytes(), stop - row
                runs, _ = w.grams(SEED)
                runs = np.minimum(runs, _TOP - U(1))
                sha, body, phrases, copy = [], [None] * n, [[] for _ in range(n)], [False] * n
                for d in range(n):
                    text = plain_words(raw[at[d] : at[d + 1]])
                    digest = hashlib.sha256(text)
                    sha.append(digest.hexdigest())
                    a, b = w.first[d], w.first[d + 1]
                    if b - a < window:
                        continue
                    if first[row + d].is_valid and int.from_bytes(digest.digest()[:8], "big", signed=True) in first[row + d].as_py():
                        copy[d] = True
                    elif shards[row + d].is_valid:
                        body[d] = text
                        place = np.concatenate([[0], np.cumsum(w.end[a:b] - w.start[a:b] + 1)])
                        here = runs[a : b - SEED + 1]
                        mine = np.flatnonzero(np.isin(here, own[row + d].values.to_numpy().view(U)))
                        phrases[d] = list({text[place[p] : place[p + SEED] - 1] for p in mine.tolist()})
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part + row_id + np.arange(n), pa.int64()),
                        batch.column("doc_id").slice(row, n),
                        pa.array(np.diff(w.first), pa.int64()),
                        pa.array(sha, pa.string()),
                        pa.array(copy, pa.bool_()),
                        pa.array(body, pa.binary()),
                        shards.slice(row, n),
                        batch.column("home").slice(row, n),
                        pa.array(phrases, pa.list_(pa.binary())),
                    ],
                    ["row", "doc_id", "n_words", "sha", "copy", "body", "shards", "home", "phrases"],
                )
                row_id += n

    return run


def _scan(window: int):
    """The windows of a part of a shard's documents whose seed the shard's automaton locates."""

    def run(bodies, phrases):
        out = []
        if bodies.num_rows and phrases.num_rows:
            automaton = compiled(phrases.column("phrase").to_pylist())
            texts = bodies.column("body").combine_chunks()
            ids, rows = bodies.column("doc_id").to_numpy(), bodies.column("row").to_numpy()
            for row, stop, data, at in slices(pc.cast(texts, pa.large_binary()).cast(pa.large_string())):
                w, raw = words(data, at), data.tobytes()
                runs, low, _ = seeds(w, window)
                grams, _ = w.grams(window)
                for d in range(stop - row):
                    a, b = w.first[d], w.first[d + 1] - window + 1
                    occ = occurrences(raw[at[d] : at[d + 1]], automaton)
                    own = np.full(b - a + window - SEED, _TOP)
                    occ = occ[occ < len(own)]
                    own[occ] = runs[a + occ]
                    spot = np.flatnonzero(sliding_min(own, window - SEED + 1) == low[a:b])
                    if len(spot):
                        out.append((rows[row + d], ids[row + d], spot.astype(np.int32), grams[a + spot].view(np.int64)))
        ends = pa.array(np.concatenate([[0], np.cumsum([len(x[2]) for x in out])]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, kind), *(x[k] for x in out)]).astype(kind))) for k, kind in ((2, np.int32), (3, np.int64))]
        return pa.Table.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), *lists], ["row", "doc_id", "at", "h"])

    return run


def _cut(window: int):
    """Digest of what is left of a body without the words of the windows at ``gone``."""

    def run(batches):
        for batch in batches:
            removed, sha, texts = [], [], []
            for body, gone in zip(batch.column("body").to_pylist(), batch.column("gone")):
                own = body.split(b" ")
                edge = np.zeros(len(own) + 1, np.int64)
                at = gone.values.to_numpy()
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                cover = np.cumsum(edge[:-1]) > 0
                kept = b" ".join([x for x, c in zip(own, cover.tolist()) if not c])
                removed.append(int(cover.sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())], ["row", "n_removed", "kept_sha256", "kept"])

    return run


class RepeatedPhrases:
    """doc_id, n_words, n_removed, kept_sha256 of every row, and ``kept``: the words left, where some were removed."""

    def __init__(self, spark: SparkSession, window: int = 50):
        self.spark, self.window, self.tmp = spark, window, Scratch(spark, "phrases")

    def bodies(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Every row with its words' number and digest, and its words if windows of it may recur; and the parts of each shard."""
        tmp = self.tmp
        made = tmp.save("seeds", docs.where("doc_id is not null").mapInArrow(_emit(self.window), "doc_id long, text_key long, n int, seeds array<long>"))
        rows = made.select("doc_id", "text_key", "n", F.explode("seeds").alias("h"))
        often = rows.groupBy("h").agg(F.min("doc_id").alias("a"), F.min("text_key").alias("one"), F.max("text_key").alias("two")).where("one < two").select("h", "a")
        often = tmp.save("often", often)
        shard = F.pmod(F.xxhash64("a"), F.lit(max(1, ceil(often.count() / PHRASES)))).cast("int")
        met = rows.drop("text_key").join(often.hint("merge"), "h").groupBy("doc_id", shard.alias("shard")).agg(F.max("n").cast("long").alias("n"), F.collect_set(F.when(F.col("doc_id") == F.col("a"), F.col("h"))).alias("own"))
        met = tmp.save("met", met)
        parts = tmp.save("parts", met.groupBy("shard").agg(F.ceil(F.sum("n") / PART).cast("int").alias("parts")))
        hits = met.join(parts, "shard").groupBy("doc_id").agg(
            F.collect_list(F.struct("shard", "parts")).alias("shards"), F.flatten(F.collect_list("own")).alias("own"), F.max(F.when(F.size("own") > 0, F.col("shard"))).alias("home")
        )
        first = made.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
        copies = dealt(made.select("doc_id", "text_key"), first, "text_key", "doc_id").where("first < doc_id").groupBy("doc_id").agg(F.collect_set("text_key").alias("copies"))
        known = tmp.save("known", hits.join(copies.hint("merge"), "doc_id", "full"))
        tmp.drop("seeds", "often", "met")
        # What is known grows with the corpus, so it is never broadcast.
        routed = docs.hint("merge").join(known, "doc_id", "left").select("doc_id", "text", "shards", "own", "home", "copies")
        schema = "row long, doc_id long, n_words long, sha string, copy boolean, body binary, shards array<struct<shard:int,parts:int>>, home int, phrases array<binary>"
        out = tmp.save("bodies", routed.mapInArrow(_bodies(self.window), schema))
        tmp.drop("known")
        return out, parts

    def located(self, bodies: DataFrame, parts: DataFrame) -> DataFrame:
        """Windows (row, doc_id, at, h, as arrays) that may recur."""
        tmp = self.tmp
        phrases = tmp.save("phrases", bodies.select(F.col("home").alias("shard"), F.explode("phrases").alias("phrase")).distinct())
        each = phrases.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "phrase")
        texts = bodies.where("body is not null and doc_id is not null").select("row", "doc_id", "body", F.explode("shards").alias("s"))
        texts = texts.select("row", "doc_id", "body", "s.shard", F.pmod(F.xxhash64("row"), F.col("s.parts")).cast("int").alias("part"))
        found = texts.groupBy("shard", "part").cogroup(each.groupBy("shard", "part")).applyInArrow(_scan(self.window), "row long, doc_id long, at array<int>, h array<long>")
        return tmp.save("located", found)

    def run(self, docs: DataFrame) -> DataFrame:
        tmp = self.tmp
        bodies, parts = self.bodies(plain(docs))
        windows = self.located(bodies, parts).select("row", "doc_id", F.explode(F.arrays_zip("at", "h")).alias("w")).select("row", "doc_id", "w.at", "w.h")
        owner = tmp.save("owner", windows.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "first"))
        gone = windows.join(owner.hint("merge"), "h").where("first < doc_id").groupBy("row").agg(F.collect_list("at").alias("gone"))
        gone = tmp.save("gone", gone)
        tmp.drop("owner", "located", "phrases", "parts")
        cut = bodies.select("row", "body").where("body is not null").join(gone.hint("merge"), "row")
        cut = tmp.save("cut", cut.mapInArrow(_cut(self.window), "row long, n_removed long, kept_sha256 string, kept string"))
        tmp.drop("gone")
        out = bodies.select("row", "doc_id", "n_words", "sha", "copy").join(cut.hint("merge"), "row", "left")
        none = hashlib.sha256(b"").hexdigest()
        return out.select(
            "doc_id",
            "n_words",
            F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(F.col("copy"), none).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
            F.when(F.col("copy"), "").otherwise(F.col("kept")).alias("kept"),
        )
