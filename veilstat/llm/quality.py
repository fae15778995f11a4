"""Quality classifier: random-indexing word vectors pooled over a document, and a two-layer network.

Every word is two tokens: its hash in lower case, and its shape (case, length, marks at its end, and whether the document has had the word
and the one after it before). Each token bucket has a sparse random index vector. A word's vector is the sum of the
index vectors of the words and shapes up to two places away, over the training texts, scaled to length 1; a bucket never
seen keeps its index vector. A document is the mean of its words' vectors beside the mean of its shapes' index vectors.

The network (one hidden layer, one logit) is trained in numpy on the driver, on the pooled vectors of at most ``most``
labelled rows; executors add up word vectors and pool. A held-back part of the rows sets the temperature. All tables
are of fixed size and are broadcast. Whole texts are scored, in slices; no row depends on another.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sample import Adam, bounded, distinct_texts, remainder, temperature
from .store import Scratch
from .text import U, mix, run_sums, slices, words

WORDS, SHAPES, DIM = 1 << 14, 1 << 11, 32


def index_vectors(n: int, seed: int) -> np.ndarray:
    """Four entries of +-1/2 in each row, at places drawn from the row's number."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIM), np.float32)
    place = rng.integers(0, DIM, (n, 4))
    np.add.at(out, (np.arange(n)[:, None], place), rng.choice(np.float32([-0.5, 0.5]), (n, 4)))
    return out


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket and shape bucket of each word, and where each text's words begin."""
    w = words(data, at, lower=True)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data < 91), dtype=np.int32)])
    n = w.end - w.start
    caps = upper[w.end] - upper[w.start]
    mark = lambda b: ~(((b | 32) >= 97) & ((b | 32) < 123) | (b >= 128))
    last = data[w.end - 1] if len(n) else np.zeros(0, np.uint8)
    prior = data[np.maximum(w.end - 2, w.start)] if len(n) else last
    case = np.where(caps == 0, 0, np.where(2 * caps > n, 2, 1))
    again = np.zeros(len(n), np.int64)
    pair, inside = w.grams(2)
    pair = np.append(np.where(inside, pair, U(0)), U(0))[: len(n)] if len(n) else pair
    for d in range(len(at) - 1):
        a, b = w.first[d], w.first[d + 1]
        if b - a > 1:
            first = np.unique(pair[a:b], return_index=True)[1]
            seen = np.ones(b - a, np.int64)
            seen[first] = 0
            again[a:b] = seen
    shape = np.where(mark(last), last, 0).astype(U) << U(16) | np.where(mark(prior), prior, 0).astype(U) << U(8) | (case * 2 + again).astype(U) << U(4) | np.minimum(n, 15).astype(U)
    return (w.hash >> U(64 - 14)).astype(np.int64), (mix(shape) >> U(64 - 11)).astype(np.int64), w.first


def pooled(vectors: np.ndarray, index: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of vectors[index] over each text; zero for a text without words."""
    return run_sums(vectors, index, first[:-1], first[1:]) / np.maximum(np.diff(first), 1)[:, None]


@dataclass
class Model:
    words: np.ndarray
    shapes: np.ndarray
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    net: list[np.ndarray] | None = None
    heat: float = 1.0
    base: float = 0.5

    def features(self, texts: pa.Array):
        for row, stop, data, at in slices(texts, 300_000):
            word, shape, first = tokens(data, at)
            yield row, stop, np.hstack([pooled(self.words, word, first), pooled(self.shapes, shape, first)])

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.net
        return (np.maximum(((x - self.mean) / self.scale) @ a + b, 0) @ c + d)[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.heat, -40, 40)))


def fit(model: Model, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 150, seed: int = 11) -> Model:
    """The network of ``model`` for pooled vectors and labels 0 or 1; with labels of one kind only, their share."""
    if len(np.unique(y)) < 2:
        model.base = float(y.mean()) if len(y) else 0.5
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, own = order[: len(x) // 5], order[len(x) // 5 :]
    model.mean, model.scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    z = (x - model.mean) / model.scale
    a, b = rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], hidden)), np.zeros(hidden)
    c, d = rng.normal(0, (2 / hidden) ** 0.5, (hidden, 1)), np.zeros(1)
    sgd = Adam([a, b, c, d], 3e-3)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
            h = np.maximum(z[part] @ a + b, 0)
            g = (1 / (1 + np.exp(-np.clip(h @ c + d, -40, 40))) - y[part, None]) / len(part)
            back = (g @ c.T) * (h > 0)
            sgd.step([z[part].T @ back + 1e-3 * a, back.sum(axis=0), h.T @ g + 1e-3 * c, g.sum(axis=0)])
    model.net = [a, b, c, d]
    logit = model.logit(x[held])
    model.heat = temperature(np.stack([np.zeros(len(held)), logit], axis=1), y[held].astype(int))
    return model


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = 6000) -> Model:
    """A model from at most ``most`` rows of labels (doc_id, quality 0 or 1), all allowed for learning, and their texts."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    chosen = F.broadcast(bounded(marks.groupBy("doc_id").agg(F.min("quality").alias("quality")), most))
    rows = distinct_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id"), most)
    # Written once: both passes below read it, and the driver plans and broadcasts what chooses it once.
    tmp = Scratch(spark, "quality")
    rows = tmp.save("sample", rows)
    model = Model(index_vectors(WORDS, 1), index_vectors(SHAPES, 2))
    shared = spark.sparkContext.broadcast(model)

    def context(batches):
        m, total = shared.value, np.zeros((WORDS, DIM), np.float32)
        for batch in batches:
            for _, _, data, at in slices(batch.column("text")):
                word, shape, first = tokens(data, at)
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                own = m.words[word] + m.shapes[shape]
                for k in (1, 2):
                    if len(word) > k:
                        near = (doc[k:] == doc[:-k]).astype(np.float32)[:, None]
                        for bucket, vector in ((word[k:], own[:-k] * near), (word[:-k], own[k:] * near)):
                            order = np.argsort(bucket, kind="stable")
                            start = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                            total[bucket[order][start]] += np.add.reduceat(vector[order], start, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    # A handful of tasks, so a handful of tables of fixed size come back.
    parts = rows.select("text").repartition(6).mapInArrow(context, "total binary").collect()
    total = sum((np.frombuffer(bytes(r.total), np.float32).reshape(WORDS, DIM).astype(np.float64) for r in parts), np.zeros((WORDS, DIM)))
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    model = Model(np.where(norm > 0, total / np.maximum(norm, 1e-9), model.words).astype(np.float32), model.shapes)
    vectors = spark.sparkContext.broadcast(model)

    def pool(batches):
        for batch in batches:
            for row, stop, x in vectors.value.features(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, stop - row), batch.column("quality").slice(row, stop - row), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "quality", "x"])

    got = sorted(rows.select("doc_id", "quality", "text").mapInArrow(pool, "doc_id long, quality int, x binary").collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    tmp.drop("sample")
    x = np.array([np.frombuffer(bytes(r.x)) for r in got]).reshape(len(got), 2 * DIM)
    return fit(model, x, np.array([r.quality for r in got], float))


def score(spark: SparkSession, docs: DataFrame, model: Model, name: str = "__score") -> DataFrame:
    """All columns of ``docs`` with a score under a ``name`` that is free: 0 to 1, higher where label 1 is likelier.

    Null and empty texts have the score of a text without words; repeated rows come out as often as they went in; an empty table
    gives an empty result. Without labels every score is 0.5; with labels of one kind, their value.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            out = [shared.value.score(x) for _, _, x in shared.value.features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], [*batch.schema.names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def op(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the rows whose remainder modulo 5 is not 0; scores all."""
    model = train(spark, docs, labels.where(remainder(5) != 0))
    rows = score(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return rows.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.3).cast("int").alias("predicted"))
