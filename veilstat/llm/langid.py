"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are the runs of 3 and of 4 bytes of a text with A-Z in lower case, hashed into ``BUCKETS``. A document is the mean of their embeddings; a linear softmax
over the languages follows. Both are trained by stochastic gradient descent in numpy on the driver, on at most ``most``
labelled rows, whose subword counts the executors compute. A held-back part of them sets the temperature and the score
below which a prediction is rejected: the lowest at which accepted ones are right often enough.

As the model is linear, embeddings and softmax weights are one table with a row for each bucket, so that scoring a text is a sum over its bytes. The table
is of fixed size and is broadcast. Whole texts are scored, in slices; no row depends on another.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sample import Adam, distinct_texts, remainder, softmax, temperature
from .text import run_sums, slices

BUCKETS = 1 << 13
SIZES = (3, 4)
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
UNKNOWN = "und"


def subwords(data: np.ndarray, k: int) -> np.ndarray:
    """Bucket of the k bytes from each byte on."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    low = _LOWER[data]
    h = np.full(n, k * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for j in range(k):
        h = (h ^ low[j : n + j]) * np.uint32(0x01000193)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 13)


def counts(texts: pa.Array):
    """The buckets among a text's subwords and the share of each, for one text after another."""
    for row, stop, data, at in slices(texts):
        own = [subwords(data, k) for k in SIZES]
        for d in range(stop - row):
            x = sum(np.bincount(s[at[d] : max(at[d], at[d + 1] - k + 1)], minlength=BUCKETS) for s, k in zip(own, SIZES))
            some = np.flatnonzero(x)
            yield some.astype(np.uint16), (x[some] / max(1, x.sum())).astype(np.float32)


class Sparse:
    """Rows of shares by bucket; ``rows[part]`` gives some of them as a dense matrix."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, part: np.ndarray) -> np.ndarray:
        out = np.zeros((len(part), BUCKETS), np.float32)
        for i, k in enumerate(part):
            bucket, share = self.rows[k]
            out[i, bucket] = share
        return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    heat: float
    reject: float

    def logits(self, texts: pa.Array):
        """(first row, row after the last, logits, whether there is a letter) by slices."""
        for row, stop, data, at in slices(texts):
            total = np.zeros((stop - row, len(self.langs)))
            n = np.zeros(stop - row)
            for k in SIZES:
                bucket = subwords(data, k)
                end = np.minimum(np.maximum(at[:-1], at[1:] - k + 1), len(bucket))
                begin = np.minimum(at[:-1], len(bucket))
                total += run_sums(self.table, bucket, begin, end)
                n += np.maximum(end - begin, 0)
            letters = np.concatenate([[0], np.cumsum(_ALPHA[data], dtype=np.int32)])
            letter = letters[at[1:]] > letters[at[:-1]]
            for d in np.flatnonzero(~letter & (at[1:] > at[:-1])):
                letter[d] = any(c.isalpha() for c in data[at[d] : at[d + 1]].tobytes().decode())
            yield row, stop, total / np.maximum(n, 1)[:, None] + self.bias, letter


def fit(x: Sparse, label: np.ndarray, langs: list[str], dim: int = 16, epochs: int = 60, right: float = 0.99, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, own = order[: len(x) // 5], order[len(x) // 5 :]
    emb = rng.normal(0, 0.5, (BUCKETS, dim)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (dim, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    sgd = Adam([emb, out, bias], 0.02)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(own), max(1, len(own) // 64)):
            h = x[part] @ emb
            g = softmax(h @ out + bias)
            g[np.arange(len(part)), label[part]] -= 1
            g /= len(part)
            sgd.step([x[part].T @ (g @ out.T), h.T @ g, g.sum(axis=0)])
    table = emb @ out
    logits = np.concatenate([np.zeros((0, len(langs))), *(x[part].astype(np.float64) @ table + bias for part in np.array_split(held, max(1, len(held) // 256)))])
    heat = temperature(logits, label[held])
    reject = 0.0
    if len(held):
        p = softmax(logits / heat)
        score, hit = p.max(axis=1), p.argmax(axis=1) == label[held]
        down = np.argsort(-score, kind="stable")
        rate = np.cumsum(hit[down]) / np.arange(1, len(down) + 1)
        good = np.flatnonzero(rate >= right)
        reject = float(score[down[good[-1]]]) if len(good) else 1.0
    return Model(langs, table.astype(np.float32), bias.astype(np.float64), heat, reject)


def train(docs: DataFrame, most: int = 3000) -> Model | None:
    """A model from at most ``most`` rows of doc_id, text and lang, all of them allowed for learning; None if there are none."""

    def run(batches):
        for batch in batches:
            rows = list(counts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), *(pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in range(2))], ["lang", "bucket", "share"])

    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    rows = distinct_texts(rows, most).select("lang", "text").mapInArrow(run, "lang string, bucket binary, share binary").collect()
    rows = sorted(rows, key=lambda r: (r.lang, bytes(r.bucket), bytes(r.share)))
    if not rows:
        return None
    langs = sorted({r.lang for r in rows})
    at = {lang: i for i, lang in enumerate(langs)}
    x = Sparse([(np.frombuffer(bytes(r.bucket), np.uint16), np.frombuffer(bytes(r.share), np.float32)) for r in rows])
    return fit(x, np.array([at[r.lang] for r in rows]), langs)


def identify(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (calibrated, 0 to 1) and accepted (not rejected) of every row.

    Null texts and texts without a letter are ``und`` with score 0; without a model all are. A text with letters but fewer
    than three bytes gets the likeliest language. Repeated rows come out as often as they went in; a null doc_id stays null;
    other columns are ignored; an empty table gives an empty result.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            if m is None:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([ids, pa.array([UNKNOWN] * n), pa.array([0.0] * n), pa.array([False] * n)], ["doc_id", "lang_pred", "score", "accepted"])
                continue
            for row, stop, logits, letter in m.logits(texts):
                p = softmax(logits / m.heat)
                best, score = p.argmax(axis=1), p.max(axis=1)
                lang = [m.langs[b] if ok else UNKNOWN for b, ok in zip(best, letter)]
                score = np.where(letter, score, 0.0)
                yield pa.RecordBatch.from_arrays([ids.slice(row, stop - row), pa.array(lang, pa.string()), pa.array(score), pa.array(letter & (score >= m.reject))], ["doc_id", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def op(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Learns from the rows whose remainder modulo 3 is not 1; predicts all."""
    model = train(docs.where(remainder(3) != 1))
    return identify(spark, docs, model).select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
