"""Bounded training samples and the small numerical tools that the models share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(n: int) -> Column:
    """crc32 of the doc_id as text, modulo n; a null doc_id gives null."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows in the order of a hash of doc_id: the same ones whatever the partitioning."""
    return rows.orderBy(F.xxhash64("doc_id"), *rows.columns).limit(most)


def distinct_texts(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the distinct rows, which have a doc_id and a text; texts are chosen by digests, never gathered in one place."""
    named = rows.withColumn("digest", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    key = [c for c in named.columns if c != "text"]
    return named.join(F.broadcast(bounded(named.select(*key).distinct(), most)), key).dropDuplicates(key).drop("digest")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The divisor of the logits under which held-back labels are likeliest, by golden-section search on its logarithm."""
    if not len(label):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return -float(np.log(np.maximum(p[np.arange(len(label)), label], 1e-12)).mean())

    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Adam:
    """Stochastic gradient steps with running first and second moments, in place."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
