"""BPE encoding and decoding of a documents table.

Null texts are empty; an empty text has no ids; a very long text is encoded whole, in a slice of its own; repeated rows come
out as often as they went in; a null doc_id stays null; other columns are ignored; an empty table gives an empty result.
No row depends on another, so there is no shuffle, and a lost executor costs only the tasks it ran.
"""

from __future__ import annotations

import hashlib
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec, LibraryEncoder, TrieEncoder, Vocabulary


@cache
def codec(path: str, library: bool = False) -> Codec:
    """One codec for each worker process and vocabulary file; it remembers pieces from task to task."""
    vocabulary = Vocabulary(path)
    return Codec(vocabulary, LibraryEncoder(path) if library else TrieEncoder(vocabulary))


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every text."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            doc_id = batch.column("doc_id")
            for row, stop, ids, at in c.encode(batch.column("text")):
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype("int32")))
                yield pa.RecordBatch.from_arrays([doc_id.slice(row, stop - row), lists], ["doc_id", "ids"])

    return plain(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of doc_id and ids."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [c.decode(x.values.to_numpy()) if x.is_valid else None for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, ids_too: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, in one pass; on request also the ids."""

    def run(batches):
        c = codec(path)
        shown = [str(i) for i in range(len(c.v.bytes))]
        for batch in batches:
            doc_id = batch.column("doc_id")
            for row, stop, ids, at in c.encode(batch.column("text")):
                n, one, two = [], [], []
                for a, b in zip(at[:-1], at[1:]):
                    own = ids[a:b]
                    n.append(int(b - a))
                    one.append(hashlib.sha256(",".join(map(shown.__getitem__, own.tolist())).encode()).hexdigest())
                    two.append(hashlib.sha256(c.decode(own).encode()).hexdigest())
                cols = {"doc_id": doc_id.slice(row, stop - row), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(one, pa.string()), "decoded_sha256": pa.array(two, pa.string())}
                if ids_too:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype("int32")))
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return plain(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids_too)
