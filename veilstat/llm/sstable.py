"""Token ids in sorted-string-table shards.

A shard is immutable: data blocks, a sparse index with the first key and place of each block, a Bloom filter of all keys,
and a footer with their places. Keys are doc_ids as nine bytes (a null sorts first) and are kept as the length shared with the
key before plus the rest; a block starts from an empty key, so any block can be read alone. A block's keys and id counts
come first, then the ids of all its documents as one little-endian array, all under one zstd frame. Looking up a key
tests the filter, searches the index and reads one block.

Shards are written by range partitions sorted by doc_id, so they are in global order, and the place of each
document's first id among all ids is a running sum over shards plus one inside its shard.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Scratch
from .text import U, mix
from .tokenize import codec, plain

MAGIC = b"TIDSST01"
BLOCK_IDS = 1 << 16
SHARD_IDS = 1 << 25
HASHES, BITS = 7, 10
_FOOTER = struct.Struct("<QQQQQB8s")
_ENTRY = struct.Struct("<BBI")


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    x = np.array([zlib.crc32(k) << 32 | zlib.adler32(k) for k in keys], U)
    a, b = mix(x), mix(x ^ U(0x5851F42D4C957F2D)) | U(1)
    return (a[:, None] + b[:, None] * np.arange(HASHES, dtype=U)) % U(bits)


class Writer:
    """Appends documents in ascending key order to one shard; ``close`` gives the file's bytes written."""

    def __init__(self, sink, width: int):
        self.sink, self.width, self.at = sink, width, 0
        self.zip = zstandard.ZstdCompressor(level=1)
        self.keys: list[bytes] = []
        self.index: list[tuple[bytes, int, int]] = []
        self.n_ids = 0
        self._new()

    def _new(self) -> None:
        self.entries, self.ids, self.held, self.before, self.head = [], [], 0, b"", b""

    def _put(self, data: bytes) -> tuple[int, int]:
        self.sink.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key, same = key_of(doc_id), 0
        if not self.entries:
            self.head = key
        while same < len(self.before) and self.before[same] == key[same]:
            same += 1
        self.entries.append(_ENTRY.pack(same, len(key) - same, len(ids)) + key[same:])
        self.ids.append(ids.astype(f"<u{self.width}").tobytes())
        self.before = key
        self.held += len(ids)
        self.n_ids += len(ids)
        self.keys.append(key)
        if self.held >= BLOCK_IDS:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            raw = struct.pack("<I", len(self.entries)) + b"".join(self.entries) + b"".join(self.ids)
            self.index.append((self.head, *self._put(self.zip.compress(raw))))
            self._new()

    def close(self) -> int:
        self._flush()
        index = self._put(b"".join(k + struct.pack("<QI", a, n) for k, a, n in self.index))
        bits = max(64, BITS * len(self.keys))
        bloom = np.zeros(bits, bool)
        bloom[_probes(self.keys, bits).ravel().astype(np.int64)] = True
        filter_ = self._put(np.packbits(bloom).tobytes())
        self._put(_FOOTER.pack(*index, *filter_, bits, self.width, MAGIC))
        return self.at


class Reader:
    """Scans or looks up one shard from a seekable file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        *where, bits, self.width, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("this is no shard, or it was not closed")
        raw = self._read(where[0], where[1])
        self.first = [raw[i : i + 9] for i in range(0, len(raw), 21)]
        self.place = [struct.unpack_from("<QI", raw, i + 9) for i in range(0, len(raw), 21)]
        self.bits, self.bloom = bits, np.unpackbits(np.frombuffer(self._read(where[2], where[3]), np.uint8), count=bits).astype(bool)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        raw = zstandard.ZstdDecompressor().decompress(self._read(*self.place[k]))
        (n,), at, key, found = struct.unpack_from("<I", raw), 4, b"", []
        for _ in range(n):
            same, more, count = _ENTRY.unpack_from(raw, at)
            at += _ENTRY.size
            key = key[:same] + raw[at : at + more]
            at += more
            found.append((key, count))
        for key, count in found:
            yield key, np.frombuffer(raw, f"<u{self.width}", count, at)
            at += count * self.width

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.place)):
            for key, ids in self.block(k):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this doc_id, usually one."""
        key, out = key_of(doc_id), []
        if not self.bloom[_probes([key], self.bits).ravel().astype(np.int64)].all():
            return out
        k = bisect_right(self.first, key) - 1
        while k > 0 and self.first[k] == key:
            k -= 1
        for k in range(max(k, 0), len(self.place)):
            if self.first[k] > key:
                break
            out += [ids for own, ids in self.block(k) if own == key]
        return out


def open_folder(uri: str):
    """(file system, path) of a folder that every executor reaches by the same URI."""
    from pyarrow.fs import FileSystem

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = f"file://{uri.removeprefix('file:')}"
    return FileSystem.from_uri(uri)


class TokenShards:
    """Writes a documents table as shards under ``uri`` and reads them back.

    Null texts are empty and hold only the end id; rows with one doc_id are ordered by their text; a null doc_id comes first;
    other columns are ignored; an empty table gives no shards and an empty result. A shard's name holds the attempt that wrote
    it and only the manifest, written when all are closed, says which shards count, so retried and lost tasks do no harm.
    """

    def __init__(self, spark: SparkSession, path: str, end_id: int, uri: str | None = None, shard_ids: int = SHARD_IDS):
        self.spark, self.path, self.end_id, self.shard_ids = spark, path, end_id, shard_ids
        self.tmp = Scratch(spark, "shards")
        self.uri = uri or self.tmp.path("data")

    def write(self, docs: DataFrame) -> DataFrame:
        """The manifest: shard, place in order, first and last doc_id, numbers of documents and ids."""
        path, end_id, most, uri = self.path, np.uint32(self.end_id), self.shard_ids, self.uri

        def run(batches):
            c, context = codec(path, True), TaskContext.get()
            files, folder = open_folder(uri)
            files.create_dir(folder, recursive=True)
            part, width, k, w = context.partitionId(), 2 if len(c.v.bytes) <= 1 << 16 and end_id < 1 << 16 else 4, 0, None

            def done():
                row = {"shard": name, "part": part, "k": k, "first": id_of(w.keys[0]), "last": id_of(w.keys[-1]), "n_docs": len(w.keys), "n_ids": w.n_ids}
                row["n_bytes"] = w.close()
                sink.close()
                return pa.RecordBatch.from_pylist([row], schema)

            schema = pa.schema([("shard", pa.string()), ("part", pa.int64()), ("k", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
            for batch in batches:
                doc_ids = batch.column("doc_id").to_pylist()
                for row, stop, ids, at in c.encode(batch.column("text")):
                    for d in range(stop - row):
                        if w is None:
                            name = f"{part:06d}-{k:04d}-{context.taskAttemptId()}.sst"
                            sink = files.open_output_stream(f"{folder}/{name}")
                            w = Writer(sink, width)
                        w.add(doc_ids[row + d], np.append(ids[at[d] : at[d + 1]], end_id))
                        if w.n_ids >= most:
                            yield done()
                            w, k = None, k + 1
            if w is not None:
                yield done()

        rows = plain(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
        made = rows.mapInArrow(run, "shard string, part long, k long, first long, last long, n_docs long, n_ids long, n_bytes long")
        return self.tmp.save("manifest", made)

    def read(self, manifest: DataFrame) -> DataFrame:
        """doc_id, start, n_tokens and ids_crc32 of every document, from the shards."""
        uri = self.uri

        def run(batches):
            files, folder = open_folder(uri)
            for batch in batches:
                for shard, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist()):
                    rows = []
                    with files.open_input_file(f"{folder}/{shard}") as f:
                        for doc_id, ids in Reader(f).scan():
                            rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                            start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

        # One row for each shard, so this order over all of them is small.
        before = Window.orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)
        placed = manifest.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
        return placed.repartition(max(1, manifest.count()), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
