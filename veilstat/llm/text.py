"""Word arithmetic on Arrow string buffers with numpy: no Python object per word.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D. In UTF-8 those bytes never occur inside a longer
character, so byte runs and character runs are the same words. A word's hash is a polynomial modulo 2**64 with an odd
base, taken from prefix sums over a slice of documents, then mixed with the word's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1_000_000
_BASE, _STEP = 0x9E6F3A5C7D1B2E4B, 0xD6E8FEB86659FD93
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLAIN = (np.arange(256, dtype=U) + U(1)) * U(0x2545F4914F6CDD1D)
_LOWER = _PLAIN.copy()
_LOWER[65:91] = _PLAIN[97:123]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n."""
    got = _powers.get(base)
    if got is None or len(got[0]) <= n:
        size = max(n + 1, 1 << 16)
        got = tuple(np.concatenate([[U(1)], np.cumprod(np.full(size, b, U))]) for b in (U(base), U(pow(base, -1, 1 << 64))))
        if n <= 4 * SLICE_BYTES:
            _powers[base] = got
    return got


@dataclass
class Words:
    """Words of a slice of documents: byte ranges in ``data``, hashes, and ``first[d]:first[d + 1]`` for document d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one document; n - k + 1 long, or empty."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, U), np.zeros(0, bool)
        up, down = powers(_STEP, n)
        total = np.concatenate([[U(0)], np.cumsum(self.hash * up[:n])])
        doc = self.doc
        return mix((total[k:] - total[:-k]) * down[: n - k + 1] + U(k)), doc[k - 1 :] == doc[: n - k + 1]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of whole texts; nulls are empty, a longer text is a run of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        stop = min(stop, len(texts))
        yield row, stop, data[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts at data[offsets[d]:offsets[d + 1]]; ``lower`` hashes A-Z as a-z.

    A longer run is hashed in chunks of about ``SLICE_BYTES`` that end at a space, so that memory grows with its words only.
    """
    n = len(data)
    inside = ~SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins[1:] &= ~inside[:-1] | cut[1:n]
    ends[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    value, byte, k = np.zeros(len(start), U), _LOWER if lower else _PLAIN, 0
    while k < len(start):
        stop = max(k + 1, int(np.searchsorted(end, start[k] + SLICE_BYTES, "right")))
        at, a, b = start[k], start[k:stop] - start[k], end[k:stop] - start[k]
        up, down = powers(_BASE, b[-1])
        total = np.concatenate([[U(0)], np.cumsum(byte[data[at : end[stop - 1]]] * up[: b[-1]])])
        value[k:stop] = mix((total[b] - total[a]) * down[a] + (b - a).astype(U))
        k = stop
    return Words(data, start, end, np.searchsorted(start, offsets), value)


def run_sums(table: np.ndarray, index: np.ndarray, begin: np.ndarray, end: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Sums of table[index[begin[d]:end[d]]] for ascending runs d, ``step`` rows of the table at a time."""
    out = np.zeros((len(begin), table.shape[1]))
    for a in range(0, len(index), step):
        one, two = np.searchsorted(end, a, "right"), np.searchsorted(begin, a + step)
        if one >= two:
            continue
        part = table[index[a : a + step]]
        total = np.concatenate([np.zeros((1, part.shape[1])), np.cumsum(part, axis=0, dtype=np.float64)])
        out[one:two] += total[np.clip(end[one:two] - a, 0, len(part))] - total[np.clip(begin[one:two] - a, 0, len(part))]
    return out
