"""Byte-level BPE over whole slices of documents, and its inverse.

Texts are cut into the pattern's pieces with numpy over code points, each piece is looked up by a 64-bit hash, and only
pieces not seen before are encoded. ``TrieEncoder`` encodes them together: the distinct pieces, sorted, are the paths of
a trie in depth-first order, and the walk keeps the last token of every prefix on its stack. The encoding of a prefix ends
in the one token t for which the rest's encoding ends in a token that BPE leaves next to t. So a shared prefix is
encoded once, and a piece's tokens are read back from its last ones. ``LibraryEncoder`` encodes them with the tokenizers library.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa

from .text import SPACE, U, mix, powers, slices

SLICE = 1_000_000
_BASE = 0xB5026F5AA96619E9
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@cache
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return table


def piece_starts(cp: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the pattern's pieces begin in code points; ``edges`` are the offsets of the texts, the end included.

    A run of letters, of numbers or of other characters takes a space before it. White space before a run keeps all but
    its last character together; at the end of a text it stays whole. An apostrophe alone takes s, t, m, d, re, ve or ll.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[cp]
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    begin = np.ones(n, bool)
    begin[1:] = (kind[1:] != kind[:-1]) | edge[1:n]
    runs = np.flatnonzero(begin)
    stops = np.append(runs[1:], n)
    out = begin
    space = (kind[runs] == _SPACE) & ~edge[stops]
    out[stops[space] - 1] = True
    taken = stops[space][cp[stops[space] - 1] == 0x20]
    out[taken] = False
    quote = np.flatnonzero((cp[runs] == 0x27) & (stops - runs == 1) & ~edge[stops])
    quote = quote[out[runs[quote]]]
    quote = quote[kind[stops[quote]] == _LETTER]
    if len(quote):
        at, last = stops[quote], stops[quote + 1]
        a = cp[at]
        b = np.where(last - at > 1, cp[np.minimum(at + 1, n - 1)], 0)
        take = np.where(np.isin(a, [ord(c) for c in "stmd"]), 1, 0)
        for x, y in ("re", "ve", "ll"):
            take = np.where((a == ord(x)) & (b == ord(y)), 2, take)
        hit = take > 0
        out[at[hit]] = False
        more = (at + take)[hit & (at + take < last)]
        out[more] = True
    return np.flatnonzero(out)


class Vocabulary:
    """Tokens as bytes, merge ranks and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            if token not in self.special:
                self.bytes[i] = bytes(byte[c] for c in token)
        self.ids = {b: i for i, b in enumerate(self.bytes) if b}
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(model["vocab"][a], model["vocab"][b]): (r, model["vocab"][a + b]) for r, (a, b) in enumerate(pairs)}

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE: the pair of lowest rank merges first, the leftmost of equals."""
        ids = [self.ids[data[i : i + 1]] for i in range(len(data))]
        none = (len(self.rank), 0)
        while len(ids) > 1:
            k = min(range(len(ids) - 1), key=lambda i: self.rank.get((ids[i], ids[i + 1]), none)[0])
            got = self.rank.get((ids[k], ids[k + 1]))
            if got is None:
                break
            ids[k : k + 2] = [got[1]]
        return ids


class TrieEncoder:
    """Encodes distinct pieces together; see the module's text. ``most`` bounds the memory of known pairs."""

    def __init__(self, vocabulary: Vocabulary, most: int = 500_000):
        self.v, self.most = vocabulary, most
        self.longest = max(map(len, vocabulary.ids))
        self.beside: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def _stays(self, left: int, right: int) -> bool:
        key = left << 20 | right
        got = self.beside.get(key)
        if got is None:
            if len(self.beside) >= self.most:
                self.beside.clear()
            got = self.beside[key] = self.v.merged(self.v.bytes[left] + self.v.bytes[right]) == [left, right]
        return got

    def _reached(self, token: int) -> bool:
        got = self.whole.get(token)
        if got is None:
            got = self.whole[token] = self.v.merged(self.v.bytes[token]) == [token]
        return got

    def _last(self, path: bytes, n: int, last: list[int]) -> int:
        ids = self.v.ids
        for k in range(max(0, n - self.longest), n):
            token = ids.get(path[k:n])
            if token is not None and (self._stays(last[k], token) if k else self._reached(token)):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def __call__(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        last, before = [-1], b""
        for i in sorted(range(len(pieces)), key=pieces.__getitem__):
            piece = pieces[i]
            same, top = 0, min(len(piece), len(before))
            while same < top and piece[same] == before[same]:
                same += 1
            del last[same + 1 :]
            for n in range(same + 1, len(piece) + 1):
                last.append(self._last(piece, n, last))
            tokens, n = [], len(piece)
            while n:
                tokens.append(last[n])
                n -= len(self.v.bytes[last[n]])
            out[i] = tokens[::-1]
            before = piece
        return out


class LibraryEncoder:
    """Encodes distinct pieces with the tokenizers library, one thread, as ordinary text."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        self.t.encode_special_tokens = True

    def __call__(self, pieces: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.t.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]


class Codec:
    """Ids of whole texts, and texts of ids. ``most`` bounds the number of pieces remembered between slices."""

    def __init__(self, vocabulary: Vocabulary, encode: Callable[[list[bytes]], Iterable[list[int]]], most: int = 1_000_000):
        self.v, self.encode_pieces, self.most = vocabulary, encode, most
        self.size = np.array([len(b) for b in vocabulary.bytes])
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.frombuffer(b"".join(vocabulary.bytes), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, U), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, tokens: list[list[int]]) -> None:
        count = np.fromiter(map(len, tokens), np.int32, len(tokens))
        first = (len(self.pool) + np.cumsum(count) - count).astype(np.int32)
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(tokens), np.uint32, int(count.sum()))])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.count = np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.count, at, count)

    def _edges(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """Byte offsets of texts and of special tokens in them, and the ids of special tokens by where they begin."""
        raw, cuts, at = data.tobytes(), [], {}
        for text, token in self.v.special.items():
            word, k = text.encode(), raw.find(text.encode())
            while k >= 0:
                end = k + len(word)
                if not np.any((offsets > k) & (offsets < end)):
                    cuts += [k, end]
                    at[k] = token
                else:
                    end = k + 1
                k = raw.find(word, end)
        return (np.unique(np.concatenate([offsets, cuts])).astype(np.int64), at) if cuts else (offsets, at)

    def _cuts(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """Parts of a long text that encode as they do in the whole: each begins with white space after a character that is none.

        No piece runs over such a place, and nothing before it decides what follows. A text without such places stays whole.
        """
        white, a = SPACE[data], 0
        if any(SPACE[list(word.encode())].any() for word in self.v.special):
            a = len(data)
            yield data
        while a < len(data):
            b = len(data)
            for t in range(a + SLICE, len(data), SLICE):
                own = np.flatnonzero(white[t - SLICE + 1 : t] & ~white[t - SLICE : t - 1]) + t - SLICE + 1
                good = next((p for p in own[::-1].tolist() if not data[max(a, p - 4) : p].tobytes().decode("utf-8", "ignore")[-1:].isspace()), None)
                if good is not None:
                    b = good
                    break
            yield data[a:b]
            a = b

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids, offsets of the ids of each text) by slices; a longer text goes in parts."""
        for row, stop, data, offsets in slices(texts, SLICE):
            if len(data) <= SLICE:
                yield row, stop, *self._ids(data, offsets)
            else:
                ids = np.concatenate([self._ids(part, np.array([0, len(part)]))[0] for part in self._cuts(data)])
                yield row, stop, ids, np.array([0, len(ids)])

    def _ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edges, special = self._edges(data, offsets)
        place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        start = piece_starts(cp, place[edges])
        for k in special:
            a = place[k]
            inside = np.searchsorted(start, [a + 1, place[edges[np.searchsorted(edges, k) + 1]]])
            start = np.delete(start, np.arange(*inside))
        n = len(cp)
        end = np.append(start[1:], n)
        up, down = powers(_BASE, n)
        total = np.concatenate([[U(0)], np.cumsum((cp.astype(U) + U(1)) * U(0x9FB21C651E98DF25) * up[:n])])
        key = mix((total[end] - total[start]) * down[start] + (end - start).astype(U))
        if special:
            key[np.searchsorted(start, [place[k] for k in special])] = np.array(list(special.values()), U)
        if len(self.keys) > self.most:
            self._forget()
        seen, one, where = np.unique(key, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.keys, seen)
        known = np.zeros(len(seen), bool)
        if len(self.keys):
            known = self.keys[np.minimum(slot, len(self.keys) - 1)] == seen
        new = np.flatnonzero(~known)
        if len(new):
            at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            raw, own = data.tobytes(), one[new]
            pieces = [raw[a:b] for a, b in zip(at[start[own]].tolist(), at[end[own]].tolist())]
            ids = list(special.values())
            plain = [i for i, k in enumerate(seen[new]) if int(k) not in ids] if special else range(len(new))
            found: list[list[int]] = [[int(k)] for k in seen[new]] if special else [[]] * len(new)
            for i, tokens in zip(plain, self.encode_pieces([pieces[i] for i in plain]), strict=True):
                found[i] = tokens
            self._learn(seen[new], found)
        slot = np.searchsorted(self.keys, seen)[where]
        count = self.count[slot]
        upto = np.concatenate([[0], np.cumsum(count)])
        take = np.repeat(self.first[slot] - upto[:-1], count) + np.arange(upto[-1])
        return self.pool[take], upto[np.searchsorted(start, place[offsets])]

    def bytes_of(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.repeat(self.at[:-1][ids] - upto[:-1], size) + np.arange(upto[-1])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return self.bytes_of(ids).decode("utf-8", "replace")
