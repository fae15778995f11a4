"""Plain versions of operators: loops over Python objects, no hashing of windows, no Spark."""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import regex

from veilstat.llm.decontaminate import UNITS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def jaccard_groups(docs: list[tuple[int, str | None]]) -> dict[int, int]:
    """The smallest doc_id of each one's group, from all pairs that share a shingle."""
    sets, holders = {}, defaultdict(list)
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        for g in sets[i]:
            holders[g].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    shared = defaultdict(int)
    for own in holders.values():
        for x, a in enumerate(own):
            for b in own[:x]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def _form(text: str | None):
    """Words in lower case, their slots, the places' forms and slots, and where the places begin."""
    raw = regex.findall(r"\p{N}[\p{N}.,]*|[\p{L}\p{M}]+|[$€£%]", text or "")
    own = [w.lower() for w in raw]
    number = [bool(regex.match(r"\p{N}", w)) for w in raw]
    slot = []
    for i, w in enumerate(raw):
        unit = own[i] in UNITS and i > 0 and number[i - 1]
        named = w[0] != w[0].lower()
        slot.append(2 if named else 1 if number[i] else 3 if unit else 0)
    starts = [i for i in range(len(raw)) if slot[i] == 0 or i == 0 or slot[i - 1] != slot[i]]
    return own, slot, [slot[i] or own[i] for i in starts], [slot[i] for i in starts], [*starts, len(raw)]


def leaks(docs, items, width=8, cover=0.6, literal=4, near=4) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(doc_id, item_id): windows met, those word for word, and of how many."""
    index = []
    for item, text in dict(items).items():
        own, slot, form, place_slot, starts = _form(text)
        n, m = min(len(own), width), min(len(form), width)
        if not n:
            continue
        kinds = {
            True: [(i, tuple(own[i : i + n]), slot[i : i + n], None) for i in range(len(own) - n + 1)],
            False: [(i, tuple(form[i : i + m]), place_slot[i : i + m], [own[starts[j] : starts[j + 1]] for j in range(i, i + m)]) for i in range(len(form) - m + 1)],
        }
        for kind, made in kinds.items():
            rich = [x for x in made if sum(s == 0 for s in x[2]) >= min(literal, len(x[1]))]
            kept = rich or (made if kind else [])
            for nth, x in enumerate(kept):
                index.append((item, kind, *x, nth, len(kept)))
    by_key = defaultdict(list)
    for row in index:
        by_key[row[1], row[3]].append(row)
    sizes = {(k[0], len(k[1])) for k in by_key}
    out = {}
    for doc, text in docs:
        own, slot, form, place_slot, starts = _form(text)
        at = defaultdict(lambda: (set(), set(), set(), []))
        for kind, n in sizes:
            seq = own if kind else form
            for i in range(len(seq) - n + 1):
                for item, _, j, _, slots, fill, nth, of in by_key.get((kind, tuple(seq[i : i + n])), ()):
                    met, same, pairs, total = at[item, kind, i - j]
                    met.add((j, nth))
                    total.append(of)
                    mine = None if kind else [own[starts[x] : starts[x + 1]] for x in range(i, i + n)]
                    if kind or mine == fill:
                        same.add((j, nth))
                    for x, s in enumerate(slots):
                        if s and not kind:
                            a, b = fill[x], mine[x]
                            pairs |= {(s, (p,), (q,)) for p, q in zip(a, b)} if len(a) == len(b) else {(s, tuple(a), tuple(b))}

        def fits(pairs):
            return len({(s, a) for s, a, _ in pairs}) == len(pairs) == len({(s, b) for s, _, b in pairs})

        groups = defaultdict(list)
        for (item, kind, shift), x in sorted(at.items()):
            if fits(x[2]):
                chain = groups[item, kind]
                if not chain or shift - chain[-1][-1][0] > near:
                    chain.append([])
                chain[-1].append((shift, x))
        for (item, _), chains in groups.items():
            for chain in chains:
                tries = [(x[0], x[1]) for _, x in chain]
                if fits(set().union(*(x[2] for _, x in chain))):
                    tries.append((set().union(*(x[0] for _, x in chain)), set().union(*(x[1] for _, x in chain))))
                of = chain[0][1][3][0]
                for met, same in tries:
                    row = sorted(met)
                    broken = sum(b[1] - a[1] - 1 for a, b in zip(row, row[1:]) if b[0] - a[0] < width + near + 1)
                    if len(met) + broken >= of * cover:
                        got = (len(same), len(met), of)
                        out[doc, item] = max(out.get((doc, item), got), got)
    return {k: (met, same, of) for k, (same, met, of) in out.items()}


M = (1 << 64) - 1


def _mix(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def _word_hash(w: bytes) -> int:
    low = bytes(b + 32 if 65 <= b < 91 else b for b in w)
    return _mix((sum((b + 1) * 0x2545F4914F6CDD1D * pow(0x9E6F3A5C7D1B2E4B, i, 1 << 64) for i, b in enumerate(low)) + len(w)) & M)


def quality_score(model, text: str | None) -> float:
    """The score of one text, word by word."""
    found = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    lowered = [bytes(b + 32 if 65 <= b < 91 else b for b in w) for w in found]
    seen, words, shapes = set(), [], []
    for i, w in enumerate(found):
        caps = sum(65 <= b < 91 for b in w)
        mark = lambda b: 0 if 97 <= b | 32 < 123 or b >= 128 else b
        pair = (lowered[i], lowered[i + 1]) if i + 1 < len(found) else None
        again, case = int(pair in seen), 0 if caps == 0 else 2 if 2 * caps > len(w) else 1
        seen.add(pair)
        shape = mark(w[-1]) << 16 | mark(w[max(len(w) - 2, 0)]) << 8 | (case * 2 + again) << 4 | min(len(w), 15)
        words.append(model.words[_word_hash(w) >> 50])
        shapes.append(model.shapes[_mix(shape) >> 53])
    zero = [np.zeros(model.words.shape[1])]
    x = np.concatenate([np.mean(words or zero, axis=0, dtype=np.float64), np.mean(shapes or zero, axis=0, dtype=np.float64)])
    a, b, c, d = model.net
    z = float(np.maximum((x - model.mean) / model.scale @ a + b, 0) @ c[:, 0] + d[0])
    return 1 / (1 + math.exp(-z / model.heat))


def language(model, text: str | None) -> tuple[str, float]:
    """Language and score of one text, subword by subword."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    data = bytes(b + 32 if 65 <= b < 91 else b for b in text.encode())
    rows = []
    for k in (3, 4):
        for i in range(len(data) - k + 1):
            h = k * 0x9E3779B1 & 0xFFFFFFFF
            for b in data[i : i + k]:
                h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
            rows.append(model.table[((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 19])
    z = (np.mean(rows, axis=0, dtype=np.float64) if rows else 0) + model.bias
    e = np.exp((z - z.max()) / model.heat)
    return model.langs[int(e.argmax())], float(e.max() / e.sum())


def held(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n
