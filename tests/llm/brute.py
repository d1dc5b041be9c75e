"""What the operators should return, by the plainest possible Python over small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

BLANKS = " \t\n\x0b\x0c\r"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def words(text: str | None, lower: bool = False) -> list[bytes]:
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def shingles(text: str | None, width: int) -> frozenset:
    w = words(text, lower=True)
    if len(w) >= width:
        return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def similarity_classes(docs, width: int, percent: int) -> dict:
    sets = {i: shingles(t, width) for i, t in docs}
    union = Union(sets)
    ids = sorted(sets)
    for at, a in enumerate(ids):
        for b in ids[:at]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                union.join(a, b)
    return {i: (len(sets[i]), union.find(i)) for i in ids}


def repeated_lines(docs, shortest: int = 10) -> dict:
    def key(line):
        return line.encode().strip(BLANKS.encode()).lower().decode()

    first = {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        for line in (text or "").split("\n"):
            first.setdefault(key(line), i)
    out = {}
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < shortest or first[key(x)] >= i]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def repeated_windows(docs, size: int) -> dict:
    first = {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        w = words(text)
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    out = {}
    for i, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (b" ".join(kept).decode(), len(w), sum(gone))
    return out


def repeated_strings(docs, size: int) -> dict:
    first = {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        for k in range(len(data) - size + 1):
            first.setdefault(data[k : k + size], (i, k))
    out = {}
    for i, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - size + 1):
            if first[data[k : k + size]] < (i, k):
                gone[k : k + size] = b"\1" * size
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        out[i] = (kept, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))))
    return out


def contained_items(docs, items, width: int = 5, percent: int = 80) -> dict:
    wanted = [(i, shingles(t, width)) for i, t in items]
    out = {}
    for d, text in docs:
        has = shingles(text, width)
        for i, want in wanted:
            if want and 100 * len(has & want) >= percent * len(want):
                out[d, i] = (len(has & want), len(want))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(digits[::-1]):
        value = int(digit) * (1 + at % 2)
        total += value // 10 + value % 10
    return total % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PATTERNS.items():
        for found in re.finditer(pattern, text):
            span = found.group()
            digits = re.sub(r"[^0-9]", "", span)
            if (
                kind == "email"
                or (kind == "ip" and all(int(x) <= 255 for x in span.split(".")))
                or (kind == "card" and 16 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 8 <= len(digits) <= 15)
            ):
                out.append((kind, *found.span()))
    return out


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(weight[n] for n in free)
        over = [n for n in free if left * weight[n] / total > most * sizes[n]]
        if not over:
            return out | {n: left * weight[n] / total for n in free}
        for n in over:
            out[n] = most * sizes[n]
            left -= out[n]
            free.discard(n)
    return out


def vector_links(rows, least: float) -> dict:
    import numpy as np

    groups = defaultdict(list)
    for i, vector, label in rows:
        bad = vector is None or label is None or any(v is None for v in vector)
        if not bad and np.isfinite(vector).all() and np.any(vector):
            groups[label, len(vector)].append((i, np.array(vector, float)))
    union, links = Union(i for i, _, _ in rows), defaultdict(int)
    for members in groups.values():
        for at, (i, x) in enumerate(members):
            for j, y in members[:at]:
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    links[i] += 1
                    links[j] += 1
                    union.join(i, j)
    return {i: (links[i], union.find(i)) for i, _, _ in rows}
