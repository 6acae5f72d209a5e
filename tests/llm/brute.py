"""Plain Python versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
EXPRESSIONS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    """Counts by kind and the rendered spans."""
    counts, out = [], []
    for kind, expression in EXPRESSIONS.items():
        n = 0
        for m in re.finditer(expression, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                n += 1
                out.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(n)
    return (*counts, hashlib.sha256(",".join(out).encode()).hexdigest(), ",".join(out))


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def contaminated(texts, items, window=10):
    """n_words, n_hit, n_items and the digest for each text."""
    index = {}
    for item, text in items:
        w = bench_words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            index.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in index}
    for text in texts:
        w = bench_words(text)
        hit, found = set(), set()
        for s in sizes:
            for i in range(len(w) - s + 1):
                if got := index.get(tuple(w[i : i + s])):
                    hit.update(range(i, i + s))
                    found |= got
        yield len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def shingles(text, size=4):
    w = SPACED.findall((text or "").translate(FOLD))
    if not w:
        return frozenset()
    size = min(size, len(w))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def linked(a, b, percent):
    both = len(a & b)
    return bool(both) and 100 * both >= percent * (len(a) + len(b) - both)


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def components(rows, percent=85, size=4):
    """id -> (set size, component) by comparing all pairs that share a shingle."""
    sets, by, union = {i: shingles(t, size) for i, t in rows}, {}, Sets()
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, set()).add(i)
    done = set()
    for group in by.values():
        for a, b in combinations(sorted(group), 2):
            if (a, b) not in done:
                done.add((a, b))
                if linked(sets[a], sets[b], percent):
                    union.join(a, b)
    return {i: (len(s), union.find(i)) for i, s in sets.items()}


def quality(text):
    words = SPACED.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if SPACED.search(x):
            dup += x in seen
            seen.add(x)
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeat = {p for v in where.values() if len(v) > 1 for i in v for p in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeat)
