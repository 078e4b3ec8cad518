"""Plain versions of the operators, by brute force over whole texts, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import cached_property

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text: str | None) -> list[str]:
    return SPACED.findall(lower(text))


def shingles(text: str | None) -> frozenset[tuple[str, ...]]:
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def similar_pairs(texts: dict[int, str | None]) -> set[tuple[int, int]]:
    """Pairs of ids whose shingles are shared to 75 % or more, by all pairs with a shingle in common."""
    sets = {i: shingles(t) for i, t in texts.items()}
    having = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            having[s].append(i)
    shared: Counter = Counter()
    for ids in having.values():
        shared.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    return {(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)}


def components(ids: list[int], pairs: set[tuple[int, int]]) -> dict[int, int]:
    of = {i: i for i in ids}

    def root(i: int) -> int:
        while of[i] != i:
            i = of[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        of[b] = a
    return {i: root(i) for i in ids}


def windows(text: str | None, n: int = 10) -> set[tuple[str, ...]]:
    w = LETTERED.findall(lower(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def contamination(text: str | None, items: list[tuple[str | None, str | None]]) -> tuple[int, set[int], set[str]]:
    """Number of words, places of those hit, and items, by trying every window of every item at every place."""
    w = LETTERED.findall(lower(text))
    hit: set[int] = set()
    found: set[str] = set()
    for item, of in items:
        for pattern in windows(of):
            for i in range(len(w) - len(pattern) + 1):
                if tuple(w[i : i + len(pattern)]) == pattern:
                    hit.update(range(i, i + len(pattern)))
                    found.add("null" if item is None else item)
    return len(w), hit, found


def kept_lines(rows: list[tuple[int | None, str | None]], chars: int = 40, docs: int = 5) -> list[tuple[int, int, str]]:
    """Lines, dropped lines and text that stays, of each row."""
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= chars:
                holders[key(line)].add(doc)
    goes = lambda doc, line: doc is not None and len(holders.get(key(line), ())) >= docs and doc != max(holders[key(line)])
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stays = [x for x in lines if not goes(doc, x)]
        out.append((len(lines), len(lines) - len(stays), "\n".join(stays)))
    return out


def distance(a: str, b: str) -> int:
    """Edits from one word to another: a letter more, less or other, or two neighbours that change places."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


class KneserNey:
    """An interpolated modified Kneser-Ney bigram model in dictionaries."""

    split = staticmethod(words)

    def __init__(self, texts: list[str | None]) -> None:
        self.words: Counter = Counter()
        self.pairs: Counter = Counter()
        for t in texts:
            before = "<begin>"
            for w in [*self.split(t), "<end>"]:
                self.words[w] += 1
                self.pairs[before, w] += 1
                before = w
        self.total = sum(self.words.values())
        self.follows = Counter(b for _, b in self.pairs)
        self.d = self._discounts(Counter(self.pairs.values()))
        self.low_d = self._discounts(Counter(self.follows.values()))
        self.after = defaultdict(Counter)
        for (a, b), n in self.pairs.items():
            self.after[a][b] = n

    @staticmethod
    def _discounts(n: Counter) -> list[float]:
        if not n[1] or not n[2]:
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.0, 0.0), float(k)) for k in (1, 2, 3))]

    @cached_property
    def low_rest(self) -> float:
        return sum(self.low_d[min(n, 3)] for n in self.follows.values()) / max(1, len(self.pairs)) if self.pairs else 1.0

    @cached_property
    def contexts(self) -> dict[str, tuple[int, float]]:
        """Of each word: how often it comes before another, and what it leaves to the lower order."""
        return {a: (sum(after.values()), sum(self.d[min(k, 3)] for k in after.values()) / sum(after.values())) for a, after in self.after.items()}

    def low(self, w: str) -> float:
        rest, n = self.low_rest, self.follows[w]
        return max(n - self.low_d[min(n, 3)], 0) / max(1, len(self.pairs)) + rest / (len(self.words) + 1)

    def p(self, before: str, w: str) -> float:
        after = self.after.get(before)
        if not after:
            return self.low(w)
        n, (total, rest) = after[w], self.contexts[before]
        return max(n - self.d[min(n, 3)], 0) / total + rest * self.low(w)

    def base(self, w: str) -> float:
        return (self.words[w] + 0.1) / (self.total + 0.1 * (len(self.words) + 1))
