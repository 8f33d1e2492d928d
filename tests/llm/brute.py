"""The operators once more, slowly: plain Python over lists."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from verdigris.llm import quality as Q

MARK = chr(Q.MARK)


class KneserNey:
    """Modified Kneser-Ney of one language, from counts of n-grams; of each order the most frequent are stored, `room` at most."""

    def __init__(self, counts: dict[str, int], order: int, room: float):
        self.c, self.n = {order: dict(counts)}, {order: dict(counts)}
        for k in range(order - 1, 0, -1):
            self.c[k], self.n[k] = Counter(), Counter()
            for g, n in self.n[k + 1].items():
                self.c[k][g[1:]] += 1
                self.n[k][g[1:]] += n
        self.letters, least = sorted(self.c[1]), 1
        self.d, self.own, self.total, self.gamma = {}, {}, {}, {}
        for k in range(1, order + 1):
            while sum(n >= least for n in self.n[k].values()) > room:
                least *= 2
            n = Counter(self.c[k].values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
            d = [0.0] + [max(min(i - (i + 1) * y * n[i + 1] / n[i], i) if n[i] else float(i), Q.LEAST_DISCOUNT) for i in (1, 2, 3)]
            total, kept = defaultdict(float), defaultdict(float)
            for g, c in self.c[k].items():
                total[g[:-1]] += c
                if self.n[k][g] >= least:
                    self.own[g] = c - d[min(c, 3)]
                    kept[g[:-1]] += self.own[g]
            for x, t in total.items():
                self.total[x], self.gamma[x] = t, 1 - kept[x] / t

    def p(self, g: str) -> float:
        """Of the last character after the others."""
        if not g:
            return 1 / (len(self.letters) + 1)
        x, lower = g[:-1], self.p(g[1:])
        if x and x not in self.own or x not in self.total:
            return lower
        return self.own.get(g, 0.0) / self.total[x] + self.gamma[x] * lower


def models(rows: list[tuple], order: int = Q.ORDER, model_grams: int = Q.MODEL_GRAMS) -> dict:
    """(text, lang) -> a model of each language."""
    counts: dict = defaultdict(Counter)
    for text, lang in rows:
        if text:
            counts[lang].update([MARK * order, *grams(text, order)])
    sizes = {lang: sum(c.values()) for lang, c in counts.items()}
    roots = sum(math.sqrt(n) for n in sizes.values())
    return {lang: KneserNey(c, order, model_grams / order * math.sqrt(sizes[lang]) / roots) for lang, c in counts.items()}


def grams(text: str, order: int) -> list[str]:
    padded = MARK * (order - 1) + text
    return [padded[i : i + order] for i in range(len(text))]


def median(values: list) -> float:
    return sorted(values)[(len(values) - 1) // 2]


def bands(scores: list[tuple], of: str) -> dict:
    """(lang, cell, x, text) -> {(lang, cell): (lo, hi)}"""
    cells, langs = defaultdict(set), defaultdict(set)
    for lang, cell, x, text in scores:
        if x >= 0:
            cells[lang, cell].add((x, text))
            langs[lang].add((x, text))

    def figures(some: set) -> tuple:
        xs = [x for x, _ in some]
        middle = median(xs)
        return middle, 1.4826 * median([abs(x - middle) for x in xs]), len(xs) / (len(xs) + Q.PRIOR_TEXTS)

    out = {}
    for (lang, cell), some in cells.items():
        (middle, spread, share), (of_all, spread_all, share_all) = figures(some), figures(langs[lang])
        wide = 2 * share_all * spread_all + (1 - share_all) * Q.PRIOR_SCALE[of] * Q.MEAN_UNIT
        centre = share * middle + (1 - share) * of_all
        scale = max(share * spread + (1 - share) * wide, Q.LEAST_SCALE[of] * Q.MEAN_UNIT)
        out[lang, cell] = (round(centre - Q.WIDTH * scale), round(centre + Q.WIDTH * scale))
    return out


def quality(rows: list[tuple], model_grams: int = Q.MODEL_GRAMS) -> list[tuple]:
    """(text, lang) -> (x, lo, hi, w, lo, hi, kept) of each."""
    known, scores = models(rows, Q.ORDER, model_grams), {"x": [], "w": []}
    for text, lang in rows:
        n = len(text or "")
        total = -sum(math.log(known[lang].p(g)) for g in grams(text or "", Q.ORDER))
        words = len(re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or ""))
        for of, value in (("x", total / max(n, 1)), ("w", math.log(max(total / max(words, 1), 1.0)))):
            scores[of].append((lang, n.bit_length() - 1, round(value * Q.MEAN_UNIT) if n else -1, text))
    limits = {of: bands(some, of) for of, some in scores.items()}
    out = []
    for x, w in zip(scores["x"], scores["w"]):
        if x[2] < 0:
            out.append((None,) * 6 + (False,))
        else:
            a, b = limits["x"][x[:2]], limits["w"][w[:2]]
            out.append((x[2], *a, w[2], *b, a[0] <= x[2] <= a[1] and b[0] <= w[2] <= b[1]))
    return out


def exact(rows: list[dict]) -> list[dict]:
    """One row of each text: of the smallest id, nulls last."""
    best: dict = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
        best.setdefault(r["text"], r)
    return list(best.values())


def components(n: int, pairs) -> list[int]:
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return [find(i) for i in range(n)]


def mixture(rows: list[dict], weights: dict | None, alpha: float, block: int, seed: int, epochs: int) -> list[tuple]:
    """(slot, source, doc_id) in the mixture's order of slots."""
    import hashlib

    one, step = 1 << 32, 2_654_435_769
    by: dict = defaultdict(list)
    for r in rows:
        by[("n" if r["source"] is None else "s" + r["source"], r["source"])].append(r)
    placed, sizes = {}, {}
    for key, some in by.items():
        at = 0
        placed[key] = []
        for r in sorted(some, key=lambda r: (hashlib.md5(f"{seed}:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest(), r["doc_id"] or 0)):
            placed[key].append((at, r["doc_id"]))
            at += len(re.findall(r"[^ \t\n\r]+", r["text"] or ""))
        sizes[key] = at
    keys = sorted(k for k in by if weights is None or weights.get(k[1], 0) > 0)
    if not keys:
        return []
    w = [max(sizes[k], 1) ** alpha if weights is None else weights[k[1]] for k in keys]
    cum, lo, shares = 0.0, 0, {}
    for i, (k, x) in enumerate(zip(keys, w), 1):
        cum += x
        hi = i + (one - len(keys) if k == keys[-1] else math.floor(cum / sum(w) * (one - len(keys))))
        shares[k] = (lo, hi, max(1, -(-sizes[k] // block)))
        lo = hi
    given, slots, slot = Counter(), [], 0
    whole = sum(s[2] for s in shares.values())
    while any(given[k] < shares[k][2] for k in keys) and slot < epochs * whole:
        u = slot * step % one
        k = next(k for k in keys if shares[k][0] <= u < shares[k][1])
        slots.append((slot, k, given[k]))
        given[k] += 1
        slot += 1
    for k in keys:
        while given[k] < shares[k][2]:
            slots.append((slot, k, given[k]))
            given[k] += 1
            slot += 1
    out = []
    for slot, k, j in slots:
        for epoch in range(epochs if sizes[k] else 1):
            for at, doc in placed[k]:
                if (epoch * sizes[k] + min(at, max(sizes[k] - 1, 0))) // block == j:
                    out.append((slot, k[1], doc))
    return out
