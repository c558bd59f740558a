"""Plain versions that the operators' results are held against."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def shingles(text, size=5):
    w = WORD.findall(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def near_duplicates(rows, percent=75):
    """rows: (doc_id, text) -> {doc_id: (n_shingles, component_id)}; exact, by a prefix filter and union-find."""
    sets = {d: shingles(t) for d, t in rows}
    often = defaultdict(int)
    for s in sets.values():
        for g in s:
            often[g] += 1
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index, links = defaultdict(list), set()
    for d in sorted(sets, key=lambda d: len(sets[d])):
        s = sets[d]
        rare = sorted(s, key=lambda g: (often[g], g))
        for g in rare[: len(s) - -(-len(s) * percent // 100) + 1]:
            for o in index[g]:
                if (o, d) not in links and 100 * len(s & sets[o]) >= percent * len(s | sets[o]):
                    links.add((o, d))
                    parent[max(root(o), root(d))] = min(root(o), root(d))
            index[g].append(d)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def template_drops(rows, min_docs=5, lead=4, least=10):
    """rows: (doc_id, text) -> {(doc_id, line)} to drop, by whole templates and by leaves with one third left open."""
    whole, open_, leaves, lines = defaultdict(set), defaultdict(set), defaultdict(set), []
    for d, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            w = tuple("<*>" if re.search("[0-9]", x) else x for x in WORD.findall(line))
            if not w or d is None:
                continue
            n, thirds = len(w), []
            if n >= least:
                cuts = [lead + (n - lead) * k // 3 for k in range(4)]
                thirds = [(n, k, w[: cuts[k]], w[cuts[k + 1] :]) for k in range(3)]
            lines.append((d, i, w, thirds))
            whole[w].add(d)
            for t in thirds:
                open_[t].add((d, w))
    drops = set()
    for d, i, w, thirds in lines:
        if len(whole[w]) >= min_docs and d != min(whole[w]):
            drops.add((d, i))
        for t in thirds:
            ds = {x for x, _ in open_[t]}
            if len(ds) >= min_docs and len({x for _, x in open_[t]}) > 1 and d != min(ds):
                drops.add((d, i))
    return drops


def benchmark_overlaps(docs, items, span=10, masks=((0, 1, 3, 6, 7, 9), (0, 2, 3, 4, 8, 9)), around=3):
    """{(doc_id, item_id): (matched, compared)} by the same rule, every window against every window."""
    import regex

    word = regex.compile(r"[\p{L}\p{N}]+")
    index = defaultdict(list)
    for item, text in items:
        b = word.findall((text or "").lower())
        for at in range(len(b) - span + 1):
            for m, mask in enumerate(masks):
                index[(m, *(b[at + o] for o in mask))].append((item, at, b))
    best = {}
    for doc, text in docs:
        t = word.findall((text or "").lower())
        for pos in range(len(t) - span + 1):
            for m, mask in enumerate(masks):
                for item, at, b in index.get((m, *(t[pos + o] for o in mask)), ()):
                    span_js = [j for j in range(max(0, at - around), min(len(b), at + span + around)) if 0 <= pos - at + j < len(t)]
                    n, k = sum(t[pos - at + j] == b[j] for j in span_js), len(span_js)
                    if k >= 10 and 4 * n >= 3 * k:
                        best[doc, item] = max(best.get((doc, item), (0, 0, 0)), (n / k, n, k))
    return {k: v[1:] for k, v in best.items()}


def context_tree(texts, depth, least, end=255):
    """A plain context tree over the bits of bytes, weighted by recursion: text -> log10 probability of its bytes and end."""
    import math
    from functools import cache

    def positions(text):
        data = bytes([end]) * depth + text + bytes([end])
        for i in range(depth, len(data)):
            yield tuple(data[i - 1 - k] for k in range(depth)), data[i]

    def bits(byte):
        return [(1 << k | byte >> 8 - k, byte >> 7 - k & 1) for k in range(8)]

    seen = [(c, b) for t in texts for c, b in positions(lower(t).encode())]
    often = defaultdict(int)
    for c, _ in seen:
        for d in range(depth + 1):
            often[c[:d]] += 1
    nodes, below = defaultdict(lambda: [0, 0]), defaultdict(set)
    for c, b in seen:
        for d in range(depth + 1):
            if d and often[c[:d]] < least:
                break
            for head, bit in bits(b):
                nodes[c[:d], head][bit] += 1
                if d:
                    below[c[: d - 1], head].add(c[:d])

    def estimate(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(sum(n) + 1)

    def ahead(n):
        return (n[1] + 0.5) / (sum(n) + 1)

    @cache
    def weighted(c, head):
        """Log weighted probability, the share of the own estimate, and the counts of the rest."""
        n = nodes[c, head]
        if len(c) == depth:
            return estimate(n), 1.0, n
        rest = [n[x] - sum(nodes[k, head][x] for k in below[c, head]) for x in (0, 1)]
        own, more = estimate(n), sum(weighted(k, head)[0] for k in below[c, head]) + estimate(rest)
        top = max(own, more)
        both = top + math.log(math.exp(own - top) + math.exp(more - top))
        return both - math.log(2), math.exp(own - both), rest

    def one(c, head):
        if ((), head) not in nodes:
            return 0.5
        sofar, left, d = 0.0, 1.0, 0
        while True:
            _, stop, rest = weighted(c[:d], head)
            if d == depth:
                return sofar + left * ahead(nodes[c[:d], head])
            sofar, left = sofar + left * stop * ahead(nodes[c[:d], head]), left * (1 - stop)
            if c[: d + 1] not in below[c[:d], head]:
                return sofar + left * ahead(rest)
            d += 1

    def score(text):
        return sum(math.log10(p if bit else 1 - p) for c, b in positions(lower(text or "").encode()) for head, bit in bits(b) for p in [one(c, head)])

    return score
