"""Plain versions of the corpus operators, over lists of rows; slow and obvious."""

import re
from collections import defaultdict

def _class(ranges):
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges)


SEPARATORS = [(0xA0, 0xA9), (0xAB, 0xB1), (0xB4, 0xB4), (0xB6, 0xB8), (0xBB, 0xBB), (0xBF, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x206F), (0x2E00, 0x2E7F), (0x3000, 0x3004), (0x3008, 0x303F)]
SEPARATORS += [(0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)]
SOLO = [(0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)]
WORD = re.compile(f"[{_class(SOLO)}]|(?:(?![{_class(SOLO + SEPARATORS)}])[a-z0-9\u0080-\U0010ffff])+")


def words(text):
    """(word, start, stop) in characters."""
    folded = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [(m.group(), m.start(), m.end()) for m in WORD.finditer(folded)]


def cut_repeats(rows, k=50):
    """rows (doc_id, text) -> {doc_id: text left}, without those of which nothing is left."""
    first = {}
    for doc, text in sorted(rows):
        w = [x[0] for x in words(text)]
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), doc)
    out = {}
    for doc, text in rows:
        w = words(text)
        covered = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(x[0] for x in w[i : i + k])] < doc:
                covered[i : i + k] = [True] * k
        spans, i = [], 0
        while i < len(w):
            j = i
            while j < len(w) and covered[j]:
                j += 1
            if j > i:
                spans.append((w[i][1], w[j - 1][2]))
            i = max(j, i + 1)
        left = text
        for start, stop in reversed(spans):
            left = left[:start] + left[stop:]
        if not spans or any(c.isalnum() for c in left):
            out[doc] = left
    return out


def shingles(text, k=3):
    w = [x[0] for x in words(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_links(rows, t=0.7):
    """(smaller, larger, share) of linked different sets, by their number in sets, and the sets: {set: its rows' ids}."""
    sets = defaultdict(list)
    for doc, text in rows:
        sets[frozenset(shingles(text))].append(doc)
    order = [x for x in sets if x]
    links = []
    for i, x in enumerate(order):
        for j in range(i):
            small, large = sorted((i, j), key=lambda k: len(order[k]))
            share = len(x & order[j]) / len(order[small])
            if share >= t - 1e-9:
                links.append((small, large, share))
    return links, order, sets


def near_classes(rows, ratio=1.25):
    """{doc_id: (class_id, links)}: components of links within the ratio; smaller sets of other links go to their best container's group. All links are counted."""
    links, order, sets = near_links(rows)
    first = [min(sets[x]) for x in order]
    count = [0] * len(order)
    holder = {}
    for small, large, share in links:
        count[small] += 1
        count[large] += 1
        if len(order[large]) > ratio * len(order[small]) + 1e-9:
            holder.setdefault(small, []).append((-share, -len(order[large]), first[large], large))
    holder = {k: min(v)[3] for k, v in holder.items()}
    parent = list(range(len(order)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for small, large, _ in links:
        if small not in holder and large not in holder and len(order[large]) <= ratio * len(order[small]) + 1e-9:
            parent[root(small)] = root(large)
    best = {}
    for k in range(len(order)):
        if k not in holder:
            best[root(k)] = min(best.get(root(k), first[k]), first[k])
    out = {doc: (doc, 0) for doc in sets.get(frozenset(), [])}
    for k, x in enumerate(order):
        top = k
        while top in holder:
            top = holder[top]
        for doc in sets[x]:
            out[doc] = (best[root(top)], count[k])
    return out


def near_kept(rows):
    return {doc for doc, (best, _) in near_classes(rows).items() if doc == best}


def exact_kept(rows):
    first = {}
    for doc, text in sorted(rows):
        first.setdefault(text, doc)
    return set(first.values())
