"""Similarities by plain sets, without any of the library's hashing."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k=5):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else frozenset()


def similar_pairs(texts, least):
    """(i, j, similarity) of all pairs of texts by id; equal texts are paired with the first of them only."""
    first, out = {}, []
    for i in sorted(texts):
        j = first.setdefault(texts[i] or "", i)
        if j != i:
            out.append((j, i, 1.0))
    sets = {i: shingle_set(t) for t, i in first.items()}
    often = Counter(s for x in sets.values() for s in x)
    index = defaultdict(list)
    for i in sorted(sets, key=lambda i: len(sets[i])):
        mine = sorted(sets[i], key=lambda s: (often[s], s))
        mine = mine[: len(mine) - int(least * len(mine))]  # any partner shares one of these
        for j in {j for s in mine for j in index[s]}:
            common = len(sets[i] & sets[j])
            share = common / (len(sets[i]) + len(sets[j]) - common)
            if share >= least:
                out.append((min(i, j), max(i, j), share))
        for s in mine:
            index[s].append(i)
    return out


def groups(ids, pairs):
    """By id, the smallest id reachable."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
