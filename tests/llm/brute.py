"""Plain versions of what the operators compute."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)])


def components(rows, n, hundredths):
    """doc_id -> smallest reachable doc_id, for rows (doc_id, text) with unique ids."""
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    having = collections.defaultdict(list)
    for i, s in sets.items():
        near = collections.Counter(j for x in s for j in having[x])
        for j, shared in near.items():
            if 100 * shared >= hundredths * (len(s) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for x in s:
            having[x].append(i)
    least = {}
    for i in sets:
        least[find(i)] = min(least.get(find(i), i), i)
    return {i: least[find(i)] for i in sets}, {i: len(s) for i, s in sets.items()}
