"""Brute-force shingle sets and their linked groups."""

import re
from collections import defaultdict


def brute_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(sets, percent=75):
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    where = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            where[x].add(d)
    for d, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for e in where[x]:
                common[e] += 1
        for e, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[e]) - c):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: root(d) for d in sets}
