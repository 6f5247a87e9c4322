"""Plain versions of the operators for small tables."""

import re
from collections import defaultdict


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text):
    w = words_of(text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near_components(rows, percent):
    """{doc_id: (set size, smallest reachable doc_id)} of rows (doc_id, text)."""
    sets = {k: shingles(t) for k, t in rows}
    parent = {k: k for k in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    holders = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            holders[g].append(k)
    common = defaultdict(int)
    for ks in holders.values():
        for i, a in enumerate(ks):
            for b in ks[:i]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {k: (len(s), root(k)) for k, s in sets.items()}
