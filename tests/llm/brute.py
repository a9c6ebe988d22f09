"""Plain Python versions of the operators' contracts."""

import collections
import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def folded(text):
    return FOLDED.findall((text or "").translate(LOW))


def shingles(text, width=5):
    w = SPACED.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def components(docs, percent=85):
    """doc_id -> smallest id reached; all pairs that share a shingle are compared."""
    sets = {d: shingles(t) for d, t in docs}
    by_shingle = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by_shingle[x].append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        common = collections.Counter(o for x in s for o in by_shingle[x] if o < d)
        for o, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = find(d), find(o)
                root[max(a, b)] = min(a, b)
    return sets, {d: find(d) for d in sets}


def hits(text, items, width=10):
    """(hit word places, items) of one text."""
    w, places, found = folded(text), set(), set()
    for item, other in items:
        o = folded(other)
        for i in range(max(1, len(o) - width + 1) if o else 0):
            window = o[i:i + width]
            for k in range(len(w) - len(window) + 1):
                if w[k:k + len(window)] == window:
                    places.update(range(k, k + len(window)))
                    found.add(str(item))
    return places, sorted(found)
