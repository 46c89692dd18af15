"""The operators' definitions in plain Python, for small inputs."""

import re
from itertools import combinations


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def components(rows, k, percent):
    """{doc_id: smallest doc_id reachable} of (doc_id, text)."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            p, q = sorted((top(a), top(b)))
            root[q] = p
    return {i: top(i) for i in root}


def without_repeated_lines(rows):
    """{doc_id: (lines, removed, text)} of (doc_id, text), in order of ids."""
    seen, out = [], {}
    for i, text in sorted(rows):
        kept, gone = [], 0
        for line in (text or "").split("\n"):
            s = set(re.findall(r"[^\x20\x09-\x0D]+", lower(line)))
            if s and any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                gone += 1
            else:
                kept.append(line)
            if s:
                seen.append(s)
        out[i] = len(kept) + gone, gone, text if text is None else "\n".join(kept)
    return out


def tiles(doc, item, k):
    """(tiles, words covered) by greedy string tiling as published: mark the longest, look again."""
    d_free, i_free, count = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (k - 1, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and d_free[a + n] and i_free[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < k:
            return count, i_free.count(False)
        count += 1
        d_free[a : a + n], i_free[b : b + n] = [False] * n, [False] * n
