"""Plain versions of the operators, for tests."""

import re


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near(docs):
    """[(doc_id, text)] -> {doc_id: (n_shingles, component_id)}"""
    sets = {i: shingles(t) for i, t in docs}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    both = {}
    for ids in by.values():
        for a in range(len(ids)):
            for b in range(a):
                both[ids[b], ids[a]] = both.get((ids[b], ids[a]), 0) + 1
    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def removed(docs, length=200):
    """[(doc_id, text)] -> {doc_id: bytearray of 0/1 flags}"""
    seen, out = {}, {i: bytearray(len((t or "").encode())) for i, t in docs}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            seen.setdefault(b[k : k + length], []).append((i, k))
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                out[i][k : k + length] = b"\1" * length
    return out
