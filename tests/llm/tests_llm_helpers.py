"""Plain versions of what operators compute."""

import re
from collections import defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def split(text):
    return [w for w in SPACE.split(text or "") if w]


def bench_words(text):
    return [w.decode() for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())]


def jaccard_expected(rows):
    sets = []
    for i, t in rows:
        w = split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, {tuple(w[p : p + 4]) for p in range(len(w) - 3)} or ({tuple(w)} if w else set())))
    label = {k: k for k in range(len(sets))}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                label[max(root(a), root(b))] = min(root(a), root(b))
    least = defaultdict(lambda: 10**9)
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(least[root(k)], i)
    return sorted((i, len(s), least[root(k)]) for k, (i, s) in enumerate(sets))
