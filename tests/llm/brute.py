"""Plain Python versions of the contracts."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def substring_dedup(rows, n=20):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for s in range(len(w) - n + 1):
            g = tuple(w[s : s + n])
            if g in seen:
                keep[s : s + n] = [False] * n
            else:
                seen.add(g)
        kept = [x for x, k in zip(w, keep) if k]
        out[d] = (len(w), len(w) - len(kept), sha(" ".join(kept)))
    return out


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_dedup(rows):
    sets = {d: shingles(t) for d, t in rows}
    places = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            places[g].append(d)
    shared = Counter()
    for p in places.values():
        for i, a in enumerate(p):
            for b in p[i + 1 :]:
                shared[a, b] += 1
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in shared.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def quality_base(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    repeated = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), failed
