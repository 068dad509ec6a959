"""Plain versions of the operators' contracts, for comparison on small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter


def words10(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def jaccard(rows, k=4, percent=85):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text) rows with distinct ids."""
    sets = {}
    for d, t in rows:
        w = words10(t)
        n = min(k, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    up = {d: d for d in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    index = {}
    for d, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(d)
    shared = Counter()
    for ds in index.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def words2(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def decontaminate(docs, items, window=8):
    wanted = {}
    for i, t in items:
        w = words2(t)
        for j in range(max(1, len(w) - window + 1)) if w else ():
            wanted.setdefault(tuple(w[j : j + window]), set()).add(i)
    out = {}
    lengths = {len(x) for x in wanted}
    for d, t in docs:
        w, hit, found = words2(t), set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if (of := wanted.get(tuple(w[j : j + n]))) is not None:
                    hit.update(range(j, j + n))
                    found |= of
        ids = ",".join(sorted(map(str, found)))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(found) >= 2)
    return out


def rules(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if n[tuple(w[i : i + 3])] > 1:
            hit.update((i, i + 1, i + 2))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def secrets(t):
    t = t or ""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)
