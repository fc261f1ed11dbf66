"""Plain versions of what the operators do, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


def words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [w for w in re.split("[ \x09-\x0d]+", lower) if w]


def shingles(text):
    w = words(text)
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def near_duplicates(rows):
    """{id: (number of shingles, component)}"""
    sets, up, inv = {k: frozenset(shingles(t)) for k, t in rows}, {}, defaultdict(list)

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for k, s in sets.items():
        for o, both in Counter(o for x in s for o in inv[x]).items():
            if 100 * both >= 75 * (len(s) + len(sets[o]) - both):
                a, b = root(k), root(o)
                up[max(a, b)] = min(a, b)
        for x in s:
            inv[x].append(k)
    return {k: (len(s), root(k)) for k, s in sets.items()}


def repeats(rows):
    """{id: (bytes, removed, runs, sha of what is left)}"""
    first, out = {}, {}
    for k, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], k)
    for k, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < k:
                gone[p : p + 50] = b"\1" * 50
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[k] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


KINDS = ("email", "ip", "card", "phone")


def pii(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(d)) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(found)
