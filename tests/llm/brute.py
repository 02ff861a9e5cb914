"""Plain Python versions of the contracts, one document at a time."""

import hashlib
import re
import zlib
from collections import defaultdict


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def words2(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(s))


def words8(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def pii(text):
    t = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def secrets(text):
    t = text or ""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A):
        if len(m[2]) >= 6:
            out.append(("assign", m.start(), m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", t):
        if len(m[0]) >= 20:
            out.append(("access", m.start(), m.end()))
    for m in re.finditer(r"[0-9a-f]+", t):
        if len(m[0]) >= 24:
            out.append(("hex", m.start(), m.end()))
    order = ["assign", "access", "hex"]
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def licenses(text):
    w = words2(text)
    out = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), out


def decontaminate(docs, items, window=10):
    wins = defaultdict(set)
    for item, t in items:
        w = words2(t)
        if w:
            m = min(window, len(w))
            for i in range(len(w) - m + 1):
                wins[tuple(w[i : i + m])].add(str(item))
    sizes = {len(x) for x in wins}
    out = []
    for i, t in docs:
        w, hit, its = words2(t), set(), set()
        for m in sizes:
            for a in range(len(w) - m + 1):
                if (x := tuple(w[a : a + m])) in wins:
                    hit.update(range(a, a + m))
                    its |= wins[x]
        out.append((i, len(w), len(hit), len(its), sha(",".join(sorted(its))), bool(hit)))
    return out


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return [(i, len(s), find(i)) for i, s in sets]


def repeats(docs, window=35):
    starts = defaultdict(int)
    ws = [(i, words8(t)) for i, t in docs]
    for _, w in ws:
        for a in range(len(w) - window + 1):
            starts[tuple(w[a : a + window])] += 1
    out = []
    for i, w in ws:
        gone = set()
        for a in range(len(w) - window + 1):
            if starts[tuple(w[a : a + window])] > 1:
                gone.update(range(a, a + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for n, x in enumerate(w) if n not in gone))))
    return out


def exact(docs):
    g = defaultdict(list)
    for i, t in docs:
        g[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return sorted((i, min(ids), len(ids), i == min(ids), sha(t)) for t, ids in g.items() for i in ids)


def crc_mod(i, m):
    return zlib.crc32(str(i).encode()) % m
