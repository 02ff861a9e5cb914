"""Collocations against plain counting; tries against dictionaries; edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailgraph.llm import collocations as C

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, lang string, text string"


def brute(rows, least=30, longest=4, top=2000):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        n = sum(a for p, a in c.items() if len(p) == 1)
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        held = {p[i : i + m] for p, a in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * cand[p[i : i + m]]}
        best = []
        for p, a in cand.items():
            if p not in held:
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


def got(df, **kw):
    return sorted(tuple(r) for r in C.collocations(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, n=120):
    rng = random.Random(seed)
    common = ["new york", "of the", "state of the art", "es", "en", "de", "no", "New", "ä", "tokio"]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 40)):
            parts.append(rng.choice(common) if rng.random() < 0.7 else f"w{rng.randrange(60)}")
        out.append((rng.choice(["en", "es", "de", None]), "".join(p + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for p in parts)))
    return out


@pytest.mark.parametrize("burst,room", [(1 << 15, 1 << 20), (4, 200)])
def test_plain_counting(spark, monkeypatch, burst, room):
    monkeypatch.setattr(C, "BURST", burst)
    monkeypatch.setattr(C, "ROOM", room)
    rows = corpus(1)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).repartition(5)
    assert got(df, least=5) == brute(rows, least=5)
    assert got(df, least=3, top=4) == brute(rows, least=3, top=4)


def test_trie_counts_and_spills():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2)
    want, spilt, trie = Counter(), Counter(), C.HatTrie(3)
    C_burst, C.BURST = C.BURST, 50
    try:
        for _ in range(30):
            keys = np.unique(words[rng.integers(0, 40, (300, 3))], axis=0)
            n = rng.integers(1, 5, len(keys))
            want.update({tuple(k): int(x) for k, x in zip(keys.tolist(), n)})
            trie.add(C.fold([keys[:, j] for j in range(3)]), keys, n)
            if trie.size() > 2000:
                for k, x in trie.spill(500):
                    assert k.tolist() == sorted(k.tolist())
                    spilt.update(dict(zip(map(tuple, k.tolist()), x.tolist())))
                assert trie.size() <= 500
        for k, x in trie.spill(0):
            spilt.update(dict(zip(map(tuple, k.tolist()), x.tolist())))
    finally:
        C.BURST = C_burst
    assert spilt == want and trie.size() == 0


def test_edges(spark):
    long = "Alpha Beta gamma delta " * 20_000
    rows = [(None, None), ("en", ""), ("en", " .;! \n"), ("xx", long), ("xx", long), ("en", "a b a b a b a b"), ("en", "a b a b a b a b"), ("", "x y " * 9)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    for name in ("n", "key", "word", "id", "m", "rank", "p"):
        df = df.withColumn(name, F.lit("x"))
    assert got(df, least=2) == brute(rows, least=2)
    assert got(df.limit(0)) == []
    one = df.filter("doc_id < 3")
    assert got(one) == []


def test_large_counts_stay_exact(spark):
    phrases = spark.createDataFrame([([1], 1, 9 * 10**17), ([2], 1, 9 * 10**17), ([1, 2], 2, 8 * 10**17)], "key array<long>, m int, n long")
    assert C.weakest_cuts(phrases).select("score").first()[0] == 2000000 * 8 * 10**17 // (18 * 10**17)
    cand = C.weakest_cuts(phrases)
    longer = phrases.unionByName(spark.createDataFrame([([3, 1, 2], 3, 64 * 10**16)], phrases.schema))
    assert C.not_inside(cand, longer).count() == 0
    less = phrases.unionByName(spark.createDataFrame([([3, 1, 2], 3, 64 * 10**16 - 1)], phrases.schema))
    assert C.not_inside(cand, less).count() == 1
