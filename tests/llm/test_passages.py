"""Repeated passages against plain Python."""

import random

import brute
import pytest

from trailgraph.llm import passages


@pytest.mark.parametrize("seed", [1, 2])
def test_passages(spark, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É,", "b c", "x."]
    some = lambda n: [r.choice(vocab) for _ in range(n)]
    shared = [some(n) for n in (20, 34, 35, 36, 50, 90, 300)]
    texts = [" ".join(some(r.randint(0, 80)) + r.choice(shared)[r.randint(0, 9) :] + some(r.randint(0, 60))) for _ in range(60)]
    texts += [texts[0]] * 3 + [texts[1].replace(" ", "\n ")] + ["one " * 500, "one " * 36, "one " * 35, "a b " * 40, None, "", "  ", " ".join(some(34)), " ".join(shared[3]), " ".join(shared[3]), "long " + " ".join(some(20_000))]
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int").repartition(5)
    got = sorted(tuple(x) for x in passages.remove(docs).collect())
    assert got == sorted(brute.repeats([x[:2] for x in rows]))
    kept = {x.doc_id: x for x in passages.remove(docs, full=True).collect()}
    assert all(brute.sha(x.kept) == x.kept_sha256 for x in kept.values())


def test_odd_rows(spark):
    t = " ".join(f"v{i}" for i in range(40))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (None, None), (2, "x " + t[:-4])], "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in passages.remove(df).collect())
    assert out == [(0, 0, 0), (0, 40, 40), (1, 40, 40), (1, 40, 40), (2, 40, 39)]
    assert passages.remove(df.limit(0)).collect() == []
