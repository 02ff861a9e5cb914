"""Copies, near copies, repeated passages and benchmark windows against plain Python."""

import random

import brute
import pytest

from trailgraph.llm import decontaminate, exact, jaccard


def corpus(seed: int, n: int = 120):
    r = random.Random(seed)
    vocab = [a + b for a in ("ka", "Lo", "mi", "né", "su") for b in ("x", "Y", "z,", "w.", "ñ")]
    base = [[r.choice(vocab) for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 20, 60, 150, 300]))] for _ in range(n // 3)]
    texts = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            if w:
                k = r.randrange(len(w))
                w[k : k + r.choice([0, 1])] = [r.choice(vocab)] * r.choice([0, 1])
        if r.random() < 0.2:
            other = r.choice(base)
            w = w[: len(w) // 2] + other + w[len(w) // 2 :]
        texts.append(r.choice(["", " ", "\n"]) + r.choice([" ", "  ", "\n\t"]).join(w))
    return texts + [None, "", " \n"]


@pytest.fixture(scope="module", params=[1, 2])
def docs(spark, request):
    rows = [(i * 3 + 1, t, "x", i) for i, t in enumerate(corpus(request.param))]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, sig long").repartition(4)


def given(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_exact(docs):
    assert got(exact.groups(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute.exact(given(docs))


def test_exact_repeated_rows(spark):
    rows = [(5, "a  b"), (5, "a  b"), (3, "a b"), (None, "a\tb"), (None, None), (7, ""), (9, "z"), (9, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(tuple(r) for r in exact.drop_copies(df).collect())
    assert kept == [(3, "a b"), (7, ""), (9, "z")]
    assert [r.kept for r in exact.groups(df).collect()].count(True) == 3


def test_exact_hot_group(spark):
    df = spark.range(3000).selectExpr("id doc_id", "if(id % 3 = 0, 'same   text', concat('t', id)) text")
    rows = exact.groups(df).collect()
    assert all((r.group_size, r.keep_id, r.kept) == ((1000, 0, r.doc_id == 0) if r.doc_id % 3 == 0 else (1, r.doc_id, True)) for r in rows) and len(rows) == 3000


def test_jaccard(docs):
    assert got(jaccard.join(docs), "doc_id", "n_shingles", "component_id") == sorted(brute.components(given(docs)))


def test_jaccard_odd_rows(spark):
    rows = [(2, "a b c d e f"), (2, "a b c d e f"), (None, "A b c d e f"), (1, None), (4, "a b"), (3, "A B")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard.join(df).collect()
    comp = {(r.doc_id, r.n_shingles): r.component_id for r in out}
    assert len(out) == 6 and comp[4, 1] == comp[3, 1] == 3 and comp[1, 0] == 1 and comp[2, 2] == comp[None, 2]
    assert jaccard.drop_near_copies(df).count() == 3


def test_decontaminate(docs, spark):
    texts = [t for _, t in given(docs) if t]
    r = random.Random(7)
    items = [(i, " ".join(brute.words2(r.choice(texts))[a : a + n])) for i in range(25) for a, n in [(r.randrange(8), r.choice([1, 3, 5, 9, 10, 11, 30]))]] + [(98, None), (99, "…")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.decontaminate(given(docs), items))
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(decontaminate.scan(docs, bench), *cols) == want
    limit, decontaminate.FEW = decontaminate.FEW, 0
    try:
        assert got(decontaminate.scan(docs, bench), *cols) == want
    finally:
        decontaminate.FEW = limit
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [x[0] for x in want if not x[5]]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact.groups(none).collect() == [] and jaccard.join(none).collect() == []
    assert decontaminate.scan(none, spark.createDataFrame([], "item_id long, text string")).collect() == []
