"""Hidden Markov scores: recursions against enumeration, base scores against plain counts, edge cases."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailgraph.llm import hmm as H
from trailgraph.llm import text as T

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)) + [""]


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def base(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) by plain counting."""
    c = Counter(w for i, t in rows if not held_out(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(i, held_out(i), len(words(t)), sum(w in c for w in words(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))) for i, t in rows]


def model(states=3, used=6, seed=1):
    rng = np.random.default_rng(seed)
    emit = np.zeros((H.CLASSES, states))
    emit[:used] = rng.dirichlet(np.ones(used), states).T
    return H.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), emit)


def paths(m, seq):
    """Probability of every state path with the sequence."""
    for path in itertools.product(range(len(m.start)), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for a, b, s in zip(path, path[1:], seq[1:]):
            p *= m.step[a, b] * m.emit[s, b]
        yield path, p


SEQS = [np.array(x, np.uint16) for x in ([0], [3, 1, 0], [5, 5, 2, 4, 1, 0], [1, 0], [2, 2, 2, 3, 0])]


@pytest.mark.parametrize("segment", [1 << 19, 4])
def test_recursions(monkeypatch, segment):
    monkeypatch.setattr(H, "SEGMENT", segment)
    m = model()
    got = H.log_likelihoods(m, SEQS)
    out = H.Expected(3)
    out.add(m, SEQS)
    start, step, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((H.CLASSES, 3))
    for seq, ll in zip(SEQS, got):
        total = sum(p for _, p in paths(m, seq))
        assert ll == pytest.approx(math.log10(total), abs=1e-12)
        for path, p in paths(m, seq):
            start[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                step[a, b] += p / total
            for s, k in zip(seq, path):
                emit[s, k] += p / total
    for a, b in ((out.start, start), (out.step, step), (out.emit, emit)):
        np.testing.assert_allclose(a, b, atol=1e-9)


def test_training_helps_and_adds_up(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learn = docs.filter(T.crc_mod("doc_id", 10) != 0)
    table = H.counts(learn).cache()
    v = H.vocabulary(table, learn.count())
    assert v.total == table.agg(F.sum("n")).first()[0] + v.texts and v.types == table.count() + 1
    assert v.mass.sum() == pytest.approx(v.total + 0.1 * (v.types + H.TIED))
    encoded = H.encode(docs, v)
    seqs = [np.frombuffer(r[0], np.uint16) for r in encoded.filter("not held_out").select("classes").collect()]
    likely = []
    m = H.first_model(v.prior(), 4)
    for _ in range(4):
        likely.append(H.log_likelihoods(m, seqs).sum())
        m = H._round(encoded.filter("not held_out"), m, v.prior())
        for x in (m.start, *m.step, *m.emit.T):
            assert x.sum() == pytest.approx(1, abs=1e-6) and (x >= 0).all()
    assert likely == sorted(likely)


def test_base_and_gain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r[0]: r for r in base([(r["doc_id"], r["text"]) for r in docs.collect()])}
    got = H.score(docs).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[:5] == want[r["doc_id"]][:5]
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][5], rel=1e-9)
    kept = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in kept) > sum(r["base_score"] for r in kept) + 0.05 * sum(r["n_tokens"] for r in kept)


def test_words_beyond_the_head(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    want = {r["doc_id"]: r for r in H.score(docs, sample_rounds=2, rounds=1).collect()}
    monkeypatch.setattr(H, "HEAD", 300)
    monkeypatch.setattr(H, "OWN", 200)
    small = H.score(docs, sample_rounds=2, rounds=1).collect()
    for r in small:
        assert (r["n_known"], r["n_tokens"]) == (want[r["doc_id"]]["n_known"], want[r["doc_id"]]["n_tokens"])
        assert r["base_score"] == pytest.approx(want[r["doc_id"]]["base_score"], rel=1e-9)


def test_edges(spark):
    rows = [(None, "A b"), (None, None), (1, ""), (1, ""), (2, None), (3, "a " * 60_000), (4, "Ab" * 40_000), (11, "\x00 ä\tÄ"), (11, "\x00 ä\tÄ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("uid", F.lit("u")).withColumn("n", F.lit(0)).withColumn("h", F.lit(0)).withColumn("classes", F.lit(0))
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in H.score(df, sample_rounds=1, rounds=1).collect()))
    assert got == sorted((i is None, i or 0, n, k, t, round(b, 6)) for i, _, n, k, t, b in base(rows))
    empty = df.limit(0)
    assert H.score(empty).collect() == []
    only = [i for i in range(100) if held_out(i)][:2]
    lone = spark.createDataFrame([(i, "no training rows") for i in only], "doc_id long, text string")
    for r in H.score(lone).collect():
        assert (r["n_known"], r["train_tokens"], r["base_score"]) == (0, 0, 0.0) and r["score"] < 0


def test_long_regular_words_differ():
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((a + " " + b).encode(), np.uint8)
    h = T.Words(data, np.array([0, len(data)])).hashes
    assert h[0] != h[1]


def test_every_round_reads_all_training_rows(spark, monkeypatch):
    docs = spark.range(1300).select(F.col("id").alias("doc_id"), F.concat(F.lit("word w"), F.col("id") % 7).alias("text"))
    seen, whole = [], H._round
    monkeypatch.setattr(H, "_round", lambda rows, *a: seen.append(rows.count()) or whole(rows, *a))
    H.score(docs).collect()
    assert set(seen) == {sum(not held_out(i) for i in range(1300))} and len(seen) == H.ROUNDS
