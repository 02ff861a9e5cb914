"""Tokens, classifiers and the pipeline: round trips, held-out accuracy, plain Python."""

import hashlib

import brute
import pytest
import public_tokenizers

import corpus_pipeline
from trailgraph.llm import bpe, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n a  b", "x<|endoftext|> y <|endoftext|>", "I'll they've 's''s 'S", "é中\u0085  １２３ ½", "\U0001f600 tabs\t\t.", "a" * 5000, " " * 300, "don't" * 400]


def tokens_of(rows):
    tok, out = bpe.tokenizer(PATH), []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("head", [bpe.HEAD_WORDS, 40, 0])
def test_bpe(spark, head):
    rows = [*enumerate(ODD), (3, ODD[3]), (None, "null id")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int").repartition(3)
    out = bpe.encode(docs, PATH, head_words=head, full=True).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out), key=repr) == tokens_of(rows)
    assert all(brute.sha(r.decoded) == r.decoded_sha256 for r in out)


def test_bpe_decode_any_ids(spark):
    ids = spark.createDataFrame([(1, [15496, 995, 50256]), (2, [])], "k int, ids array<int>")
    assert [(r.k, bytes(r.bytes)) for r in bpe.decode(ids, PATH, ["k"]).collect()] == [(1, b"Hello world<|endoftext|>")]


@pytest.mark.parametrize("name, label, least", [("op5_quality", "quality", 0.97), ("op6_toxicity", "toxic", 0.85)])
def test_held_out(spark, name, label, least):
    out = queries.QUERIES[name](spark, SF)
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r[label] for r in rows) / len(rows) >= least
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_models_take_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 2.0) for i, t in enumerate(ODD)] + [(None, None, None), (3, ODD[3], 1.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    few = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)], "doc_id long, quality int, toxic int")
    for labels in (none, few):
        for module in (quality, toxicity):
            rows = module.score(docs, module.train(docs, labels)).collect()
            assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
    for module in (quality, toxicity):
        assert module.score(docs.limit(0), module.train(docs.limit(0), none)).collect() == []


def test_kernel_takes_gaps():
    marks = toxicity.dense(*toxicity.as_codes(["idiot"]))
    near = lambda w: float(toxicity.dense(*toxicity.as_codes([w]))[0] @ marks[0])
    assert near("idiot") > 0.99 and near("idxiot") > 0.5 and near("idiots") > 0.7 and near("garden") < 0.1


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.score(docs, quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).filter("predicted = 1").collect()}
    left = [(i, rows[i]) for i in sorted(good)]
    kept = {x[0] for x in brute.exact(left) if x[3]}
    left = [x for x in left if x[0] in kept]
    # Only texts of near length that share words can link, so compare within those.
    comp = dict((i, c) for i, _, c in brute.components(left))
    left = [x for x in left if comp[x[0]] == x[0]]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {x[0] for x in brute.decontaminate(left, bench) if x[5]}
    want = tokens_of([x for x in left if x[0] not in bad])
    got = sorted((tuple(r)[:4] for r in corpus_pipeline.run(spark, SF).collect()), key=repr)
    assert got == want and len(got) > 300
