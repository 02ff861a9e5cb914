"""Long regular words and texts, which a polynomial hash would take for equal."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

from trailgraph.llm import bpe, jaccard, passages


def regular(n, a, b):
    """Two different sequences of n items that agree in every polynomial modulo a power of two."""
    one = [(a, b)[bin(i).count("1") & 1] for i in range(n)]
    return one, [b if x == a else a for x in one]


def test_words(spark):
    x, y = ("".join(w) for w in regular(1024, "a", "b"))
    docs = spark.createDataFrame([(1, x), (2, y), (3, f"{x} one two three four"), (4, f"{y} one two three four")], "doc_id long, text string")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    for i, t in ((1, x), (2, y)):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    found = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 4}


def test_texts(spark):
    x, y = (" ".join(w) for w in regular(2048, "left", "right"))
    docs = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in passages.remove(docs).collect()}
    from brute import repeats

    want = {r[0]: r for r in repeats([(1, x), (2, y)])}
    for i in (1, 2):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == tuple(want[i][1:4])
