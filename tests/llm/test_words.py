"""Counting words before they are encoded."""

import pyarrow as pa

from trailgraph.llm import bpe


def test_words_are_counted_without_a_tokenizer(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 64)
    monkeypatch.setattr(bpe, "tokenizer", None)
    texts = [f"some words <|end|> {i}ä" for i in range(40)] + ["", "x" * 200]
    total: dict[str, int] = {}
    parts = 0
    for out in bpe._distinct(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), ("<|end|>",)):
        parts += 1
        for word, n in zip(out["word"], out["n"]):
            total[word] = total.get(word, 0) + int(n)
    assert parts > 10 and total["<|end|>"] == total["some"] == total[" words"] == 40 and total["x" * 200] == 1
