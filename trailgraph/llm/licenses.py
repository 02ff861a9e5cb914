"""License scan with a positional rare-token index, in DataFrame expressions only.

Each template's rarest words (highest IDF, counted over the whole corpus) are
looked up in every file; postings (template, place) are intersected by relative
position: words that agree on template and offset vote for it. A candidate
counts if all words of the template's mandatory key phrases stand where the
offset puts them. The templates' words bound every collected table.

Null and empty texts have no words, no labels and score 0. Repeated rows give
repeated results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgraph.llm import text as T
from trailgraph.llm.decontaminate import words
from trailgraph.runtime import cut_lineage

# Licence notices (label, words, mandatory key phrases).
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["free software", "gnu general public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
]
# The base phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]


def _known(w: Column, vocabulary: list[str]) -> Column:
    """(pos, word) of the words of ``w`` that are in the vocabulary."""
    placed = F.transform(w, lambda x, i: F.struct(i.alias("pos"), x.alias("word")))
    return F.filter(placed, lambda s: s["word"].isin(vocabulary))


def idf(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, float]:
    """ln((N + 1) / (df + 1)) of the vocabulary's words; one row per word comes back."""
    src = docs.select(F.array_intersect(words(F.col(text_col)), F.array(*map(F.lit, vocabulary))).alias("w"))
    rows = src.select(F.explode_outer(F.concat("w", F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    df = {r[0]: r[1] for r in rows}
    n = df.pop("", 0)
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in vocabulary}


def _values(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    """A literal table, made in a plan without Python rows."""
    return spark.range(1).select(F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows])).alias("x")).select("x.*")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, rare: int = 4) -> DataFrame:
    """key, doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    ``rare``: words of highest IDF per template that are indexed. Score: the
    largest share of a found template's words that stand in place; a base
    phrase alone scores 0.5.
    """
    spark = docs.sparkSession
    bodies = [(t, label, text.split(), phrases) for t, (label, text, phrases) in enumerate(templates)]
    vocabulary = sorted({w for _, _, body, _ in bodies for w in body})
    weight = idf(docs, vocabulary, text_col)
    postings, parts, sizes = [], [], []
    for t, label, body, phrases in bodies:
        top = sorted(set(body), key=lambda w: (-weight[w], w))[:rare]
        postings += [(t, i, w) for i, w in enumerate(body) if w in top]
        must = {at + j for p in phrases for at in range(len(body)) for j in range(len(p.split())) if body[at : at + len(p.split())] == p.split()}
        parts += [(t, i, w, i in must) for i, w in enumerate(body)]
        sizes.append((t, label, len(body), len(must), min(2, len(top))))
    seeds = sorted({w for _, _, w in postings})

    src = docs.select(T.row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("w"))
    is_seed = F.arrays_overlap("w", F.array(*map(F.lit, seeds)))

    def bases(x, i):
        out = None
        for phrase, label in PHRASES:
            *before, last = phrase.split()
            cond = x == last
            for j, b in enumerate(before):
                cond = cond & F.coalesce(F.get("w", i - len(before) + j) == b, F.lit(False))
            made = F.struct((i - len(before)).cast("long").alias("pos"), F.lit(label).alias("label"))
            out = F.when(cond, made) if out is None else out.when(cond, made)
        return out

    last_words = sorted({p.split()[-1] for p, _ in PHRASES})
    hits = F.when(F.arrays_overlap("w", F.array(*map(F.lit, last_words))), F.array_compact(F.transform("w", bases))).otherwise(F.array().cast("array<struct<pos:bigint,label:string>>"))
    first = cut_lineage(src.select("key", "doc_id", F.size("w").cast("long").alias("n_words"), hits.alias("base"), F.when(is_seed, _known(F.col("w"), vocabulary)).alias("known")))

    known = first.filter("known is not null").select("key", F.explode("known").alias("k")).select("key", "k.pos", "k.word").distinct()
    post = _values(spark, postings, ["t", "i", "word"])
    votes = known.filter(F.col("word").isin(seeds)).join(F.broadcast(post), "word").groupBy("key", "t", (F.col("pos") - F.col("i")).alias("off")).agg(F.countDistinct("word").alias("votes"))
    facts = F.broadcast(_values(spark, sizes, ["t", "label", "n_all", "n_must", "need"]))
    cands = votes.join(facts, "t").filter(F.col("votes") >= F.col("need"))
    expected = cands.join(F.broadcast(_values(spark, parts, ["t", "i", "word", "must"])), "t").select("key", "t", "off", "label", "n_all", "n_must", (F.col("off") + F.col("i")).alias("pos"), "word", "must")
    found = expected.join(known, ["key", "pos", "word"]).groupBy("key", "t", "off", "label", "n_all", "n_must").agg(F.count("*").alias("n"), F.count_if("must").alias("n_key")).filter(F.col("n_key") == F.col("n_must"))
    per_doc = found.groupBy("key").agg(F.collect_set("label").alias("more"), F.max(F.col("n") / F.col("n_all")).alias("share"), F.collect_set(F.struct(F.col("off").alias("start"), "label", "t")).alias("matches"))
    out = first.join(per_doc, "key", "left")
    plain = F.array_distinct(F.transform("base", lambda b: b["label"]))
    pos = F.transform("base", lambda b: b["pos"])
    return out.select(
        "key", "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(pos).alias("first_word"), F.array_max(pos).alias("last_word"),
        F.array_join(F.array_sort(plain), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(plain, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"), "matches",
    )
