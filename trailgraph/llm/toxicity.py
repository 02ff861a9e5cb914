"""Toxicity: support vector machine on a gapped subsequence kernel with Nyström landmarks.

Strings are the words of a sentence, reduced to letters (accents folded, marks
inside a word left out, lone letters in a row joined), so spaced or punctuated
insults are words too. The kernel of two words compares all subsequences of three
letters that span at most five, weighted by DECAY per skipped letter and
normalised; values under FLOOR count as none, which makes the matrix of
landmarks slightly indefinite, so its eigenvalues are taken as 0.05 at least. A sentence's similarity to a landmark is
that of its closest word. Landmarks are chosen on a sample of labelled
documents (a documented bound); sentences of clean documents are negative
examples, the most suspicious sentence of a toxic document is a positive one.
A document scores as its worst sentence.

Every row is scored over its whole text; null and empty texts score as a
sentence without insults. Without labels of both kinds every score is 0.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgraph.llm import text as T
from trailgraph.runtime import cut_lineage

SAMPLE = 6_000  # labelled documents of each kind
TOKENS = 6_000  # words that may become landmarks
LANDMARKS = 64
ROUNDS = 3  # of choosing the worst sentences and fitting
DECAY = 0.6
FLOOR = 0.3
CHUNK = 1 << 19
#: (second, third) letter offsets of subsequences that span at most five letters.
SHAPES = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]
# Digits and signs that stand for letters.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


@functools.cache
def letter_codes() -> np.ndarray:
    """Per code point: 1-26 for a-z (folded), 27-31 other letters, 0 none, 32 white space, 33 sentence end."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        s = chr(c)
        kind = unicodedata.category(s)[0]
        if kind == "L":
            base = unicodedata.normalize("NFKD", s)[0].lower() if c < 0x3000 else s
            out[c] = ord(base) - 96 if "a" <= base <= "z" else 27 + c % 5
        elif s.isspace():
            out[c] = 32
    for s, to in STANDS_FOR.items():
        out[ord(s)] = ord(to) - 96
    out[[ord(c) for c in ".!?"]] = 33
    out[[10, 13]] = 34
    return out


class Tokens:
    """Letter words of a chunk: codes (all letters), start (borders), doc, sentence, hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        kind = letter_codes()[cp]
        n = len(cp)
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(lead[offsets]))
        blank = (kind == 32) | (kind == 34)
        # A sentence ends at a line end, or at . ! ? before white space.
        after = np.ones(n, bool)
        after[:-1] = blank[1:]
        stop = (kind == 34) | (kind == 33) & after
        new_row = np.zeros(n, bool)
        new_row[1:] = rows[1:] != rows[:-1]
        sentence = np.cumsum(np.concatenate([[0], stop[:-1]]) + new_row) if n else np.zeros(0, int)
        word = np.cumsum(blank | new_row)
        is_letter = (kind > 0) & (kind < 32)
        codes, word, sentence, rows = kind[is_letter], word[is_letter], sentence[is_letter], rows[is_letter]
        begin = np.ones(len(codes), bool)
        begin[1:] = word[1:] != word[:-1]
        starts = np.flatnonzero(begin)
        lone = np.diff(np.append(starts, len(codes))) == 1
        # Lone letters in a row are one word.
        glue = np.zeros(len(starts), bool)
        glue[1:] = lone[1:] & lone[:-1] & (sentence[starts[1:]] == sentence[starts[:-1]]) & (rows[starts[1:]] == rows[starts[:-1]])
        starts = starts[~glue]
        self.codes, self.start = codes, np.append(starts, len(codes))
        self.doc, self.sentence = rows[starts] if len(starts) else np.zeros(0, int), sentence[starts] if len(starts) else np.zeros(0, int)
        self.hash = T.span_hash(T.mix(codes.astype(np.uint64)), starts, self.start[1:])

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Letters and borders of the distinct words, first place and back reference."""
        _, first, back = np.unique(self.hash, return_index=True, return_inverse=True)
        size = (self.start[1:] - self.start[:-1])[first]
        at = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(at[-1]) - np.repeat(at[:-1] - self.start[first], size)
        return self.codes[take], at, first, back


def triples(codes: np.ndarray, at: np.ndarray):
    """(word, subsequence code, weight) of every gapped subsequence of three letters."""
    word = np.repeat(np.arange(len(at) - 1), np.diff(at))
    c = codes.astype(np.int32)
    for second, third in SHAPES:
        n = len(c) - third
        if n <= 0:
            continue
        ok = np.flatnonzero(word[:n] == word[third:])
        yield word[ok], c[ok] * 1024 + c[ok + second] * 32 + c[ok + third], DECAY ** (third - 2)


def dense(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Normalised feature vectors of a few words: word x 32768."""
    out = np.zeros((len(at) - 1, 1 << 15), np.float32)
    for w, code, weight in triples(codes, at):
        np.add.at(out, (w, code), np.float32(weight))
    return out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-6)


class Features:
    """Normalised feature vectors of many words, only their used entries: word, code, phi; first entry of each word."""

    def __init__(self, codes: np.ndarray, at: np.ndarray):
        key, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for w, code, x in triples(codes, at):
            key.append(w.astype(np.int64) << 15 | code)
            weight.append(np.full(len(w), x, np.float32))
        uniq, back = np.unique(np.concatenate(key), return_inverse=True)
        phi = np.bincount(back, np.concatenate(weight), len(uniq))
        self.n, self.word, self.code = len(at) - 1, uniq >> 15, uniq & 0x7FFF
        norm = np.sqrt(np.bincount(self.word, phi**2, self.n))
        self.phi = (phi / norm[self.word]).astype(np.float32)
        self.first = np.searchsorted(self.word, np.arange(self.n + 1))
        self.some = np.flatnonzero(np.diff(self.first))

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        """Kernel values of a few words against all: rows x n."""
        block = np.zeros((len(rows), 1 << 15), np.float32)
        for i, r in enumerate(rows):
            at = slice(self.first[r], self.first[r + 1])
            block[i, self.code[at]] = self.phi[at]
        out = np.zeros((len(rows), self.n), np.float32)
        if len(self.some):
            out[:, self.some] = np.add.reduceat(block[:, self.code] * self.phi, self.first[self.some], axis=1)
        out[out < FLOOR] = 0
        return out


def as_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    table = letter_codes()
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return table[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)] if words else np.zeros(0, np.uint8), at


def similar(codes: np.ndarray, at: np.ndarray, marks: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(words, kernel values word x landmark) of the words near any landmark.

    The sum of each subsequence's largest landmark weight bounds the kernel from
    above and leaves few words to compare exactly.
    """
    n = len(at) - 1
    most = marks.max(0) if len(marks) else np.zeros(1 << 15, np.float32)
    bound, norm = np.zeros(n), np.zeros(n)
    for w, code, weight in triples(codes, at):
        bound += np.bincount(w, most[code] * weight, n)
        norm += np.bincount(w, minlength=n) * weight**2
    near = np.flatnonzero(bound >= FLOOR * np.sqrt(np.maximum(norm, 1e-12)))
    near = near[norm[near] > 0]
    values = np.zeros((len(near), len(marks)), np.float32)
    for lo in range(0, len(near), block):
        part = near[lo : lo + block]
        size = (at[1:] - at[:-1])[part]
        to = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(to[-1]) - np.repeat(to[:-1] - at[part], size)
        own, k = np.zeros(len(part)), np.zeros((len(part), len(marks)), np.float32)
        key, weight = [], []
        for w, code, x in triples(codes[take], to):
            key.append(w.astype(np.int64) << 15 | code)
            weight.append(np.full(len(w), x))
        uniq, back = np.unique(np.concatenate(key), return_inverse=True)
        phi = np.bincount(back, np.concatenate(weight))
        w, code = uniq >> 15, uniq & 0x7FFF
        own = np.sqrt(np.bincount(w, phi**2, len(part)))
        hit = most[code] > 0
        first = np.flatnonzero(np.diff(w[hit], prepend=-1))
        if hit.any():
            k[w[hit][first]] = np.add.reduceat(marks[:, code[hit]].T * phi[hit][:, None], first, axis=0)
        values[lo : lo + len(part)] = k / own[:, None]
    values[values < FLOOR] = 0
    kept = values.any(1)
    return near[kept], values[kept]


def sentences(tokens: Tokens, marks: np.ndarray):
    """(doc, similarity row) of the sentences with a word near a landmark."""
    codes, at, _, back = tokens.distinct()
    near, values = similar(codes, at, marks)
    row = np.full(len(at) - 1, -1)
    row[near] = np.arange(len(near))
    place = np.flatnonzero(row[back] >= 0) if len(back) else np.zeros(0, int)
    if not len(place):
        return np.zeros(0, int), np.zeros((0, len(marks)), np.float32)
    group = tokens.sentence[place]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    return tokens.doc[place][first], np.maximum.reduceat(values[row[back[place]]], first, axis=0)


class Model:
    def __init__(self, marks=None, weights=None, bias=0.0, slope=0.0, shift=-40.0):
        self.marks = np.zeros((0, 1 << 15), np.float32) if marks is None else marks
        self.weights = np.zeros(len(self.marks)) if weights is None else weights
        self.bias, self.slope, self.shift = bias, slope, shift

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        worst = np.full(len(offsets) - 1, self.bias)
        if len(self.marks):
            doc, k = sentences(Tokens(data, offsets), self.marks)
            np.maximum.at(worst, doc, k @ self.weights + self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -40, 40)))


def choose(words: list[str], toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> tuple[np.ndarray, int]:
    """Landmarks among the words: those whose neighbourhoods hold most toxic documents against clean ones, then clean words that resemble them; also how many are of the first kind."""
    f = Features(*as_codes(words))
    i, j, value = [], [], []
    for lo in range(0, f.n, 32):
        k = f.kernel(np.arange(lo, min(lo + 32, f.n)))
        close = np.nonzero(k >= 0.5)
        i.append(close[0] + lo)
        j.append(close[1])
        value.append(k[close])
    i, j, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (i, j, value))
    row = np.searchsorted(i, np.arange(f.n + 1))
    near = lambda x: np.bincount(i, value * x[j], f.n)
    a, b = near(toxic) / max(n_toxic, 1), near(clean) / max(n_clean, 1)
    left, picked = toxic.astype(float).copy(), []
    scale = 1 / max(n_toxic, 1)
    while len(picked) < LANDMARKS * 3 // 4:
        gain = near(left) * scale - 4 * b
        gain[(a < 8 * b) | np.isin(np.arange(f.n), picked)] = -1
        best = int(gain.argmax()) if f.n else 0
        if not f.n or gain[best] * max(n_toxic, 1) < 3:
            break
        picked.append(best)
        its = slice(row[best], row[best + 1])
        left[j[its]] *= 1 - np.minimum(value[its], 1)
    if not picked:
        return np.zeros(0, int), 0
    rival = np.where((clean > 0) & (b * 4 > a), f.kernel(np.array(picked)).max(0), 0)
    rivals = [i for i in np.argsort(-rival, kind="stable")[: LANDMARKS // 4] if rival[i] > 0]
    return np.array(picked + rivals), len(picked)


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by accelerated gradient descent; y is -1 or 1."""
    z = np.column_stack([x, np.ones(len(x))])
    reg = np.append(np.ones(x.shape[1]), 1e-3)
    step = 1 / (1 + 2 * c * np.linalg.eigvalsh((z * weight[:, None]).T @ z)[-1])
    w = v = np.zeros(z.shape[1])
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (z @ v))
        grad = reg * v - 2 * c * z.T @ (weight * y * slack)
        new = v - step * grad
        v = new + t / (t + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    rows = labels.select(F.col(id_col).cast("long").alias("_id"), F.col("toxic").cast("int").alias("_y")).filter(F.col("_id").isNotNull() & (T.crc_mod("_id", 5) != 0))
    one = lambda y: rows.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # At most 2 * sample rows, so one side of the join is small.
    chosen = F.broadcast(one(0).unionByName(one(1)))
    texts = cut_lineage(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("t")).join(chosen, "_id").select("_y", "t"))
    n = dict(map(tuple, texts.groupBy("_y").count().collect()))
    if not n.get(0) or not n.get(1):
        return Model()

    def words_of(batch):
        y = batch.column(0).to_numpy()
        for lo, hi, data, offsets in T.chunks(batch.column(1), CHUNK):
            t = Tokens(data, offsets)
            codes, at, first, back = t.distinct()
            pair = np.unique(back.astype(np.int64) * (hi - lo) + t.doc) if len(back) else np.zeros(0, np.int64)
            kind = y[lo + pair % (hi - lo)]
            a, b = (np.bincount(pair // (hi - lo), kind == k, len(at) - 1).astype(int) for k in (1, 0))
            letters = np.frombuffer((codes + 96).astype(np.uint8).tobytes(), np.uint8).tobytes().decode("latin-1")
            yield {"w": [letters[i:j] for i, j in zip(at[:-1], at[1:])], "a": a, "b": b}

    counted = T.arrow_map(texts, words_of, "w string, a long, b long").groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    lead = F.col("a") / n[1] - 2 * F.col("b") / n[0]
    top = counted.filter(F.length("w").between(3, 24)).orderBy(lead.desc(), "w").limit(TOKENS).collect()
    words = [r[0] for r in top]
    picked, n_toxic = choose([w.translate(_BACK) for w in words], np.array([r[1] for r in top]), np.array([r[2] for r in top]), n[1], n[0])
    if not len(picked):
        return Model()
    marks = dense(*as_codes([words[i].translate(_BACK) for i in picked]))

    # Documents stand for all labelled ones of their kind, of which they may be a sample.
    there = dict(map(tuple, rows.groupBy("_y").count().collect()))
    share = {kind: there[kind] / n[kind] for kind in (0, 1)}
    root = _root(marks)
    toxic_marks = np.arange(len(marks)) < n_toxic
    model, old = Model(marks, toxic_marks.astype(float)), None
    for _ in range(ROUNDS):
        # Of each document the sentence that the model so far finds worst.
        k, y = worst_sentences(texts, model, 4 * sample)
        seen = k.any(1)
        # Toxic documents in which nothing resembles a landmark teach nothing about sentences.
        use = seen | (y < 0)
        x, t = k[use], y[use]
        if old is not None:  # earlier hard negatives stay
            x, t = np.concatenate([x, old]), np.concatenate([t, np.full(len(old), -1.0)])
        hard = x[(t < 0) & x.any(1)]
        weight = np.where(t > 0, share[1], share[0])
        w, bias = svm(x @ root, t, weight / weight.sum() * 40)
        model, old = Model(marks, root @ w, bias), hard
    k, y = worst_sentences(texts, model, 4 * sample)
    model.slope, model.shift = platt(k @ model.weights + model.bias, y > 0, np.where(y > 0, share[1], share[0]))
    return model


def _root(marks: np.ndarray) -> np.ndarray:
    """Nyström map: inverse root of the landmarks' kernel matrix."""
    gram = marks @ marks.T
    gram[gram < FLOOR] = 0
    value, vector = np.linalg.eigh(gram + 1e-3 * np.eye(len(marks)))
    return vector @ np.diag(1 / np.sqrt(np.maximum(value, 0.05))) @ vector.T


def worst_sentences(texts: DataFrame, model: Model, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Similarities of each document's worst sentence (zeros: nothing near), and -1 or 1."""

    def examples(batch):
        y = batch.column(0).to_numpy()
        for lo, hi, data, offsets in T.chunks(batch.column(1), CHUNK):
            doc, k = sentences(Tokens(data, offsets), model.marks)
            best = np.zeros((hi - lo, len(model.marks)), np.float32)
            value = k @ model.weights
            order = np.argsort(value, kind="stable")
            order = order[value[order] > 0] if model.bias == 0 else order
            best[doc[order]] = k[order]
            top = np.full(hi - lo, -np.inf)
            np.maximum.at(top, doc, value)
            best[top < 0] = 0  # an untouched sentence scores more
            yield {"y": pa.array(y[lo:hi].astype(np.int32)), "k": list(best.astype(float))}

    got = T.arrow_map(texts, examples, "y int, k array<double>").orderBy("y", "k").limit(limit).toArrow()
    y = np.where(got["y"].to_numpy() == 1, 1.0, -1.0)
    return got["k"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), len(model.marks)), y


#: Counted words are written as code + 96; codes 27 to 31 become letters outside a-z.
_BACK = {96 + c: chr(next(x for x in range(0x430, 0x440) if 27 + x % 5 == c)) for c in range(27, 32)}


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic slope and shift of the score, by Newton steps."""
    a, b = 2.0, 0.0
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        miss, h = weight * (p - target), weight * p * (1 - p)
        g = np.array([(miss * margin).sum() + 1e-2 * (a - 2), miss.sum()])
        hess = np.array([[(h * margin**2).sum() + 1e-2, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        delta = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, b = a - delta[0], b - delta[1]
    return max(float(a), 0.1), float(b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), (T.crc_mod(id_col, 5) == 0).alias("held_out"), F.col(text_col).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batch):
        for lo, hi, data, offsets in T.chunks(batch.column(2), CHUNK):
            s = shared.value.score(data, offsets)
            yield {"doc_id": batch.column(0)[lo:hi], "held_out": batch.column(1)[lo:hi], "score": s, "predicted": pa.array((s >= 0.5).astype(np.int32))}

    return T.arrow_map(src, rate, "doc_id long, held_out boolean, score double, predicted int")
