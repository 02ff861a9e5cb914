"""Language-model scores by a hidden Markov model over word classes.

Counts. Every task hashes the words of its texts; Spark sums them into a table
(word hash, suffix class, count) of all training documents. Words are told apart
by a 64-bit hash.

Model. Hidden states emit classes. The commonest OWN - 1 words are classes of
their own, class 0 is the end of a text, all other words, unknown ones too, are
tied by their last three bytes into TIED classes. Inside a tied class a word has
its share (c + 0.1) / (sum over the class of (c + 0.1) + 0.1); the last 0.1 is
the class's unknown word. So emission tables have a fixed size at every scale,
while each word keeps a probability of its own, and the model is a distribution
over all texts. The rule is the same at every size of the corpus.

Training. Starting values are fixed random shifts of the corpus's distribution;
ROUNDS Baum-Welch rounds follow, each over all training documents. In a round
each task runs the scaled forward-backward recursion over its texts and emits
expected counts; Spark sums them by class and state.

Scores. One scaled forward recursion per text gives the exact likelihood of its
class sequence; the shares of its words complete it. Words among the HEAD
commonest are looked up in a broadcast table of that bound; the others of a text
are joined with the count table by a shuffle and come back as one sum a text.

Long texts are worked through in segments of at most SEGMENT tokens, so memory
stays bounded. Null and empty texts are one end token. Repeated rows give
repeated results, all training rows count. Without training documents every
state has the even distribution. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgraph.llm import text as T
from trailgraph.runtime import cut_lineage

OWN = 1 << 15
TIED = 1 << 15
CLASSES = OWN + TIED
HEAD = 1 << 20
STATES = 8
ROUNDS = 8
SEGMENT = 1 << 19
#: Weight of the even distribution in transitions and starts.
BLEND = 0.01
#: Added to every count, as in the base score.
ADD = 0.1


def suffix_class(words: T.Words) -> np.ndarray:
    size = np.minimum(words.ends - words.starts, 3)
    code = size.astype(np.uint64)
    for k in range(3):
        byte = words.data[np.maximum(words.ends - 1 - k, words.starts)].astype(np.uint64)
        code = code << np.uint64(8) | np.where(k < size, byte, 0).astype(np.uint64)
    return (T.mix(code + np.uint64(1)) % np.uint64(TIED)).astype(np.int32)


def _count_batch(batch: pa.RecordBatch):
    for _, _, data, offsets in T.chunks(batch.column(0)):
        words = T.Words(data, offsets, lower=True)
        h, first, n = np.unique(words.hashes, return_index=True, return_counts=True)
        yield {"h": h.view(np.int64), "c": suffix_class(words)[first], "n": n}


def counts(texts: DataFrame) -> DataFrame:
    """h (word hash), c (suffix class), n of all words of ``text``."""
    return T.arrow_map(texts.select("text"), _count_batch, "h long, c int, n long").groupBy("h").agg(F.min("c").alias("c"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The head of the count table as sorted arrays, and what the classes weigh."""

    total: int
    types: int
    texts: int
    h: np.ndarray
    n: np.ndarray
    cls: np.ndarray
    mass: np.ndarray

    @property
    def log_base(self) -> float:
        return float(np.log10(self.total + ADD * (self.types + 1)))

    def prior(self) -> np.ndarray:
        return self.mass / self.mass.sum()

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash in the head, -1 elsewhere."""
        if not len(self.h):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.h, hashes), len(self.h) - 1)
        return np.where(self.h[at] == hashes, at, -1)


def vocabulary(words: DataFrame, texts: int) -> Vocabulary:
    """From the count table; at most HEAD rows and the class sums come to the driver."""
    size = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    room, cut = HEAD, None
    for step, n in sorted((tuple(r) for r in words.groupBy(size).count().collect()), reverse=True):
        room -= n
        if room < 0:
            break
        cut = step
    head = words.filter(size >= F.lit(cut)).select("h", "c", "n").toArrow() if cut is not None else None
    h, c, n = (head[x].to_numpy() for x in ("h", "c", "n")) if head is not None else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))
    h = h.view(np.uint64)
    own = np.lexsort((h, -n))[: OWN - 1]
    cls = (c + OWN).astype(np.uint16)
    cls[own] = np.arange(1, len(own) + 1)
    mass = np.full(CLASSES, 0.0)
    mass[0] = texts + ADD
    mass[1 : len(own) + 1] = n[own] + ADD
    mass[OWN:] = ADD
    total, types = texts, int(texts > 0)
    for k, k_n, k_types in words.groupBy("c").agg(F.sum("n"), F.count("*")).collect():
        mass[OWN + k] += k_n + ADD * k_types
        total, types = total + k_n, types + k_types
    np.subtract.at(mass, OWN + c[own], n[own] + ADD)
    order = np.argsort(h)
    return Vocabulary(total, types, texts, h[order], n[order], cls[order], np.where(np.arange(CLASSES) < OWN, mass, np.maximum(mass, ADD)))


ENCODED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, own_log double, known_log double, mass_log double, classes binary, tail array<struct<h:long,n:long>>"


def _encode_batch(batch: pa.RecordBatch, v: Vocabulary):
    log_n = np.log10(v.n + ADD)
    log_mass = np.log10(np.where(v.mass > 0, v.mass, 1))
    for lo, hi, data, offsets in T.chunks(batch.column(3)):
        words, rows = T.Words(data, offsets, lower=True), hi - lo
        uniq, back = np.unique(words.hashes, return_inverse=True)
        at = v.find(uniq)[back]
        known = at >= 0
        cls = (OWN + suffix_class(words)).astype(np.uint16)
        cls[known] = v.cls[at[known]]
        tied = cls >= OWN
        log_c = np.zeros(len(cls))
        log_c[known] = log_n[at[known]]
        by_row = lambda x: np.bincount(words.doc, x, rows)
        ends = words.first[1:] + np.arange(1, rows + 1)
        full = np.zeros(len(cls) + rows, np.uint16)
        full[np.arange(len(cls)) + words.doc] = cls
        packed = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.concatenate([[0], ends * 2]).astype(np.int32)), pa.py_buffer(full)])
        tail: list[list[dict]] = [[] for _ in range(rows)]
        gone = np.flatnonzero(~known)
        if len(gone):
            pairs, n = np.unique(np.stack([words.doc[gone].astype(np.uint64), words.hashes[gone]]), axis=1, return_counts=True)
            for d, h, k in zip(pairs[0].tolist(), pairs[1].view(np.int64).tolist(), n.tolist()):
                tail[d].append({"h": h, "n": k})
        end_log = np.log10(v.texts + ADD)
        yield {
            "uid": batch.column(0)[lo:hi], "doc_id": batch.column(1)[lo:hi], "held_out": batch.column(2)[lo:hi],
            "n_tokens": words.count + 1, "n_known": by_row(known.astype(float)).astype(np.int64) + (v.texts > 0),
            "own_log": by_row(np.where(tied, 0.0, log_c)) + end_log, "known_log": by_row(np.where(tied, log_c, 0.0)), "mass_log": by_row(np.where(tied, log_mass[cls], 0.0)),
            "classes": packed, "tail": tail,
        }


def encode(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text", mod: int = 10) -> DataFrame:
    """Texts as class sequences, written: ENCODED.

    own_log: log10(c + 0.1) summed over words with a class of their own and the
    end; known_log: the same over tied words of the head, so those of ``tail``
    are still to come; mass_log: log10 of the class sums of all tied words.
    """
    share = docs.sparkSession.sparkContext.broadcast(v)
    src = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), (T.crc_mod(id_col, mod) == 0).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return cut_lineage(T.arrow_map(src, lambda b: _encode_batch(b, share.value), ENCODED))


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    def cast(self, kind) -> "Model":
        return Model(self.start.astype(kind), self.step.astype(kind), self.emit.astype(kind))


class Pack:
    """Class sequences side by side: position t of every longer text is one slice."""

    def __init__(self, texts: list[np.ndarray]):
        size = np.array([len(x) for x in texts])
        self.order = np.argsort(-size, kind="stable")
        size = size[self.order]
        self.active = len(texts) - np.cumsum(np.bincount(size))[:-1]
        self.off = np.concatenate([[0], np.cumsum(self.active)])
        doc = np.repeat(np.arange(len(texts)), size)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
        self.cls = np.empty(len(doc), np.uint16)
        self.cls[self.off[at] + doc] = np.concatenate([texts[i] for i in self.order])

    def segments(self) -> list[tuple[int, int]]:
        """Ranges of steps of at most SEGMENT tokens, or one step."""
        out, lo, last = [], 0, len(self.active)
        while lo < last:
            hi = max(lo + 1, int(np.searchsorted(self.off, self.off[lo] + SEGMENT, "right")) - 1)
            out.append((lo, min(hi, last)))
            lo = out[-1][1]
        return out


def forward(m: Model, p: Pack, lo: int, hi: int, before: np.ndarray | None):
    """Scaled forward recursion over steps lo..hi: state shares, scales, emissions."""
    base = p.off[lo]
    emit = m.emit[p.cls[base : p.off[hi]]]
    state, scale, ones = np.empty_like(emit), np.empty(len(emit), emit.dtype), np.ones(emit.shape[1], emit.dtype)
    bounds = (p.off[lo : hi + 1] - base).tolist()
    for a, b in zip(bounds, bounds[1:]):
        x, z = state[a:b], scale[a:b]
        if before is None:
            np.multiply(emit[a:b], m.start, out=x)
        else:
            np.matmul(before[: b - a], m.step, out=x)
            x *= emit[a:b]
        np.matmul(x, ones, out=z)
        x /= z[:, None]
        before = x
    return state, scale, emit


def log_likelihoods(m: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each class sequence."""
    p, before = Pack(texts), None
    out = np.zeros(len(texts))
    for lo, hi in p.segments():
        state, scale, _ = forward(m, p, lo, hi, before)
        before = state[p.off[hi - 1] - p.off[lo] :].copy()
        doc = np.arange(len(scale)) - np.repeat(p.off[lo:hi] - p.off[lo], p.active[lo:hi])
        out += np.bincount(doc, np.log10(scale), len(texts))
    back = np.empty(len(texts))
    back[p.order] = out
    return back


class Expected:
    """Expected counts of starts, transitions and emissions."""

    def __init__(self, states: int):
        self.start, self.step, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES, states))

    def add(self, m: Model, texts: list[np.ndarray]) -> None:
        """Forward over all segments, keeping their borders, then backward from the last one."""
        p, before, borders = Pack(texts), None, []
        parts = p.segments()
        for lo, hi in parts:
            borders.append(before)
            kept = forward(m, p, lo, hi, before)
            before = kept[0][p.off[hi - 1] - p.off[lo] :].copy()
        after = np.zeros((0, len(self.start)), m.step.dtype)
        for (lo, hi), border in zip(reversed(parts), reversed(borders)):
            state, scale, emit = kept if kept is not None else forward(m, p, lo, hi, border)
            kept = None
            base, flow = p.off[lo], np.zeros((len(self.start),) * 2)
            bounds = (p.off[lo : hi + 1] - base).tolist()
            share = np.ones_like(state)
            for a, b in zip(reversed(bounds[:-1]), reversed(bounds[1:])):
                n = len(after)
                if n:
                    flow += state[a : a + n].T @ after
                    np.matmul(after, m.step.T, out=share[a : a + n])
                after = emit[a:b]
                after *= share[a:b]
                after /= scale[a:b, None]
            after = after.copy()
            state *= share
            self.step += flow * m.step
            if lo == 0:
                self.start += state[: bounds[1]].sum(0)
            cls = p.cls[base : p.off[hi]]
            for k in range(len(self.start)):
                self.emit[:, k] += np.bincount(cls, state[:, k], CLASSES)


def groups(packed: pa.Array):
    """(rows, class sequences) of similar length and at most SEGMENT tokens."""
    texts = [np.frombuffer(x.as_py(), np.uint16) for x in packed]
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        stop, total = at, 0
        while stop < len(order) and (stop == at or total + len(texts[order[stop]]) <= SEGMENT):
            total += len(texts[order[stop]])
            stop += 1
        yield order[at:stop], [texts[i] for i in order[at:stop]]
        at = stop


def _round(encoded: DataFrame, model: Model, prior: np.ndarray) -> Model:
    """One Baum-Welch round over all rows; sums of a fixed size come to the driver."""
    states = len(model.start)
    share = encoded.sparkSession.sparkContext.broadcast(model.cast(np.float32))
    names = [f"e{k}" for k in range(states)]
    schema = T.arrow_schema("row int, " + ", ".join(f"{n} double" for n in names))

    def expected(batches):
        out = Expected(states)
        for batch in batches:
            for _, texts in groups(batch.column(0)):
                out.add(share.value, texts)
        table = np.vstack([out.emit, out.step, out.start[None]])
        used = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(table[used, k]) for k in range(states))], schema=schema)

    sums = encoded.select("classes").mapInArrow(expected, ", ".join(["row int", *(f"{n} double" for n in names)])).groupBy("row").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    table = np.zeros((CLASSES + states + 1, states))
    table[sums["row"].to_numpy()] = np.stack([sums[n].to_numpy() for n in names], 1)
    share.unpersist()
    return estimate(table[:CLASSES], table[CLASSES:-1], table[-1], prior)


def estimate(emit: np.ndarray, step: np.ndarray, start: np.ndarray, prior: np.ndarray) -> Model:
    """Probabilities from expected counts.

    A state's emissions are blended with the corpus's distribution by the share
    of new classes among its draws (Witten-Bell), transitions with the even one.
    """

    def blend(counts, with_, weight):
        total = counts.sum(-1, keepdims=True)
        return (1 - weight) * np.divide(counts, total, out=np.broadcast_to(with_, counts.shape).copy(), where=total > 0) + weight * with_

    emit = emit.T
    types = np.minimum(emit, 1).sum(1, keepdims=True)
    fresh = np.divide(types, emit.sum(1, keepdims=True) + types, out=np.ones_like(types), where=types > 0)
    return Model(blend(start, 1 / len(start), BLEND), blend(step, 1 / len(start), BLEND), np.ascontiguousarray(blend(emit, prior, fresh).T))


def first_model(prior: np.ndarray, states: int, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    emit = prior[:, None] * np.exp(rng.normal(0, 0.5, (len(prior), states)))
    step = np.full((states, states), 0.3 / states) + np.eye(states) * 0.7
    return Model(np.full(states, 1 / states), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def train(encoded: DataFrame, v: Vocabulary, states: int = STATES, rounds: int = ROUNDS, sample_rounds: int = 0) -> Model:
    """Baum-Welch rounds, each over all training rows.

    ``sample_rounds``: further rounds; the name is kept for callers, no round reads a sample.
    """
    model, prior = first_model(v.prior(), states), v.prior()
    if not v.texts:
        return model
    rows = encoded.filter("not held_out")
    for _ in range(sample_rounds + rounds):
        model = _round(rows, model, prior)
    return model


def _score_batch(batch: pa.RecordBatch, m: Model):
    out = np.zeros(batch.num_rows)
    for rows, texts in groups(batch.column(batch.num_columns - 1)):
        out[rows] = log_likelihoods(m, texts)
    yield {name: batch.column(i) for i, name in enumerate(batch.schema.names[:-1])} | {"hidden": out}


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 10, **training) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(id as text) mod ``mod`` isn't 0.
    """
    learn = docs.filter(T.crc_mod(id_col, mod) != 0).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = cut_lineage(counts(learn))
    v = vocabulary(words, learn.count())
    encoded = encode(docs, v, id_col, text_col, mod)
    model = train(encoded, v, **training)
    share = docs.sparkSession.sparkContext.broadcast(model)
    columns = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, own_log double, known_log double, mass_log double"
    hidden = T.arrow_map(encoded.select(*(x.split()[0] for x in columns.split(", ")), "classes"), lambda b: _score_batch(b, share.value), columns + ", hidden double")
    rare = encoded.select("uid", F.explode("tail").alias("t")).select("uid", "t.h", "t.n").join(words.select("h", F.col("n").alias("c")), "h", "left")
    seen = F.coalesce(F.col("c"), F.lit(0))
    more = rare.groupBy("uid").agg(F.sum(F.col("n") * F.log10(seen + F.lit(ADD))).alias("more_log"), F.sum(F.when(seen > 0, F.col("n")).otherwise(0)).alias("more_known"))
    j = hidden.join(more, "uid", "left")
    extra = F.coalesce("more_log", F.lit(0.0))
    return j.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("own_log") + F.col("known_log") + extra - F.col("n_tokens") * F.lit(v.log_base)).alias("base_score"),
        (F.col("hidden") + F.col("known_log") - F.col("mass_log") + extra).alias("score"),
    )
