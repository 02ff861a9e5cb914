"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on at most ``sample`` labelled documents, taken in hash
order of their ids (a documented bound). All trees are complete and lie in flat
arrays, so a batch of documents walks them with a few array operations. Scoring
covers every row. Null and empty texts have zero statistics and get a score.
Without labels every score is 0.5, so nothing is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgraph.llm import text as T

SAMPLE = 16_000
_MARKS = np.zeros(256, bool)
_MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)


def _distinct_share(doc: np.ndarray, hashes: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: share of distinct values, and share of the commonest value."""
    if not len(hashes):
        return np.zeros(n_docs), np.zeros(n_docs)
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(d)))
    total = np.maximum(np.bincount(doc, minlength=n_docs), 1)
    top = np.zeros(n_docs)
    np.maximum.at(top, d[starts], runs)
    return np.bincount(d[starts], minlength=n_docs) / total, top / total


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of document statistics per text of a chunk."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    w = T.Words(data, offsets)
    count = np.maximum(w.count, 1).astype(float)
    length = (w.ends - w.starts).astype(float)
    first, last = (data[w.starts], data[w.ends - 1]) if len(w.starts) else (np.zeros(0, np.uint8),) * 2
    per_word = lambda x: np.bincount(w.doc, x, n)
    row = np.repeat(np.arange(n), np.diff(offsets))
    hist = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256) / size[:, None]
    entropy = -(hist * np.log2(np.where(hist > 0, hist, 1))).sum(1)
    same = np.zeros(len(w.hashes), bool)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
    mean = per_word(length) / count
    at2, g2 = w.grams(2)
    at5, g5 = w.grams(5)
    lines = _per_row(data == 10, offsets) + 1
    mark = _MARKS[data]
    pair = np.zeros(len(data), bool)
    pair[1:] = mark[1:] & mark[:-1]
    cols = [
        np.log1p(w.count), mean, np.sqrt(np.maximum(per_word(length**2) / count - mean**2, 0)), *_distinct_share(w.doc, w.hashes, n), *_distinct_share(w.doc[at2], g2, n), *_distinct_share(w.doc[at5], g5, n),
        per_word(same.astype(float)) / count, hist[:, 65:91].sum(1), hist[:, 97:123].sum(1), hist[:, 48:58].sum(1), hist[:, 128:].sum(1), hist[:, _MARKS].sum(1), _per_row(pair, offsets) / size,
        hist[:, [33, 35, 36, 37, 38, 42]].sum(1), hist[:, 124], hist[:, [44, 46]].sum(1), hist[:, 32], entropy, count / lines, lines / size,
        per_word(_MARKS[last].astype(float)) / count, per_word(_MARKS[first].astype(float)) / count, per_word(((first >= 65) & (first < 91)).astype(float)) / count, per_word((length <= 2).astype(float)) / count, per_word((length == 1).astype(float)) / count,
    ]
    return np.column_stack(cols)


class Trees:
    """Complete trees in flat arrays: feature and threshold of node i, children 2i+1 and 2i+2."""

    def __init__(self, bias: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.bias, self.feature, self.threshold, self.leaf = bias, feature, threshold, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, l2: float = 2.0, least: float = 4.0) -> Trees:
    """Logistic loss, Newton leaves, best split per node from bin histograms."""
    if not len(y):
        return Trees(0.0, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 1)))
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)])
    margin = np.full(len(y), base)
    inner = 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for k in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            low, width = 2**level - 1, 2**level
            local = node - low
            best_gain = np.full(width, 1e-9)
            total_g, total_h = np.bincount(local, g, width), np.bincount(local, h, width)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = len(e) + 1
                at = local * b + binned[:, j]
                gl = np.bincount(at, g, width * b).reshape(width, b).cumsum(1)[:, :-1]
                hl = np.bincount(at, h, width * b).reshape(width, b).cumsum(1)[:, :-1]
                gr, hr = total_g[:, None] - gl, total_h[:, None] - hl
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - (total_g**2 / (total_h + l2))[:, None]
                gain[(hl < least * 0.25) | (hr < least * 0.25)] = 0
                cut = gain.argmax(1)
                top = gain[np.arange(width), cut]
                better = top > best_gain
                best_gain[better] = top[better]
                feature[k, low : low + width][better] = j
                threshold[k, low : low + width][better] = e[cut[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[k, node]] > threshold[k, node])
        at = node - inner
        leaf[k] = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
        margin += leaf[k][at]
    return Trees(base, feature, threshold, leaf)


def sample_labels(labels: DataFrame, label: str, id_col: str, m: int, held_out: int, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids outside the held-out fold, in hash order."""
    rows = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & (T.crc_mod("_id", m) != held_out))
    return rows.orderBy(F.xxhash64("_id"), "_id").limit(limit)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Trees:
    # The labels are bounded by ``sample``, so one side of the join is small.
    chosen = F.broadcast(sample_labels(labels, "quality", id_col, 3, 1, sample))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("t")).join(chosen, "_id").select("_id", "t", "_y")

    def measure(batch):
        for lo, hi, data, offsets in T.chunks(batch.column(1)):
            yield {"id": batch.column(0)[lo:hi], "y": batch.column(2)[lo:hi], "x": list(statistics(data, offsets))}

    got = T.arrow_map(rows, measure, "id long, y int, x array<double>").orderBy("id", "x").limit(sample).toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, 1)), np.zeros(0))
    x = np.array(got["x"].to_pylist(), float)
    return fit(x, got["y"].to_numpy().astype(float))


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", key: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of every row (and its key on request)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), (T.crc_mod(id_col, 3) == 1).alias("held_out"), T.row_key(id_col, text_col).alias("key"), F.col(text_col).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batch):
        for lo, hi, data, offsets in T.chunks(batch.column(3)):
            s = shared.value.score(statistics(data, offsets))
            yield {"doc_id": batch.column(0)[lo:hi], "held_out": batch.column(1)[lo:hi], "key": batch.column(2)[lo:hi], "score": s, "predicted": pa.array((s >= 0.5).astype(np.int32))}

    out = T.arrow_map(src, rate, "doc_id long, held_out boolean, score double, predicted int, key long")
    return out if key else out.drop("key")


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` predicted to be good, with all their columns."""
    from trailgraph.runtime import cut_lineage

    bad = cut_lineage(score(docs, train(docs, labels, id_col, text_col), id_col, text_col, key=True).filter("predicted = 0").select(F.col("key").alias("_poor_key")).distinct())
    return docs.withColumn("_poor_key", T.row_key(id_col, text_col)).join(bad, "_poor_key", "left_anti").select(*docs.columns)
