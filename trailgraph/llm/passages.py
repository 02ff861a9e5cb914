"""Removal of repeated passages with anchors, confirmed windows and Aho-Corasick automata.

A window is ``window`` consecutive words. Texts with equal word sequences are one
class and only its head is worked on.

1. Anchors: every window selects its leftmost smallest k-gram hash. Equal windows
   select equal anchors, so a window can only recur if its anchor does; anchors
   are counted with map-side combining, however frequent one is.
2. Confirm: windows with a recurring anchor are counted by their own hash.
3. Locate: the confirmed windows of each block of documents are merged into
   maximal passages and compiled, block by block (the shards), into an automaton;
   all candidate documents of the block stream through it, and every occurrence
   is removed.

A document without a recurring anchor holds no passage and is done in step 1.
Null and empty texts have no words. Repeated rows count as copies and give
repeated results. Null ids are told apart by their texts.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgraph.llm import text as T
from trailgraph.runtime import cut_lineage

WINDOW = 35
GRAM = 10
BLOCK = 1 << 18  # bytes of text per automaton
_SEED = np.uint64(0x0F0F0F0F0F0F0F0F)


def windows(w: T.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start word, place of the anchor, anchor hash) of every window inside one document."""
    n = len(w.hashes)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - gram + 1)
    g = T.span_hash(w.hashes, at, at + gram)
    start = np.flatnonzero(w.doc[: n - window + 1] == w.doc[window - 1 :])
    span = window - gram + 1
    place = np.empty(len(start), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, span)
    for lo in range(0, len(start), 1 << 16):
        part = start[lo : lo + (1 << 16)]
        place[lo : lo + len(part)] = part + view[part].argmin(1)
    return start, place, g[place]


def _members(batch: pa.RecordBatch):
    for lo, hi, data, offsets in T.chunks(batch.column(1)):
        w = T.Words(data, offsets)
        a = T.word_hashes(w.hashes, w.first[:-1], w.first[1:])
        b = T.word_hashes(T.mix(w.hashes ^ _SEED), w.first[:-1], w.first[1:])
        yield {"node": batch.column(0)[lo:hi], "n": w.count, "a": a.view(np.int64), "b": b.view(np.int64)}


def _anchors(batch: pa.RecordBatch, window: int, gram: int):
    nodes = batch.column(0).to_numpy()
    for lo, _, data, offsets in T.chunks(batch.column(1)):
        w = T.Words(data, offsets)
        _, place, h = windows(w, window, gram)
        place, first = np.unique(place, return_index=True)
        doc, h = w.doc[place], h[first]
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
        yield {"anchor": h[new].view(np.int64), "node": nodes[lo + doc[new]], "n": np.diff(np.append(new, len(h)))}


RESULT = "node long, n_words long, n_removed long, kept_sha256 string"


def _kept(data: np.ndarray, w: T.Words, gone: np.ndarray | None) -> tuple[int, int, str, str]:
    words = [data[a:b].tobytes() for a, b in zip(w.starts.tolist(), w.ends.tolist())]
    kept = words if gone is None else [x for x, g in zip(words, gone.tolist()) if not g]
    body = b" ".join(kept)
    return len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest(), body


def _split(batch: pa.RecordBatch, full: bool):
    """Documents without a recurring anchor are done; the others are packed."""
    nodes, anchors, twins = (batch.column(i).to_pylist() for i in (0, 2, 3))
    out = {k: [] for k in ("node", "n_words", "n_removed", "kept_sha256", "packed", "anchors", "kept", "twin")}
    for lo, hi, data, offsets in T.chunks(batch.column(1)):
        for i in range(hi - lo):
            d = data[offsets[i] : offsets[i + 1]]
            row = [nodes[lo + i], None, None, None, None, None, None, twins[lo + i]]
            if anchors[lo + i] is None:
                n, gone, sha, body = _kept(d, T.Words(d, np.array([0, len(d)])), None)
                row[1:4] = n, gone, sha
                row[6] = body.decode() if full else None
            else:
                row[4] = zstandard.ZstdCompressor(level=1).compress(d.tobytes())
                row[5] = np.array(anchors[lo + i], np.int64).tobytes()
            for k, v in zip(out, row):
                out[k].append(v)
    yield out


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)


def _candidates(batch: pa.RecordBatch, window: int, gram: int):
    """Windows with a recurring anchor: hash, node, start, twin."""
    for node, packed, anchors, twin in zip(*(batch.column(i).to_pylist() for i in range(4))):
        d = _unpack(packed)
        w = T.Words(d, np.array([0, len(d)]))
        start, _, h = windows(w, window, gram)
        start = start[np.isin(h, np.frombuffer(anchors, np.uint64))]
        if len(start):
            yield {"h": T.span_hash(w.hashes, start, start + window).view(np.int64), "node": np.full(len(start), node), "start": start.astype(np.int32), "twin": np.full(len(start), twin)}


def _locate(batch: pa.RecordBatch, window: int, full: bool):
    """Compile the confirmed passages of each block and stream its documents through the automaton."""
    nodes, packs, starts = (batch.column(i).to_pylist() for i in range(3))
    block, size = [], 0
    for row in zip(nodes, packs, starts):
        d = _unpack(row[1])
        block.append((row[0], d, row[2]))
        size += len(d)
        if size >= BLOCK:
            yield _block(block, window, full)
            block, size = [], 0
    if block:
        yield _block(block, window, full)


def _block(block: list, window: int, full: bool) -> dict:
    texts, patterns = [], ahocorasick.Automaton()
    for _, d, starts in block:
        w = T.Words(d, np.array([0, len(d)]))
        words = [d[a:b].tobytes().decode() for a, b in zip(w.starts.tolist(), w.ends.tolist())]
        texts.append((w, " " + " ".join(words) + " ", np.cumsum([0, *(len(x) + 1 for x in words)])))
        if starts:
            at = np.sort(np.array(starts))
            cut = np.flatnonzero(np.diff(at) > 1) + 1  # windows that follow each other are one passage
            for run in np.split(at, cut):
                a, b = int(run[0]), int(run[-1]) + window
                passage = " " + " ".join(words[a:b]) + " "
                patterns.add_word(passage, (len(passage), b - a))
    if len(patterns):
        patterns.make_automaton()
    out = {k: [] for k in ("node", "n_words", "n_removed", "kept_sha256", "kept")}
    for (node, d, _), (w, text, border) in zip(block, texts):
        gone = np.zeros(len(w.starts) + 1, np.int64)
        if len(patterns):
            for end, (chars, n) in patterns.iter(text):
                first = int(np.searchsorted(border, end - chars + 1))
                gone[first] += 1
                gone[first + n] -= 1
        n, removed, sha, body = _kept(d, w, np.cumsum(gone[:-1]) > 0)
        for k, v in zip(out, (node, n, removed, sha, body.decode() if full else None)):
            out[k].append(v)
    return out


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, full: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; with ``full`` also the kept text."""
    rows = docs.select(T.ident(id_col, text_col).alias("node"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    sizes = cut_lineage(T.arrow_map(rows.select("node", "t"), _members, "node long, n long, a long, b long"))
    classes = sizes.groupBy("a", "b", "n").agg(F.min("node").alias("class"), F.count("*").alias("copies")).filter("copies > 1")
    copies = cut_lineage(sizes.join(classes, ["a", "b", "n"]).select("node", "class", "n").distinct())
    heads = rows.select("node", "t").join(copies.filter("node <> class").select("node"), "node", "left_anti")

    anchors = T.arrow_map(heads, lambda b: _anchors(b, window, gram), "anchor long, node long, n long")
    twice = copies.filter("node = class").select("node", F.lit(True).alias("twin"))  # all windows of these recur
    weighed = anchors.join(twice, "node", "left").select("anchor", "node", F.when(F.col("twin"), F.greatest("n", F.lit(2))).otherwise(F.col("n")).alias("n"))
    recurring = weighed.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    per_doc = anchors.select("anchor", "node").join(recurring, "anchor").groupBy("node").agg(F.collect_set("anchor").alias("anchors"))
    state = RESULT + ", packed binary, anchors binary, kept string, twin boolean"
    known = heads.join(per_doc, "node", "left").join(twice, "node", "left").select("node", "t", "anchors", F.coalesce("twin", F.lit(False)).alias("twin"))
    first = cut_lineage(T.arrow_map(known, lambda b: _split(b, full), state))
    # Rows repeated with id and text are copies of each other and still one head.
    first = first.filter("not twin").unionByName(first.filter("twin").dropDuplicates(["node"]))
    packed = first.filter("packed is not null")
    spots = T.arrow_map(packed.select("node", "packed", "anchors", "twin"), lambda b: _candidates(b, window, gram), "h long, node long, start int, twin boolean")
    confirmed = spots.groupBy("h").agg(F.sum(F.when(F.col("twin"), 2).otherwise(1)).alias("n")).filter("n > 1").select("h")
    where = spots.select("h", "node", "start").join(confirmed, "h").groupBy("node").agg(F.collect_set("start").alias("starts"))
    found = T.arrow_map(packed.select("node", "packed").join(where, "node", "left"), lambda b: _locate(b, window, full), RESULT + ", kept string")
    done = first.filter("packed is null").select("node", "n_words", "n_removed", "kept_sha256", "kept").unionByName(found)
    out = rows.select("node", "doc_id").join(copies.select("node", "class"), "node", "left").withColumn("class", F.coalesce("class", "node")).join(done.withColumnRenamed("node", "class"), "class")
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if full else []))
