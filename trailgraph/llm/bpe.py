"""Byte-level BPE encoding and decoding through a table of distinct words.

1. ``word_table``: every text is split into the tokenizer's words inside Arrow
   tasks; distinct words are counted by Spark, each is encoded once, and its ids
   are turned back into bytes by a join with the id-to-piece table.
2. ``encode``: ids come back by position. Words up to ``head_words`` of the most
   frequent ones (each at most ``HEAD_CHARS`` long, so the size has a bound) are
   joined map-side; every other word is joined by a shuffle on the word and
   returns to its document by (document, position).

Null and empty texts have no ids. Rows that repeat give repeated results. A
special token's string inside a text is that token, as the tokenizer has it.
"""

from __future__ import annotations

import functools
import hashlib
import os
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgraph.llm import text as T
from trailgraph.runtime import cut_lineage

HEAD_WORDS = 1 << 22
HEAD_CHARS = 48
CHUNK = 1 << 19


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@functools.cache
def specials(path: str) -> tuple[str, ...]:
    return tuple(x.content for x in tokenizer(path).get_added_tokens_decoder().values())


@functools.cache
def char_class() -> np.ndarray:
    """Per code point: 0 other, 1 letter, 2 number, 3 white space."""
    kinds = {"L": 1, "N": 2}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)
    for lo, hi in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[lo : hi + 1] = 3
    return out


def split_words(data: np.ndarray, offsets: np.ndarray, marks: tuple[str, ...]):
    """(string, word borders, first word of each row, word hashes) of a chunk.

    The byte-level pattern as array operations: runs of letters, numbers, other
    marks or white space; one blank joins the run after it; the English
    contractions are words of their own; special tokens stand alone.
    """
    whole = data.tobytes().decode("utf-8")
    cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    n = len(cp)
    lead = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    rows = lead[offsets]
    border = np.zeros(n + 1, bool)
    border[rows] = True
    border[n] = True
    lone = []
    for mark in marks:
        at = whole.find(mark)
        while at >= 0:
            end = at + len(mark)
            if not border[at + 1 : end].any():
                border[at] = border[end] = True
                lone.append((at, end))
            at = whole.find(mark, end)
    if not n:
        return whole, np.zeros(1, np.int64), np.zeros(len(rows), np.int64), np.zeros(0, np.uint64)
    kind = char_class()[cp]
    start = border[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # White space right before a run of another kind in the same segment.
    last = np.flatnonzero((kind[:-1] == 3) & (kind[1:] != 3) & ~border[1:n])
    start[last] = True
    start[last[cp[last] == 32] + 1] = False
    # Contractions: a lone apostrophe that no blank joins, then s, t, m, d, re, ve or ll.
    p = np.flatnonzero((cp == 39) & start)
    p = p[p + 1 < n]
    p = p[start[p + 1] & (kind[p + 1] == 1) & ~border[p + 1]]
    a = cp[p + 1]
    b = np.where((p + 2 < n) & ~border[np.minimum(p + 2, n)], cp[np.minimum(p + 2, n - 1)], 0)
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    start[p[one | two] + 1] = False
    for q in (p[one] + 2, p[two] + 3):
        start[q[q < n]] = True
    for at, end in lone:
        start[at + 1 : end] = False
        start[at] = True
    starts = np.flatnonzero(start)
    hashes = T.word_hashes(cp, starts, np.append(starts[1:], n))
    return whole, np.append(starts, n), np.searchsorted(starts, rows), hashes


def _distinct(batch: pa.RecordBatch, marks: tuple[str, ...]):
    for _, _, data, offsets in T.chunks(batch.column(0), CHUNK):
        whole, at, _, hashes = split_words(data, offsets, marks)
        _, first, n = np.unique(hashes, return_index=True, return_counts=True)
        yield {"word": [whole[a:b] for a, b in zip(at[first].tolist(), at[first + 1].tolist())], "n": n}


def word_hash(words: pd.Series) -> np.ndarray:
    raw = [w.encode("utf-32-le") for w in words]
    ends = np.cumsum([len(x) // 4 for x in raw], dtype=np.int64)
    cp = np.frombuffer(b"".join(raw), np.uint32)
    return T.word_hashes(cp, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if len(raw) else np.zeros(0, np.uint64)


def piece_table(spark, path: str) -> DataFrame:
    """(id, piece_hex) for every id of the vocabulary, whose size is fixed."""
    tok = tokenizer(path)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    rows = []
    for word, i in tok.get_vocab(with_added_tokens=True).items():
        known = all(c in byte_of for c in word)
        rows.append((i, (bytes(byte_of[c] for c in word) if known else word.encode()).hex()))
    return spark.createDataFrame(rows, "id int, piece_hex string")


def decode(ids: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Bytes of each row's ``ids``: by..., ids, bytes (binary), through the id-to-piece join.

    ``by`` must tell rows apart. Rows without ids drop. Ids outside the
    vocabulary have no piece, as in the tokenizer.
    """
    pieces = F.broadcast(piece_table(ids.sparkSession, path))
    # The outer form: posexplode() would infer a filter on ``ids``, which pushed below the word count encodes every occurrence.
    each = ids.select(*by, F.posexplode_outer("ids").alias("_pos", "id")).join(pieces, "id", "left")
    each = each.filter("_pos is not null")
    ordered = F.sort_array(F.collect_list(F.struct("_pos", "id", F.coalesce("piece_hex", F.lit("")).alias("hex"))))
    out = each.groupBy(*by).agg(ordered.alias("_o"))
    return out.select(*by, F.transform("_o", lambda x: x["id"]).alias("ids"), F.unhex(F.array_join(F.transform("_o", lambda x: x["hex"]), "")).alias("bytes"))


def word_table(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """word, n, h (hash), id_text (ids joined by commas), n_ids, other; each distinct word is encoded once.

    ``other``: the bytes that its ids decode to, null where they are the word's own.
    """
    marks = specials(path)
    counted = T.arrow_map(docs.select(text_col), lambda b: _distinct(b, marks), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))

    @F.pandas_udf("ids array<int>, h long")
    def encoded(words: pd.Series) -> pd.DataFrame:
        ids = [e.ids for e in tokenizer(path).encode_batch(words.tolist(), add_special_tokens=False)]
        return pd.DataFrame({"ids": ids, "h": word_hash(words).view(np.int64)})

    coded = counted.withColumn("_e", encoded("word")).select("word", "n", F.col("_e.ids").alias("ids"), F.col("_e.h").alias("h"))
    back = decode(coded, path, ["word", "n", "h"])
    differs = F.when(F.col("bytes") != F.encode("word", "UTF-8"), F.col("bytes"))
    return cut_lineage(back.select("word", "n", "h", F.array_join("ids", ",").alias("id_text"), F.size("ids").alias("n_ids"), differs.alias("other")))


class Head:
    """Sorted word hashes with their ids, for the map-side join."""

    def __init__(self, table: pa.Table):
        h = table["h"].to_numpy().view(np.uint64)
        self.row = np.argsort(h).astype(np.int32)
        self.h = h[self.row]
        self.n_ids = table["n_ids"].to_numpy().astype(np.int32)
        other = table["other"]
        self.other = {int(i): other[int(i)].as_py() for i in np.flatnonzero(other.is_valid().to_numpy())}
        text = table["id_text"].cast(pa.large_binary()).combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        self.at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1].astype(np.uint32 if text.nbytes < 1 << 32 else np.int64) if len(text) else np.zeros(1, np.uint32)
        self.blob = text.buffers()[2].to_pybytes() if len(text) else b""

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where it isn't in the head."""
        if not len(self.h):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.h, hashes), len(self.h) - 1)
        return np.where(self.h[at] == hashes, self.row[at], -1)

    def count(self, rows: np.ndarray) -> np.ndarray:
        return np.where(rows >= 0, self.n_ids[rows], 0) if len(self.n_ids) else np.zeros(len(rows), np.int64)

    def ids(self, rows: np.ndarray) -> np.ndarray:
        """Ids of each row, joined by commas, as bytes."""
        out = np.empty(len(rows), object)
        out[:] = [self.blob[a:b] for a, b in zip(self.at[rows].tolist(), self.at[rows + 1].tolist())] if len(self.n_ids) else b""
        return out


def head_of(words: DataFrame, limit: int) -> Head:
    """The most frequent words, as many whole frequency classes as fit ``limit`` rows."""
    short = words.filter(F.length("word") <= HEAD_CHARS).withColumn("_c", F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int"))
    sizes = sorted((tuple(r) for r in short.groupBy("_c").count().collect()), reverse=True)
    total, cut = 0, None
    for c, n in sizes:
        total += n
        if total > limit:
            break
        cut = c
    clash = [r[0] for r in words.groupBy("h").count().filter("count > 1").select("h").collect()]
    head = short.filter(F.col("_c") >= F.lit(cut)) if cut is not None else short.limit(0)
    if clash:
        head = head.filter(~F.col("h").isin(clash))
    return Head(head.select("h", "id_text", "n_ids", "other").toArrow())


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"
FULL = ", ids string, decoded string"


def _finish(doc_id, ids: list[bytes], n_ids, text: bytes, full: bool) -> tuple:
    joined, raw = b",".join(ids), text.decode("utf-8", "replace")
    body = raw.encode()
    row = (doc_id, int(n_ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(body).hexdigest(), len(body))
    return (*row, joined.decode(), raw) if full else row


def _decoded(whole: str, at: np.ndarray, a: int, b: int, other: dict[int, bytes]) -> bytes:
    """Words a..b as their ids decode; ``other`` by word."""
    if not other:
        return whole[at[a] : at[b]].encode()
    return b"".join(other.get(j) or whole[at[j] : at[j + 1]].encode() for j in range(a, b))


def _names(full: bool) -> list[str]:
    return [x.split()[0] for x in (OUT + FULL * full).split(", ")]


def _encode_batch(batch: pa.RecordBatch, marks: tuple[str, ...], head: Head, full: bool):
    names = _names(full)
    keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for lo, hi, data, offsets in T.chunks(batch.column(2), CHUNK):
        whole, at, first, hashes = split_words(data, offsets, marks)
        uniq, back = np.unique(hashes, return_inverse=True)
        found = head.find(uniq)
        id_text = head.ids(found)
        counts = np.concatenate([[0], np.cumsum(head.count(found)[back])])
        missing = np.concatenate([[0], np.cumsum((found < 0)[back])])
        rows, keep = [], {"key": [], "done": [], "packed": [], "tail": []}
        for i in range(hi - lo):
            a, b = int(first[i]), int(first[i + 1])
            done = missing[a] == missing[b]
            keep["key"].append(keys[lo + i])
            keep["done"].append(bool(done))
            if done:
                other = {j: head.other[r] for j, r in enumerate(found[back[a:b]].tolist(), a) if r in head.other} if head.other else {}
                rows.append(_finish(ids[lo + i], id_text[back[a:b]].tolist(), counts[b] - counts[a], _decoded(whole, at, a, b, other), full))
                keep["packed"].append(None)
                keep["tail"].append(None)
            else:
                rows.append((ids[lo + i], *[None] * (len(names) - 1)))
                keep["packed"].append(zstandard.ZstdCompressor(level=1).compress(data[offsets[i] : offsets[i + 1]].tobytes()))
                gone = a + np.flatnonzero(found[back[a:b]] < 0)
                keep["tail"].append([{"pos": int(j - a), "word": whole[at[j] : at[j + 1]]} for j in gone])
        yield keep | dict(zip(names, map(list, zip(*rows))))


def _close_batch(batch: pa.RecordBatch, marks: tuple[str, ...], head: Head, full: bool):
    for doc_id, packed, tail in zip(*(batch.column(i).to_pylist() for i in range(3))):
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
        whole, at, _, hashes = split_words(data, np.array([0, len(data)]), marks)
        uniq, back = np.unique(hashes, return_inverse=True)
        rows = head.find(uniq)
        id_text, n = head.ids(rows)[back], int(head.count(rows)[back].sum())
        other = {j: head.other[r] for j, r in enumerate(rows[back].tolist()) if r in head.other} if head.other else {}
        for x in tail:
            id_text[x["pos"]] = x["id_text"].encode()
            n += x["n_ids"]
            if x["other"] is not None:
                other[x["pos"]] = x["other"]
        yield {k: [v] for k, v in zip(_names(full), _finish(doc_id, id_text.tolist(), n, _decoded(whole, at, 0, len(at) - 1, other), full))}


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS, full: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes; with ``full`` also ids (joined by commas) and the decoded text."""
    spark = docs.sparkSession
    src = docs.select(T.row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words, marks = word_table(src, path), specials(path)
    head = spark.sparkContext.broadcast(head_of(words, head_words))
    out = OUT + FULL * full
    state = "key long, done boolean, packed binary, tail array<struct<pos:int,word:string>>, "
    first = cut_lineage(T.arrow_map(src, lambda b: _encode_batch(b, marks, head.value, full), state + out))
    names = _names(full)
    done = first.filter("done").select(*names)
    rest = first.filter(~F.col("done"))
    if rest.isEmpty():
        return done
    # Repeated rows share a key and would bring each position more than once.
    places = rest.select("key", F.explode("tail").alias("t")).select("key", "t.pos", "t.word").join(words.select("word", "id_text", "n_ids", "other"), "word")
    back = places.groupBy("key").agg(F.collect_set(F.struct("pos", "id_text", "n_ids", "other")).alias("tail"))
    closed = rest.select("key", "doc_id", "packed").join(back, "key").select("doc_id", "packed", "tail")
    return done.unionByName(T.arrow_map(closed, lambda b: _close_batch(b, marks, head.value, full), out))
