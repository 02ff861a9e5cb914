"""Vectorised text scanning shared by the operators that run in Arrow tasks.

A task turns a bounded chunk of documents into numpy arrays once: bytes, word
borders, word hashes. All hashes are 64-bit, fixed by constants here, so every
executor and every retry gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once; one longer document is a chunk of its own.
CHUNK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Never-null row identity: rows that repeat share it, and give equal results."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def ident(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The id, or a negative number made from the text where the id is null."""
    return F.coalesce(F.col(id_col).cast("long"), -(F.shiftrightunsigned(F.xxhash64(F.col(text_col)), 2) + F.lit(1)))


def crc_mod(id_col: str, m: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(m))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, inverse: bool = False) -> np.ndarray:
    name = "inverse" if inverse else "base"
    have = _powers.get(name)
    if have is None or len(have) < n:
        step = np.full(max(n, CHUNK + 1), _INVERSE if inverse else _BASE, np.uint64)
        step[0] = 1
        have = _powers[name] = np.multiply.accumulate(step)
    return have[:n]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for every span, from one prefix sum.

    For a few values of high entropy, such as the hashes of a phrase's words;
    long spans of letters or words take ``word_hashes``.
    """
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(len(values) + 1, inverse=True)[starts] + (ends - starts).astype(np.uint64))


def word_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span: a sum over values mixed with their place in the span.

    Not a polynomial, whose values agree on some long regular strings.
    """
    size = ends - starts
    out = size.astype(np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        size = size[full]
        first = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(first, size)
        value = values[np.repeat(starts[full], size) + inside].astype(np.uint64)
        out[full] += np.add.reduceat(mix(value + (inside.astype(np.uint64) + np.uint64(1)) * _BASE), first)
    return mix(out)


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of bounded runs of rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = pa.concat_arrays([texts.fill_null("")]) if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    all_offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(all_offsets, all_offsets[at] + limit, "right")) - 1)
        lo, hi = all_offsets[at], all_offsets[stop]
        yield at, stop, data[lo:hi], all_offsets[at : stop + 1] - lo
        at = stop


class Words:
    """Words of a chunk, split at the six ASCII white spaces or other bytes (``space``); A-Z lowered on request.

    starts/ends: byte borders; doc: row inside the chunk; first: index of each
    row's first word (one longer than the rows); hashes: of the words' bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = _SPACE):
        self.data = data = _LOWER[data] if lower else data
        n = len(data)
        solid = ~space[data]
        border = np.zeros(n + 1, bool)
        border[offsets] = True
        begin, end = solid.copy(), solid.copy()
        if n:
            begin[1:] &= ~solid[:-1] | border[1:n]
            end[:-1] &= ~solid[1:] | border[1:n]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        self.hashes = word_hashes(data, self.starts, self.ends)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(start word, hash) of every run of k words inside one document."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        return at, span_hash(self.hashes, at, at + k)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with ``fn(batch) -> iterable of dicts of columns``."""
    target = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for out in fn(batch):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in ((f, out[f.name]) for f in target)], schema=target)
        # The worker process is used again; what this task's batches took goes back.
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
