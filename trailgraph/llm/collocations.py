"""Phrase collocations: exact phrase counts through burst tries, scored by their weakest cut.

Words are counted first, then pairs, then all longer phrases in one pass. A
phrase can only be frequent if all words, and all pairs of neighbours, inside it
are, so a bit table of the frequent ones (a Bloom filter of a fixed size) leaves
out most others; what passes by chance is counted and then dropped, so counts
are exact at any size.

A task counts in a HAT-trie: a shallow trie over word ids whose leaves are hash
containers. A container that outgrows BURST entries bursts into containers by
the next word's id. When the trie holds ROOM entries, its largest subtrees are
spilled whole, as sorted runs. A run's rows carry their prefix partition, cut
from the ids of the first two words, so the subtree of a word as common as a
third of all words still spreads over 64 partitions. Spark shuffles the runs by
prefix partition and sums equal phrases there.

A word's id is a 64-bit hash of its language and bytes; ids tell words apart.

Null texts are empty; a null language is ``und``. Repeated rows count repeatedly.
Empty tables and texts give no phrases. Ties of score and count go by phrase.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgraph.functions.ranking import top_k
from trailgraph.llm import text as T
from trailgraph.runtime import cut_lineage

#: Entries of a container before it bursts, and of a trie before it spills.
BURST, ROOM = 1 << 15, 1 << 20
#: Bits of the table of frequent phrases.
BITS = 1 << 27
_HARD = np.zeros(256, bool)
_HARD[[10, 11, 12, 13, *b".,;:!?"]] = True
_SPLIT = _HARD.copy()
_SPLIT[[9, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[T.Words, np.ndarray, np.ndarray]]:
    """(words, word ids, piece numbers) of bounded chunks; columns lang, text."""
    langs = batch.column(0).fill_null("und").dictionary_encode()
    names = [x.encode() for x in langs.dictionary.to_pylist()]
    ends = np.cumsum([len(x) for x in names], dtype=np.int64)
    salt = T.word_hashes(np.frombuffer(b"".join(names), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)
    row_lang = langs.indices.to_numpy()
    for lo, hi, data, offsets in T.chunks(batch.column(1)):
        w = T.Words(data, offsets, lower=True, space=_SPLIT)
        if not len(w.starts):
            continue
        hard = np.concatenate([[0], np.cumsum(_HARD[w.data])])
        new = (w.doc[1:] != w.doc[:-1]) | (hard[w.starts[1:]] != hard[w.ends[:-1]])
        yield w, T.mix(w.hashes ^ T.mix(salt + _STEP)[row_lang[lo:hi]][w.doc]), np.concatenate([[0], np.cumsum(new)])


def fold(ids: list[np.ndarray]) -> np.ndarray:
    """One hash of each phrase, given its words' ids column by column."""
    out = ids[0]
    for x in ids[1:]:
        out = T.mix(out + x * _STEP)
    return out


class Bits:
    """Fixed-size table of frequent phrases: no frequent one is ever missing."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(h: np.ndarray) -> Iterator[np.ndarray]:
        yield h & np.uint64(BITS - 1)
        yield (h >> np.uint64(32)) & np.uint64(BITS - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in self.places(h):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


class Container:
    """Open-addressed hash table from phrases to counts, filled in batches of distinct phrases."""

    def __init__(self, width: int, room: int = 1 << 9):
        self.width, self.used = width, 0
        self._make(room)

    def _make(self, room: int) -> None:
        self.h, self.n = np.zeros(room, np.uint64), np.zeros(room, np.int64)
        self.keys, self.owner = np.zeros((room, self.width), np.uint64), np.zeros(room, np.int64)

    def items(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        full = np.flatnonzero(self.n)
        return self.h[full], self.keys[full], self.n[full]

    def add(self, h: np.ndarray, keys: np.ndarray, n: np.ndarray) -> None:
        room = len(self.h)
        while (self.used + len(h)) * 2 > room:
            room *= 2
        if room > len(self.h):
            kept, self.used = self.items(), 0
            self._make(room)
            self._put(*kept)
        self._put(h, keys, n)

    def _put(self, h: np.ndarray, keys: np.ndarray, n: np.ndarray) -> None:
        mask = np.uint64(len(self.h) - 1)
        slot, todo = (h & mask).astype(np.int64), np.arange(len(h))
        while len(todo):
            at = slot[todo]
            free = todo[self.n[at] == 0]
            self.owner[slot[free]] = free
            won = free[self.owner[slot[free]] == free]
            self.h[slot[won]], self.keys[slot[won]] = h[won], keys[won]
            self.used += len(won)
            same = (self.h[at] == h[todo]) & (self.keys[at] == keys[todo]).all(1)
            self.n[at[same]] += n[todo[same]]
            todo = todo[~same]
            slot[todo] = (slot[todo] + 1) & int(mask)


class Node:
    """A container, or after its burst 64 nodes by the next word's id."""

    def __init__(self, width: int, depth: int):
        self.width, self.depth, self.size = width, depth, 0
        self.leaf: Container | None = Container(width)
        self.below: dict[int, Node] = {}

    def add(self, h: np.ndarray, keys: np.ndarray, n: np.ndarray) -> None:
        if self.leaf is not None:
            self.leaf.add(h, keys, n)
            self.size = self.leaf.used
            if self.size <= BURST or self.depth == self.width:
                return
            h, keys, n = self.leaf.items()
            self.leaf, self.size = None, 0
        for digit, at in by_digit(keys[:, self.depth]):
            node = self.below.get(digit) or self.below.setdefault(digit, Node(self.width, self.depth + 1))
            before = node.size
            node.add(h[at], keys[at], n[at])
            self.size += node.size - before

    def items(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if self.leaf is not None:
            yield self.leaf.items()
        for node in self.below.values():
            yield from node.items()


def by_digit(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(top six bits, rows) of ids."""
    digit = (ids >> np.uint64(58)).astype(np.int64)
    order = np.argsort(digit, kind="stable")
    borders = np.flatnonzero(np.diff(digit[order], prepend=-1))
    for a, b in zip(borders.tolist(), [*borders[1:].tolist(), len(order)]):
        yield int(digit[order[a]]), order[a:b]


class HatTrie:
    """Phrase counts of one task, by the first word's id."""

    def __init__(self, width: int):
        self.width = width
        self.below: dict[int, Node] = {}

    def size(self) -> int:
        return sum(x.size for x in self.below.values())

    def add(self, h: np.ndarray, keys: np.ndarray, n: np.ndarray) -> None:
        for digit, at in by_digit(keys[:, 0]):
            if digit not in self.below:
                self.below[digit] = Node(self.width, 1)
            self.below[digit].add(h[at], keys[at], n[at])

    def spill(self, down_to: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted runs (phrases, counts) of the largest subtrees, which leave the trie."""
        size = self.size()
        for digit in sorted(self.below, key=lambda d: -self.below[d].size):
            if size <= down_to:
                return
            node = self.below.pop(digit)
            size -= node.size
            parts = list(node.items())
            keys, n = np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts])
            order = np.lexsort([keys[:, j] for j in range(self.width - 1, -1, -1)])
            yield keys[order], n[order]


def _columns(width: int) -> list[str]:
    return [f"w{j}" for j in range(width)]


def phrase_counts(texts: DataFrame, widths: list[int], part: int, frequent: Bits, least: int) -> DataFrame:
    """m, w0.. (null beyond the m-th), n of the phrases of each width that stand at least ``least`` times.

    ``frequent``: the phrases of ``part`` words that do; texts: lang, text.
    """
    names = _columns(max(widths))
    ddl = "p int, m int, " + ", ".join(f"{x} long" for x in names) + ", n long"
    schema = T.arrow_schema(ddl)
    share = texts.sparkSession.sparkContext.broadcast(frequent.words)

    def runs(trie: HatTrie, down_to: int):
        for keys, n in trie.spill(down_to):
            p = ((keys[:, 0] >> np.uint64(46)) & np.uint64(0xFFF)) << np.uint64(6) | keys[:, 1] >> np.uint64(58)
            words = [pa.array(np.ascontiguousarray(keys[:, j]).view(np.int64)) if j < trie.width else pa.nulls(len(n), pa.int64()) for j in range(len(names))]
            cols = [pa.array(p.astype(np.int32)), pa.array(np.full(len(n), trie.width, np.int32)), *words, pa.array(n)]
            for a in range(0, len(n), 1 << 15):
                yield pa.RecordBatch.from_arrays([c[a : a + (1 << 15)] for c in cols], schema=schema)

    def count(batches):
        tries, table = [HatTrie(w) for w in widths], Bits(share.value)
        room = ROOM // len(tries)
        for batch in batches:
            for _, ids, piece in pieces(batch):
                if len(ids) < part:
                    continue
                common = table.has(fold([ids[j : len(ids) - part + 1 + j] for j in range(part)]))
                for trie in tries:
                    m = len(ids) - trie.width + 1
                    if m <= 0:
                        continue
                    keep = piece[:m] == piece[trie.width - 1 :]
                    for j in range(trie.width - part + 1):
                        keep &= common[j : j + m]
                    at = np.flatnonzero(keep)
                    h, first, n = np.unique(fold([ids[at + j] for j in range(trie.width)]), return_index=True, return_counts=True)
                    trie.add(h, np.stack([ids[at[first] + j] for j in range(trie.width)], 1), n)
                    if trie.size() > room:
                        yield from runs(trie, room // 2)
        for trie in tries:
            yield from runs(trie, 0)

    rows = texts.select("lang", "text").mapInArrow(count, ddl)
    return rows.repartition("p").groupBy("p", "m", *names).agg(F.sum("n").alias("n")).filter(F.col("n") >= least).drop("p")


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, id, n of every word."""

    def count(batch: pa.RecordBatch):
        for lang in batch.column(0).unique():
            own = batch.filter(pc.equal(batch.column(0), lang))
            for w, ids, _ in pieces(own):
                uniq, first, n = np.unique(ids, return_index=True, return_counts=True)
                start, size = w.starts[first], (w.ends - w.starts)[first]
                at = np.cumsum(size) - size
                body = w.data[np.arange(int(size.sum())) + np.repeat(start - at, size)]
                word = pa.Array.from_buffers(pa.string(), len(uniq), [None, pa.py_buffer(np.append(at, size.sum()).astype(np.int32)), pa.py_buffer(body)])
                yield {"lang": pa.array([lang.as_py()] * len(uniq), pa.string()), "word": word, "id": uniq.view(np.int64), "n": n}

    return T.arrow_map(texts.select("lang", "text"), count, "lang string, word string, id long, n long").groupBy("lang", "word").agg(F.first("id").alias("id"), F.sum("n").alias("n"))


def bits_of(frequent: DataFrame) -> Bits:
    """The bit table of phrases of one length (columns w0..); at most BITS / 64 rows come to the driver."""
    names = [x for x in frequent.columns if x not in ("m", "n")]

    def places(batch: pa.RecordBatch):
        h = fold([c.to_numpy().view(np.uint64) for c in batch.columns])
        at = np.unique(np.concatenate(list(Bits.places(h)))) if len(h) else h
        slot, first = np.unique(at >> np.uint64(6), return_index=True)
        mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
        yield {"slot": slot.astype(np.int64), "mask": mask.view(np.int64)}

    got = T.arrow_map(frequent.select(*names), places, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(BITS // 64, np.uint64)
    words[got["slot"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return Bits(words)


def _whole(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def frequent_phrases(texts: DataFrame, words: DataFrame, least: int, longest: int) -> DataFrame:
    """key (array of word ids), m (its length), n of all phrases of 1 to ``longest`` words with n >= ``least``."""
    level = words.filter(F.col("n") >= least).select(F.col("id").alias("w0"), "n")
    out = level.select(F.array("w0").alias("key"), F.lit(1).alias("m"), "n")
    for part, widths in ((1, [2]), (2, list(range(3, longest + 1)))):
        if widths and widths[0] <= longest:
            level = cut_lineage(phrase_counts(texts, widths, part, bits_of(level), least))
            out = out.unionByName(level.select(F.array_compact(F.array(*_columns(max(widths)))).alias("key"), "m", "n"))
    return out


def weakest_cuts(phrases: DataFrame) -> DataFrame:
    """key, m, a, l, r, score of every phrase of two words or more: its lowest-scoring cut."""
    cand = phrases.filter("m >= 2").withColumnRenamed("n", "a")
    part = phrases.select("key", "n")
    cuts = cand.select("key", "m", "a", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.withColumn("_l", F.slice("key", F.lit(1), F.col("k"))).withColumn("_r", F.slice("key", F.col("k") + 1, F.col("m") - F.col("k")))
    cuts = cuts.join(part.select(F.col("key").alias("_l"), F.col("n").alias("l")), "_l").join(part.select(F.col("key").alias("_r"), F.col("n").alias("r")), "_r")
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r"))
    return cuts.groupBy("key", "m", "a").agg(best.alias("_b")).select("key", "m", "a", "_b.l", "_b.r", "_b.score")


def not_inside(cand: DataFrame, phrases: DataFrame) -> DataFrame:
    """Candidates that no longer one holds with at least 80 % of their count."""
    longer = phrases.filter("m >= 3")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.col("m") - s + 1), lambda i: F.slice("key", i, s))))
    held = longer.select(F.explode(inner).alias("key"), F.col("n").alias("_n")).groupBy("key").agg(F.max("_n").alias("_held"))
    return cand.join(held, "key", "left").filter(F.col("_held").isNull() | (_whole(F.col("_held")) * 100 < _whole(F.col("a")) * 80)).drop("_held")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = cut_lineage(word_counts(texts))
    phrases = frequent_phrases(texts, words, least, longest)
    names = words.filter(F.col("n") >= least).select(F.col("id").alias("_id"), "lang", "word")
    cand = not_inside(weakest_cuts(phrases), phrases)
    cand = cand.withColumn("_id", F.col("key")[0]).join(names.select("_id", "lang"), "_id").drop("_id")
    by_score = [F.col("score").desc(), F.col("a").desc()]
    # Only phrases that can still be among the first get their text; ties at the border all do.
    border = top_k(cand, ["lang"], [*by_score, F.col("key")], top).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("_border"))
    cand = cut_lineage(cand.join(border, "lang").filter(F.struct("score", "a") >= F.col("_border")).drop("_border"))
    spelt = cand.select("key", F.posexplode("key").alias("_pos", "_id")).join(names.select("_id", "word"), "_id")
    spelt = spelt.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    out = top_k(cand.join(spelt, "key"), ["lang"], [*by_score, F.col("phrase")], top, rank="rank")
    return out.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
