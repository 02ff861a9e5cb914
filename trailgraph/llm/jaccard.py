"""N-gram Jaccard join by universe partition and pigeonhole, exact.

Texts become sets of distinct 5-word shingles (64-bit hashes); equal sets are one
class. For |r| <= |s| and Jaccard >= num/den the symmetric difference is at most
H = (den - num)(|r| + |s|) / (den + num). Per size band (powers of two) the hash
universe is cut into more than H segments, so linked sets agree on some whole
segment. Every set indexes its non-empty segments; one with too few of them adds
the one-deletion neighbourhoods of its segments, and if those don't reach H
either, its single tokens. Of a linked pair the first set with enough segments
finds the other.

Cost-based allocation: a set need only probe H + 1 of its segments. A segment
no other set holds costs nothing; one whose holders are already connected costs
nothing either. First every set is compared with a few holders it shares most segments with
(at most PARTNERS comparisons a set, never all pairs of a bucket); what components
then leave open is probed cheapest bucket first, until H + 1 segments of every
set are settled. All candidates are verified on whole sets.

Null and empty texts have an empty set and link with nothing. A row with a null
id is a node of its own text (its component_id may be a negative number made
from the text). Rows that repeat give repeated results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailgraph.llm import text as T
from trailgraph.runtime import cut_lineage

K = 5
NUM, DEN = 75, 100
PARTNERS = 4  # of the first comparison; what it misses is probed in full
BROADCAST_IDS = 1_000_000  # 16 MB
_SEED = np.uint64(0xA5A5A5A5A5A5A5A5)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than K words are one shingle."""
    w = T.Words(data, offsets, lower=True)
    at, h = w.grams(K)
    first = np.searchsorted(at, w.first)
    short = (w.count > 0) & (w.count < K)
    whole = T.span_hash(w.hashes, w.first[:-1][short], w.first[1:][short]) if short.any() else np.zeros(0, np.uint64)
    out = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:])]
    for i, x in zip(np.flatnonzero(short), whole):
        out[i] = np.array([x], np.uint64)
    return out


def _digest(u: np.ndarray) -> tuple[int, int]:
    a, b = T.mix(u), T.mix(u ^ _SEED)
    return int(np.add.reduce(a, dtype=np.uint64).view(np.int64)), int(np.add.reduce(b, dtype=np.uint64).view(np.int64))


def members(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, n, a, b, o: set size, two hashes of the set and its outline, per row."""
    src = docs.select(T.ident(id_col, text_col).alias("node"), F.col(text_col).alias("t"))

    def run(batch):
        nodes = batch.column(0)
        for lo, hi, data, offsets in T.chunks(batch.column(1)):
            sets = shingle_sets(data, offsets)
            d = [_digest(u) for u in sets]
            yield {"node": nodes[lo:hi], "n": [len(u) for u in sets], "a": [x[0] for x in d], "b": [x[1] for x in d], "o": [outline(u) for u in sets]}

    return T.arrow_map(src, run, "node long, n long, a long, b long, o binary")


def segments(n_docs: int, doc: np.ndarray, tokens: np.ndarray, size: np.ndarray, low: np.ndarray, limit: np.ndarray):
    """(doc, signature, slack) of a batch of sets in one band; slack < 0: every signature must be settled.

    low: the band's smallest size per doc; limit: H per doc.
    """
    m = np.ceil(0.4 * 2 * low).astype(np.int64) + 4
    seg = (T.mix(tokens ^ low[doc].astype(np.uint64)) >> np.uint64(1)).astype(np.int64) % m[doc]
    value = T.mix(tokens)
    order = np.lexsort((seg, doc))
    d, g, v = doc[order], seg[order], value[order]
    starts = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (g[1:] != g[:-1])])) if len(d) else np.zeros(0, np.int64)
    total = np.add.reduceat(v, starts) if len(d) else v
    count = np.diff(np.append(starts, len(d)))
    place = T.mix(low[d[starts]].astype(np.uint64) * np.uint64(1 << 32) + g[starts].astype(np.uint64))
    filled = np.bincount(d[starts], minlength=n_docs)
    slack = filled - (limit + 1)
    yield d[starts], T.mix(total ^ place), np.maximum(slack, -1)[d[starts]]
    poor = slack < 0
    if poor.any():
        # One-deletion neighbourhoods: a segment and the segment without each of its tokens.
        here = poor[d[starts]]
        other = T.mix(place ^ _SEED)
        yield d[starts][here], T.mix(total[here] ^ other[here]), np.full(here.sum(), -1)
        each = np.repeat(np.arange(len(starts)), count)
        mine = poor[d]
        yield d[mine], T.mix((total[each] - v)[mine] ^ other[each][mine]), np.full(mine.sum(), -1)
        reach = np.bincount(d[starts], np.minimum(count, 2), n_docs)
        last = (poor & (reach < limit + 1))[d]
        if last.any():
            yield d[last], T.mix(v[last] ^ T.mix(low[d[last]].astype(np.uint64) ^ np.uint64(0x5555))), np.full(last.sum(), -1)


def _signatures(batch: pa.RecordBatch, num: int, den: int):
    nodes = batch.column(0).to_numpy()
    for lo, hi, data, offsets in T.chunks(batch.column(1)):
        sets = shingle_sets(data, offsets)
        size = np.array([len(u) for u in sets], np.int64)
        tokens = np.concatenate([np.zeros(0, np.uint64), *sets])
        doc = np.repeat(np.arange(len(sets)), size)
        low = np.where(size > 0, 1 << np.floor(np.log2(np.maximum(size, 1))).astype(np.int64), 1)
        # Own band: partners up to size * den / num. Band below: partners smaller than ``low``.
        above = (size * den) // num
        own = ((size + above) * (den - num)) // (den + num)
        below = ((size + low - 1) * (den - num)) // (den + num)
        for band, limit, pick in ((low, own, size > 0), (low // 2, below, (size * num + den - 1) // den < low)):
            take = pick & (size > 0) & (band > 0)
            if not take.any():
                continue
            here = take[doc]
            for d, sig, slack in segments(len(sets), doc[here], tokens[here], size, np.maximum(band, 1), limit):
                # The slack is counted per band: the band's parity tells two bands of a set apart.
                band_of = np.log2(np.maximum(band[d], 1)).astype(np.int64) % 2
                yield {"sig": sig.view(np.int64), "node": nodes[lo + d], "state": (np.minimum(slack, 1 << 28).astype(np.int32) * 2 + band_of.astype(np.int32))}


def outline(u: np.ndarray) -> bytes:
    """Counts (255 at most) of the tokens in as many cells as the largest power of two in the set's size.

    The differences of two outlines never add up to more than the sets differ in.
    """
    cells = 1 << (max(len(u), 1).bit_length() - 1)
    counts = np.bincount((T.mix(u ^ _SEED) & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _may_link(batch: pa.RecordBatch, num: int, den: int):
    keep = []
    for nx, ny, a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
        u, v = (np.frombuffer(o.as_buffer(), np.uint8).astype(np.int64) for o in (a, b))
        cells = min(len(u), len(v))
        # Saturated cells tell nothing.
        apart = np.abs(u.reshape(-1, cells).sum(0) - v.reshape(-1, cells).sum(0)).sum() if max(u.max(), v.max()) < 255 else 0
        keep.append((den + num) * int(apart) <= (den - num) * (nx + ny))
    keep = pa.array(keep, pa.bool_())
    yield {"x": batch.column(0).filter(keep), "y": batch.column(1).filter(keep)}


def _verify(batch: pa.RecordBatch, num: int, den: int):
    x, y = batch.column(0), batch.column(1)
    seen: dict[bytes, np.ndarray] = {}

    def set_of(packed: bytes) -> np.ndarray:
        if packed not in seen:
            if len(seen) > 64:
                seen.clear()
            data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
            seen[packed] = shingle_sets(data, np.array([0, len(data)]))[0]
        return seen[packed]

    ok = []
    for a, b in zip(batch.column(2), batch.column(3)):
        u, v = set_of(a.as_py()), set_of(b.as_py())
        both = len(np.intersect1d(u, v, assume_unique=True))
        ok.append(den * both >= num * (len(u) + len(v) - both))
    keep = pa.array(ok, pa.bool_())
    yield {"x": x.filter(keep), "y": y.filter(keep)}


def close_in_size(pairs: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    n = sizes.select("node", "n").distinct()
    return pairs.join(n.withColumnsRenamed({"node": "x", "n": "nx"}), "x").join(n.withColumnsRenamed({"node": "y", "n": "ny"}), "y").filter(F.least("nx", "ny") * den >= F.greatest("nx", "ny") * num).drop("nx", "ny")


def limits(num: int, den: int):
    """Columns over n and band: the H that a set must exceed to find partners of any size in the band, and
    the smaller one that suffices where no partner is larger than itself."""
    gap, sum_ = den - num, den + num
    bits = "int(floor(log2(n + 0.5D)))"  # exact for whole sizes
    own = F.expr(f"{bits} % 2 = band")
    below = F.expr(f"(n + shiftleft(1L, {bits}) - 1) * {gap} div {sum_}")
    up = F.expr(f"(n + n * {den} div {num}) * {gap} div {sum_}")
    level = F.expr(f"2 * n * {gap} div {sum_}")
    return F.when(own, up).otherwise(below), F.when(own, level).otherwise(below)


def met(probes: DataFrame, index: DataFrame, num: int, den: int) -> DataFrame:
    """x, y that can link by the segments they share.

    probes: sig, x, comp, band, n, and whether the set has too few segments (all), and whether the signature
    is among those settled where no partner is larger (first). Of a pair the larger set finds the other: it
    shares at least limit + 1 - H of its first segments. Sets with too few segments are found from both sides.
    Buckets are split by slices of size; a set meets its own slice and its neighbours.
    """
    slice_ = lambda c: F.floor(F.log(F.col(c).cast("double")) / math.log(den / num))
    left = probes.withColumn("slice", F.explode(F.array(slice_("n") - 1, slice_("n"), slice_("n") + 1)))
    right = index.select("sig", F.col("node").alias("y"), F.col("comp").alias("its"), F.col("n").alias("ny"), (F.col("slack") < 0).alias("poor"), slice_("n").alias("slice"))
    near = (F.least("n", "ny") * den >= F.greatest("n", "ny") * num) & (F.col("comp") != F.col("its"))
    # A set with few segments probes all; others find sets up to their own size, and larger ones only if those are poor.
    may = F.col("all") | F.col("poor") | (F.col("first") & (F.col("ny") <= F.col("n")))
    rows = left.join(right, ["sig", "slice"]).filter(near & may)
    found = rows.groupBy("x", "y", "band", "n", "ny").agg(F.sum(F.col("first").cast("long")).alias("k"), F.max("all").alias("all"), F.max("poor").alias("poor"))
    h = F.expr(f"(n + ny) * {den - num} div {den + num}")
    level = limits(num, den)[1]
    return found.filter(F.col("all") | F.col("poor") | (F.col("k") >= level + 1 - h)).select("x", "y")


def verified(pairs: DataFrame, docs: DataFrame, shapes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) of nodes whose sets reach the threshold. ``docs``: node, t; ``shapes``: node, n, o.

    Outlines rule most pairs out; the texts of the rest travel packed and are compared in full.
    """
    side = lambda c: shapes.select(F.col("node").alias(c), F.col("n").alias("n" + c), F.col("o").alias("o" + c))
    drawn = pairs.select("x", "y").join(side("x"), "x").join(side("y"), "y").select("x", "y", "nx", "ny", "ox", "oy")
    pairs = cut_lineage(T.arrow_map(drawn, lambda b: _may_link(b, num, den), "x long, y long"))
    used = cut_lineage(pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct())
    # Ids are broadcast only if counted to be few; beyond that documents are shuffled.
    chosen = docs.join(F.broadcast(used) if used.count() <= BROADCAST_IDS else used, "node", "left_semi")

    def pack(batch):
        yield {"node": batch.column(0), "s": [zstandard.ZstdCompressor(level=1).compress((t or "").encode()) for t in batch.column(1).to_pylist()]}

    packed = cut_lineage(T.arrow_map(chosen, pack, "node long, s binary").dropDuplicates(["node"]))
    rows = pairs.join(packed.withColumnsRenamed({"node": "x", "s": "sx"}), "x").join(packed.withColumnsRenamed({"node": "y", "s": "sy"}), "y").select("x", "y", "sx", "sy")
    return cut_lineage(T.arrow_map(rows, lambda b: _verify(b, num, den), "x long, y long"))


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable over edges (x, y), for nodes with an edge.

    Every round hooks each root to the smallest root it touches and halves the
    paths; rounds are written, and their number grows with the log of the size.
    """
    both = edges.select("x", "y").union(edges.select(F.col("y"), F.col("x"))).filter("x <> y").distinct()
    both = cut_lineage(both.toDF("x", "y"))
    label = cut_lineage(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("comp")).select(F.col("x").alias("node"), "comp"))
    while True:
        to = label.select(F.col("node").alias("y"), F.col("comp").alias("c"))
        seen = both.join(to, "y").groupBy("x").agg(F.min("c").alias("near")).select(F.col("x").alias("node"), "near")
        mine = label.join(seen, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        # A root moves to the lowest label any of its members sees, then labels follow their roots.
        root = mine.groupBy("comp").agg(F.min("low").alias("to"))
        step = mine.join(root, "comp").select("node", F.least("low", "to").alias("next"), "comp")
        jump = label.select(F.col("node").alias("next"), F.col("comp").alias("over"))
        new = cut_lineage(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("over", "next")).alias("comp"), (F.least("next", F.coalesce("over", "next")) != F.col("comp")).alias("moved")))
        label = new.select("node", "comp")
        if new.filter("moved").isEmpty():
            return label


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """node, doc_id, n_shingles, class_id (equal sets), component_id of every row."""
    rows = docs.select(T.ident(id_col, text_col).alias("node"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    sizes = cut_lineage(members(docs, id_col, text_col))
    classes = sizes.filter("n > 0").groupBy("a", "b").agg(F.min("node").alias("class"), F.count("*").alias("copies"))
    copies = cut_lineage(sizes.filter("n > 0").join(classes.filter("copies > 1"), ["a", "b"]).select("node", "class"))
    extra = copies.filter("node <> class").select("node").distinct()
    heads = rows.select("node", "t").join(extra, "node", "left_anti")
    shapes = sizes.filter("n > 0").select("node", "n", "o").dropDuplicates(["node"])
    sig = T.arrow_map(heads, lambda b: _signatures(b, num, den), "sig long, node long, state int")
    # Buckets in order of their holders: the smallest is the hub; buckets of one holder drop here.
    w = W.partitionBy("sig").orderBy("node")
    held = sig.withColumn("hub", F.first("node").over(w)).withColumn("next", F.lead("node").over(w)).filter("hub <> node or next <> hub")
    held = cut_lineage(held.select("sig", "node", "state", "hub"))
    # First partners: the bucket's smallest holder and the next ones in two orders; of those the
    # PARTNERS that a set shares most segments with.
    other = W.partitionBy("sig").orderBy(F.xxhash64("node", "sig"))
    lined = held.withColumn("n1", F.lead("node").over(w)).withColumn("n2", F.lead("node").over(other))
    near = lined.select("node", "state", F.explode(F.array("hub", "n1", "n2")).alias("y")).filter("y <> node")
    shared = close_in_size(near.groupBy(F.col("node").alias("x"), "y").agg(F.count("*").alias("k"), F.max("state").alias("state")), sizes, num, den)
    # Linked sets share at least slack + 1 segments; pairs met in less than half of those wait for the probes.
    shared = shared.filter(2 * F.col("k") > F.shiftright("state", 1))
    best = W.partitionBy("x").orderBy(F.desc("k"), "y")
    pairs = cut_lineage(shared.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= PARTNERS).select("x", "y"))
    edges = verified(pairs, heads, shapes, num, den)
    label = components(edges)
    # What is still open: segments whose holders lie in different components.
    named = held.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("g")).filter("lo <> hi").select("sig", "g")
    wide, level = limits(num, den)
    n_of = shapes.select("node", "n")
    open_ = cut_lineage(named.join(mixed, "sig").join(n_of, "node").select("sig", "node", "n", "comp", "g", F.shiftright("state", 1).alias("slack"), F.col("state").bitwiseAND(F.lit(1)).alias("band")))
    per_set = W.partitionBy("node", "band")
    ranked = open_.withColumn("left", F.count("*").over(per_set) - F.col("slack")).withColumn("rank", F.row_number().over(per_set.orderBy("g", "sig")))
    ranked = ranked.select("sig", F.col("node").alias("x"), "comp", "band", "n", (F.col("slack") < 0).alias("all"), (F.col("rank") <= F.col("left")).alias("any"), (F.col("rank") <= F.col("left") - (wide - level)).alias("first"))
    probes = cut_lineage(ranked.filter("all or any"))
    if not probes.isEmpty():
        more = met(probes, open_, num, den).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        tried = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        found = verified(more.join(tried, ["x", "y"], "left_anti"), heads, shapes, num, den)
        if not found.isEmpty():
            label = components(edges.union(found))
    out = rows.select("node", "doc_id").join(sizes.groupBy("node").agg(F.max("n").alias("n_shingles")), "node", "left").join(copies.distinct(), "node", "left")
    out = out.withColumn("class", F.coalesce("class", "node")).join(label.withColumnRenamed("node", "class"), "class", "left")
    return out.select("node", "doc_id", "n_shingles", F.col("class").alias("class_id"), F.coalesce("comp", "class").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays (the smallest id), with all its columns."""
    gone = cut_lineage(join(docs, id_col, text_col).filter("node <> component_id").select(F.col("node").alias("_near_node")).distinct())
    return docs.withColumn("_near_node", T.ident(id_col, text_col)).join(gone, "_near_node", "left_anti").select(*docs.columns)
