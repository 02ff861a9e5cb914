"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Per class of window length m (``window`` words, and the lengths of shorter
items): k-grams with k = min(5, m) are hashed, and the leftmost smallest hash of
every m-k+1 consecutive ones is kept. A window that occurs in a document selects
the same k-gram there, so the join of test and training fingerprints misses no
shared window. Every hit is extended to the window it stands for and compared
word by word; hashes only nominate.

The fingerprints of the test items are counted first. Up to ``FEW`` of them become
a hash set in the plan, and a hit is verified in the row that holds the words;
beyond that both sides are shuffled by fingerprint and hits go back to their
documents.

Null and empty texts have no words. Repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgraph.llm import text as T
from trailgraph.runtime import cut_lineage

WINDOW = 10
GRAM = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEW = 20_000  # test windows: some 4 MB with their texts
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(c: Column) -> Column:
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """Words of digits, letters and everything beyond ASCII, A-Z lowered; null gives none."""
    return F.filter(F.split(lower_ascii(F.coalesce(c, F.lit(""))), BETWEEN), lambda w: w != "")


def grams(hashes: Column, k: int) -> Column:
    n = F.size(hashes) - k + 1
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.element_at(hashes, i + j) for j in range(k)]))


def places(packed: Column, m: int, k: int) -> Column:
    """Positions (from 0) that winnowing keeps, of hashes packed with their place.

    The high half holds the hash, the low half the place, so the least of a
    window is its leftmost smallest. slice() copies its whole array, so windows
    are read element by element.
    """
    w = m - k + 1
    n = F.size(packed) - w + 1
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    least = at if w == 1 else F.array_distinct(F.transform(at, lambda i: F.least(*[F.element_at(packed, i + j) for j in range(w)])))
    return F.transform(least, lambda x: (x - 1 if w == 1 else x.bitwiseAND(F.lit(0xFFFFFFFF))).cast("int"))


def _tagged(m: int, gram: Column):
    return lambda p: F.struct(F.lit(m).alias("m"), p.alias("p"), F.get(gram, p).alias("fp"))


def fingerprints(df: DataFrame, lengths: list[int], keep: list[str], only: list[int] | None = None) -> DataFrame:
    """(keep..., m, p, fp) of the column ``_w`` of words, for every window length; of the hashes ``only``, if given."""
    hashed = df.select(*dict.fromkeys([*keep, "_w"]), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    parts = []
    for k in sorted({min(GRAM, m) for m in lengths}):
        hashed = hashed.withColumn(f"_g{k}", grams(F.col("_h"), k))
        hashed = hashed.withColumn(f"_p{k}", F.transform(f"_g{k}", lambda g, i: F.shiftleft(F.shiftright(g, 32), 32) + i))
    for m in lengths:
        k = min(GRAM, m)
        parts.append(F.transform(places(F.col(f"_p{k}"), m, k), _tagged(m, F.col(f"_g{k}"))))
    rows = hashed.select(*keep, F.concat(*parts).alias("_fs"))
    if only is not None:  # a set in the plan: explode() copies all kept columns, so few elements may reach it
        rows = rows.withColumn("_fs", F.expr(f"filter(_fs, f -> f.fp in ({', '.join(f'{x}L' for x in only) or 'null'}))"))
    # explode() would infer a filter on the array's size, which pushed down evaluates the whole chain in
    # place again and again; the outer form infers none, and its null rows join nothing.
    return rows.select(*keep, F.explode_outer("_fs").alias("_f")).select(*keep, "_f.m", "_f.p", "_f.fp")


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """item, m, win (array of words): every window of every item."""
    w = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("_w")).filter(F.size("_w") > 0)
    m = F.least(F.size("_w"), F.lit(window))
    return w.select("item", m.alias("m"), F.explode(F.transform(F.sequence(F.lit(1), F.size("_w") - m + 1), lambda i: F.slice("_w", i, m))).alias("win")).distinct()


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: key, doc_id, n_words, n_hit, n_items, items_sha256, contaminated, starts (array of (start, length) of occurring windows)."""
    wins = cut_lineage(item_windows(items, item_col, item_text, window))
    lengths = sorted(r[0] for r in wins.select("m").distinct().collect())  # at most ``window`` values
    src = docs.select(T.row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("_w"))
    if not lengths:
        return src.select("key", "doc_id", F.size("_w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit("").cast("binary"), 256).alias("items_sha256"), F.lit(False).alias("contaminated"), F.array().cast("array<struct<s:int,m:int>>").alias("starts"))
    texts = wins.select("m", "win").distinct().withColumnRenamed("win", "_w")
    tests = fingerprints(texts, lengths, ["_w"]).filter(F.size("_w") == F.col("m"))
    tests = cut_lineage(tests.select("m", "fp", F.col("p").alias("off"), F.array_join("_w", " ").alias("win")))
    found = lambda keep, t, only=None: fingerprints(src, lengths, keep, only).join(t, ["m", "fp"]).withColumn("s", F.col("p") - F.col("off")).filter("s >= 0")
    if tests.count() <= FEW:
        only = [r[0] for r in tests.select("fp").distinct().collect()]
        hits = found(["key", "_w"], F.broadcast(tests), only).filter(_stands(F.col("s"), F.col("m"), F.col("win"))).groupBy("key").agg(F.collect_set(F.struct("s", "m", "win")).alias("real"))
    else:
        near = found(["key"], tests).groupBy("key").agg(F.collect_set(F.struct("s", "m", "win")).alias("hits"))
        hits = src.select("key", "_w").dropDuplicates(["key"]).join(near.hint("merge"), "key").select("key", F.filter("hits", lambda x: _stands(x["s"], x["m"], x["win"])).alias("real"))
    starts = F.array_sort(F.transform("real", lambda x: F.struct(x["s"].alias("s"), x["m"].alias("m"))))
    # Covered words: spans in start order, counting only what lies beyond the furthest end so far.
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("starts", begin, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["s"] + x["m"] - F.greatest(a["end"], x["s"]))).alias("n"), F.greatest(a["end"], x["s"] + x["m"]).alias("end")), lambda a: a["n"])
    spans = cut_lineage(hits.select("key", starts.alias("starts"), F.array_distinct(F.transform("real", lambda x: x["win"])).alias("wins")))
    per_doc = spans.select("key", "starts", covered.cast("long").alias("hit"))
    names = wins.select("item", F.array_join("win", " ").alias("win"))
    owners = spans.select("key", F.explode("wins").alias("win")).join(names, "win").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    sizes = docs.select(T.row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    out = sizes.join(per_doc.join(owners, "key"), "key", "left")
    listed, n_hit = F.coalesce(F.col("items"), F.array().cast("array<string>")), F.coalesce(F.col("hit"), F.lit(0)).cast("long")
    none = F.array().cast("array<struct<s:int,m:int>>")
    return out.select("key", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("starts", none).alias("starts"))


def _stands(s: Column, m: Column, win: Column) -> Column:
    """Do the words from ``s`` on make up the window?"""
    return F.array_join(F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.get("_w", s + j)), " ") == win


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without any benchmark window, all columns kept."""
    bad = cut_lineage(scan(docs, items, id_col, text_col).filter("contaminated").select(F.col("key").alias("_leak_key")).distinct())
    return docs.withColumn("_leak_key", T.row_key(id_col, text_col)).join(bad, "_leak_key", "left_anti").select(*docs.columns)
