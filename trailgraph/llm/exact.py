"""Exact dedup by content sort.

Normalised texts are range-partitioned with sampled splitters over (prefix,
hash, id), so that even one huge group of copies is split; every partition is
sorted by content with Spark's external sort; a scan compares each text with its
neighbour in full. Only runs that touch a partition's edge are stitched, from
one small row per run.

The splitter key holds a short prefix and a hash, so sampling sends no whole
texts to the driver. Null text counts as empty. Null ids sort last. Of rows that
repeat with one id, one stays.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgraph.llm import text as T
from trailgraph.runtime import cut_lineage

PREFIX = 24
ROWS = "key long, doc_id long, keep_id long, group_size long, first boolean, pid int, edge boolean, sha string"


def normalised(text_col: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _scan(batches):
    pid = TaskContext.get().partitionId()
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("first", pa.bool_()), ("pid", pa.int32()), ("edge", pa.bool_()), ("sha", pa.string())])
    first_block = block = None
    runs: list = []  # runs of the present (prefix, hash): [text, keys, ids]
    out: list = []

    def close(edge: bool):
        for text, keys, ids in runs:
            sha = hashlib.sha256(text).hexdigest()
            out.extend((k, i, ids[0], len(ids), n == 0, pid, edge, sha) for n, (k, i) in enumerate(zip(keys, ids)))
        runs.clear()

    def flush():
        cols = list(zip(*out)) or [[]] * len(schema)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    for batch in batches:
        keys, ids, p, h = (batch.column(i).to_pylist() for i in (0, 1, 2, 3))
        texts = batch.column(4).cast(pa.binary())
        for i in range(batch.num_rows):
            here = (p[i], h[i])
            if here != block:
                close(block == first_block)
                block = here
                first_block = first_block or here
            text = texts[i].as_py()
            if runs and runs[-1][0] == text:
                runs[-1][1].append(keys[i])
                runs[-1][2].append(ids[i])
            else:
                runs.append([text, [keys[i]], [ids[i]]])
        if out:
            yield flush()
    close(True)
    yield flush()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its group: key (row identity), doc_id, keep_id, group_size, kept, text_sha256."""
    src = docs.select(T.row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("norm"))
    src = src.select("key", "doc_id", F.substring("norm", 1, PREFIX).alias("p"), F.xxhash64("norm").alias("h"), "norm")
    order = ["p", "h", F.col("doc_id").asc_nulls_last(), "key"]
    dealt = src.repartitionByRange(*order).sortWithinPartitions("p", "h", "norm", F.col("doc_id").asc_nulls_last(), "key")
    rows = cut_lineage(dealt.mapInArrow(_scan, ROWS))
    whole = rows.filter(~F.col("edge")).withColumn("kept", F.col("first"))
    # At most a few runs per partition touch its edges: one row each.
    runs = rows.filter("edge and first").groupBy("sha").agg(F.min("keep_id").alias("keep"), F.sum("group_size").alias("size"), F.min("pid").alias("lead"))
    cut = rows.filter("edge").join(F.broadcast(runs), "sha").select(*[c for c in rows.columns if c not in ("keep_id", "group_size")], F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), (F.col("first") & (F.col("pid") == F.col("lead"))).alias("kept"))
    return whole.unionByName(cut).select("key", "doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = cut_lineage(groups(docs, id_col, text_col).groupBy("key").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1").select(F.col("key").alias("_exact_key"), "kept"))
    keyed = docs.withColumn("_exact_key", T.row_key(id_col, text_col))
    single = keyed.join(found.select("_exact_key"), "_exact_key", "left_anti")
    twins = found.filter("kept").select("_exact_key")  # rows repeated with id and text
    if not twins.isEmpty():
        single = single.unionByName(keyed.join(twins, "_exact_key", "left_semi").dropDuplicates(["_exact_key"]))
    return single.select(*docs.columns)
