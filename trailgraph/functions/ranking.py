"""Top-k, first-wins and budget helpers that stay safe on hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str | None = None, spread: int = 64) -> DataFrame:
    """First k rows of each group in ``order`` (make it a total order).

    Two rounds: the group is first cut to k rows inside each of ``spread``
    slices, then once more over at most spread*k rows, so no task ever sorts a
    whole hot group. Small k also gets Spark's map-side group limit.
    """
    name = rank or "_rank"
    slice_col = F.pmod(F.xxhash64(*df.columns), F.lit(spread))
    if k <= 1000:
        pruned = df
    else:
        w1 = W.partitionBy(*by, "_slice").orderBy(*order)
        pruned = df.withColumn("_slice", slice_col).withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k).drop("_r", "_slice")
    w = W.partitionBy(*by).orderBy(*order)
    out = pruned.withColumn(name, F.row_number().over(w).cast("bigint")).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_by(value: Column, order: Column, when: Column | None = None) -> Column:
    """Aggregate: the value of the first row in ``order`` (map-side combined)."""
    pair = F.struct(order.alias("o"), value.alias("v"))
    return F.min(F.when(when, pair) if when is not None else pair).getField("v")


def last_by(value: Column, order: Column) -> Column:
    return F.max(F.struct(order.alias("o"), value.alias("v"))).getField("v")


def number_rows(df: DataFrame, by: list[str], order: str, name: str, width: int = 1_000_000) -> DataFrame:
    """row_number() per group over a numeric order column, safe on hot groups.

    Rows are numbered inside slices of the order range; each slice then adds the
    row counts of the slices before it. Ties inside the order get distinct
    numbers in no fixed order, so pass a unique one where that matters.
    """
    sliced = df.withColumn("_s", F.floor(F.col(order) / F.lit(width)))
    counts = sliced.groupBy(*by, "_s").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_s")) - F.col("_n")
    offsets = counts.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("_s").alias("_so"), before.alias("_before"))
    inside = sliced.withColumn("_i", F.row_number().over(W.partitionBy(*by, "_s").orderBy(order)))
    cond = F.col("_s") == F.col("_so")
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return inside.join(offsets, cond).withColumn(name, (F.col("_i") + F.col("_before")).cast("bigint")).select(*df.columns, name)


def exact_median(df: DataFrame, by: list[str], value: str, accuracy: int = 10_000) -> DataFrame:
    """Exact median per group (mean of the middle two for even counts), without
    gathering a group: by, n, median.

    A bounded sketch brackets the median; rows below the bracket are counted,
    and only the distinct values inside it are ordered. NULL values drop.
    """
    keys = by or ["_all"]
    d = (df if by else df.withColumn("_all", F.lit(1))).select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    margin = 2.0 / accuracy
    ends = F.percentile_approx("_v", [0.5 - margin, 0.5 + margin], accuracy)
    span = d.groupBy(*keys).agg(F.count("*").alias("n"), ends.alias("e")).select(*keys, "n", F.col("e")[0].alias("_lo"), F.col("e")[1].alias("_hi"))
    j = d.join(span, keys)
    below = j.groupBy(*keys).agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_below"))
    inner = j.filter(F.col("_v").between(F.col("_lo"), F.col("_hi"))).groupBy(*keys, "_v", "n").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*keys).orderBy("_v"))
    ranked = inner.withColumn("_to", upto).join(below, keys).withColumn("_to", F.col("_to") + F.col("_below"))
    first, second = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    out = ranked.groupBy(*keys, "n").agg(((F.min(F.when(F.col("_to") >= first, F.col("_v"))) + F.min(F.when(F.col("_to") >= second, F.col("_v")))) / 2).alias("median"))
    return out.select(*by, "n", "median")
