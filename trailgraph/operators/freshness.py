"""Document freshness: citations against source changes, scores, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgraph.functions import scalar as S

# Where a document states its own date, in order of preference.
DATE_PATTERNS = [r"<!--\s*freshness:[^>]*last_checked=([^\s,>]+)", r"(?m)^Last updated:\s*(.+)$", r"(?m)^updated_at:\s*(.+)$"]


def document_time(content: Column | str) -> Column:
    """First parseable date of the three places a document may carry one."""
    found = [S.trim(F.regexp_extract(S.col(content), p, 1)) for p in DATE_PATTERNS]
    return F.coalesce(*[F.try_to_timestamp(F.when(x != "", x)) for x in found])


def cited_paths(content: Column | str) -> Column:
    """Distinct path-like tokens of every (evidence: a, b:12-40) note."""
    notes = F.regexp_extract_all(S.col(content), F.lit(r"\(evidence:\s*([^)]+)\)"), F.lit(1))
    tokens = F.flatten(F.transform(notes, lambda n: F.split(n, ",")))
    clean = F.transform(tokens, lambda t: S.trim(F.regexp_replace(F.regexp_replace(S.trim(t), "`", ""), r":L?\d[\d,-]*$", "")))
    return F.array_distinct(F.filter(clean, lambda t: (t != "") & ~t.rlike(r"\s") & (F.contains(t, F.lit("/")) | t.rlike(r"\.\w+$"))))


def status_of(score: Column) -> Column:
    # Score cut-offs.
    return F.when(score >= 80, "fresh").when(score >= 60, "aging").when(score >= 40, "stale").when(score >= 20, "very-stale").otherwise("obsolete")


def action_of(status: Column) -> Column:
    return (F.when(status.isin("fresh", "aging"), "none").when(status == "stale", "incremental-sync")
            .when(status == "very-stale", "full-regeneration").otherwise("manual-review"))


def score_documents(docs: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """path, score, status, action, stale_sources, deleted_sources per document.

    docs: path, content. sources: path, modified (NULL when unknown). Penalties
    are summed per document; the text itself is dropped before the shuffle.
    """
    d = docs.select("path", document_time("content").alias("updated"), cited_paths("content").alias("cited"))
    per = d.select("path", "updated", F.explode("cited").alias("source"))
    src = sources.groupBy(F.col("path").alias("source")).agg(F.max("modified").alias("modified"), F.lit(True).alias("found"))
    j = per.join(src, "source", "left")
    later = F.coalesce(S.micros("modified") > S.micros("updated"), F.lit(False))
    days = S.days_between("updated", "modified")
    penalty = F.when(F.col("found").isNull(), F.lit(25.0)).when(later, F.least(F.lit(30.0), S.half_up(days * 3))).otherwise(F.lit(0.0))
    sums = j.groupBy("path").agg(F.sum(penalty).alias("penalty"), F.count_if(F.col("found").isNull()).alias("deleted_sources"),
                                 F.count_if(F.col("found").isNotNull() & later).alias("stale_sources"))
    age = F.coalesce(S.clamp(S.days_between("updated", as_of) * 0.5, 0.0, 20.0), F.lit(0.0))
    zero = F.lit(0).cast("bigint")
    out = d.select("path", "updated", (F.size("cited") > 0).alias("checkable")).join(sums, "path", "left")
    score = F.when(F.col("checkable"), S.clamp(S.half_up(100 - F.col("penalty") - age), 0.0, 100.0)).otherwise(0.0).cast("bigint")
    out = out.withColumn("score", score).withColumn("status", F.when(F.col("checkable"), status_of(F.col("score"))).otherwise("unverifiable"))
    return out.select("path", "score", "status", action_of(F.col("status")).alias("action"),
                      F.coalesce("stale_sources", zero).alias("stale_sources"), F.coalesce("deleted_sources", zero).alias("deleted_sources"))


def drift_decision(scores: DataFrame, threshold: int = 60) -> DataFrame:
    """Counts by status and the decision from the lowest checkable score."""
    low = F.coalesce(F.min(F.when(F.col("status") != "unverifiable", F.col("score"))), F.lit(100).cast("bigint"))
    # States and decisions.
    states = ["fresh", "aging", "stale", "very-stale", "obsolete", "unverifiable"]
    agg = scores.agg(low.alias("min_score"), *[F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in states])
    decision = F.when(F.col("min_score") < 50, "Block implementation").when(F.col("min_score") < threshold, "Sync before implementation").otherwise("Proceed")
    return agg.withColumn("decision", decision)


def stalest(scores: DataFrame, k: int = 5) -> DataFrame:
    return scores.orderBy("score", "path").limit(k)
