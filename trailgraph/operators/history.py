"""Change history: hotspots, ownership, coupling, velocity, churn, author signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailgraph.functions import scalar as S
from trailgraph.functions.ranking import first_by, top_k
from trailgraph.runtime import cut_lineage

WEEK = 7 * S.MICROS_PER_DAY


def hotspots(touches: DataFrame, top_n: int = 20, key: str = "file", names: DataFrame | None = None) -> DataFrame:
    """Most-touched files with a rank score 100*(1 - i/top_n).

    Counts are combined before the shuffle and, when ``names`` maps the key to a
    file name, before the join. Ranks are numbered on the top_n rows only.
    """
    counts = touches.groupBy(key).agg(F.count("*").alias("change_freq"))
    if names is not None:
        counts = counts.join(names, key)
    top = counts.select("file", "change_freq").orderBy(F.desc("change_freq"), "file").limit(top_n)
    i = F.row_number().over(W.orderBy(F.desc("change_freq"), "file")) - 1
    return top.withColumn("score", S.half_up(100 * (1 - i / F.lit(float(top_n)))).cast("bigint"))


def ownership(touches: DataFrame, as_of: Column, stale_days: int = 90, share: float = 0.1) -> DataFrame:
    """Primary owner, bus factor and orphan flag of each module.

    The (module, author) table is aggregated first; module totals are joined
    back to it, so a hot module is never one window partition.
    """
    ma = touches.groupBy("module", "author").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    owner = ma.groupBy("module").agg(
        F.sum("n").alias("total"),
        F.max("last").alias("last_active"),
        F.min(F.struct((-F.col("n")).alias("n"), (-S.micros("last")).alias("t"), F.col("author"))).getField("author").alias("primary_owner"))
    factor = ma.join(owner.select("module", "total"), "module").groupBy("module").agg(
        F.count_if(F.col("n") / F.col("total") > share).cast("bigint").alias("bus_factor"))
    return owner.join(factor, "module").select(
        "module", "primary_owner", "total", "bus_factor",
        (S.days_between("last_active", as_of) > stale_days).alias("is_orphaned"), "last_active")


def coupling(touches: DataFrame, min_co: int = 3, min_strength: float = 0.3, top_n: int | None = 30, names: DataFrame | None = None) -> DataFrame:
    """Files that change together: co-changes and strength = co / max(totals).

    Only pairs that can reach both thresholds are ever formed. With commits
    ordered by size, a pair sharing at least t commits must share one outside
    the t-1 largest of either file, so each file offers only its commits below
    that cut-off for pairing. A commit holding a huge share of all rows is the
    largest everywhere and pairs nobody. Shared commits above a pair's lower
    cut-off all belong to the file that has it, so looking up those few commits
    of that file makes the counts exact; a pair without any keeps the count it
    has. The cut-off comes from a (file, commit size) histogram, never from
    sorting one file's rows.

    ``names`` (file, name) tells the names of files that are numbers in
    ``touches``; only the pairs found meet it.
    """
    size = touches.select("sha", "file").distinct()
    size = size.join(size.groupBy("sha").agg(F.count("*").cast("int").alias("size")), "sha")
    sized = cut_lineage(size)
    hist = sized.groupBy("file", "size").agg(F.count("*").alias("n"))
    above = F.sum("n").over(W.partitionBy("file").orderBy(F.desc("size")))
    total = F.sum("n").over(W.partitionBy("file"))
    need = lambda total: F.greatest(F.lit(min_co), F.ceil(F.lit(min_strength) * total - F.lit(1e-9)))
    cuts = (
        hist.withColumn("above", above).withColumn("total", total)
        .filter((F.col("above") >= need(F.col("total"))) & (F.col("total") >= min_co))
        .groupBy("file", "total").agg(F.max("size").alias("cut"), (F.col("total") - F.sum("n")).alias("rest")))
    marked = cut_lineage(sized.join(cuts, "file").filter("size > 1").select("sha", "file", "total", "rest", "cut", (F.col("size") <= F.col("cut")).alias("offered")))
    offers, large = marked.filter("offered"), marked.filter("not offered").select("sha", "file")
    # file_x has the lower cut-off of the two; need grows with the total.
    x = offers.select("sha", F.col("file").alias("file_x"), F.col("total").alias("total_x"), "rest", F.col("cut").alias("cut_x"))
    y = offers.select("sha", F.col("file").alias("file_y"), F.col("total").alias("total_y"), F.col("cut").alias("cut_y"))
    lower = (F.col("cut_x") < F.col("cut_y")) | ((F.col("cut_x") == F.col("cut_y")) & (F.col("file_x") < F.col("file_y")))
    ratio = F.least("total_x", "total_y") >= F.lit(min_strength) * F.greatest("total_x", "total_y") - F.lit(1e-9)
    key = ["file_x", "file_y", "total"]
    pairs = x.join(y, "sha").filter(lower & ratio).groupBy("file_x", "file_y", F.greatest("total_x", "total_y").alias("total"), "rest").agg(F.count("*").alias("n"))
    pairs = cut_lineage(pairs.filter(F.col("n") + F.col("rest") >= need(F.col("total"))))
    found = (
        pairs.filter("rest > 0").select(*key, "n").join(large.withColumnRenamed("file", "file_x"), "file_x")
        .join(marked.select("sha", F.col("file").alias("file_y")), ["sha", "file_y"], "left_semi"))
    more = found.groupBy(*key, "n").agg(F.count("*").alias("more"))
    sure = pairs.filter(F.col("n") >= need(F.col("total"))).select(*key, "n", F.lit(0).cast("bigint").alias("more"))
    counted = more.unionByName(sure).groupBy(*key).agg((F.max("n") + F.max("more")).alias("co_changes"))
    raw = F.col("co_changes") / F.col("total")
    out = counted.withColumn("raw", raw).filter((F.col("co_changes") >= min_co) & (F.col("raw") >= min_strength))
    if names is not None:
        for c in ("file_x", "file_y"):
            out = out.join(names.select(F.col("file").alias(c), F.col("name").alias(f"{c}_name")), c).drop(c).withColumnRenamed(f"{c}_name", c)
    out = out.select(F.least("file_x", "file_y").alias("file_a"), F.greatest("file_x", "file_y").alias("file_b"), "co_changes", "raw").select(
        "file_a", "file_b", "co_changes", S.half_up(F.col("raw"), 2).alias("strength"),
        (S.first_segment("file_a") != S.first_segment("file_b")).alias("cross_module"))
    return out if top_n is None else out.orderBy(F.desc("strength"), "file_a", "file_b").limit(top_n)


def velocity(touches: DataFrame, as_of: Column, window_days: int = 90) -> DataFrame:
    """Weekly touches of each module: recent four weeks against the rest."""
    weeks = -(-window_days // 7)
    recent = min(4, weeks)
    older = weeks - recent
    age = S.micros(as_of) - S.micros("ts")
    rows = touches.select("module", "ts", F.floor(age / F.lit(float(WEEK))).alias("week")).filter((F.col("week") >= 0) & (F.col("week") < weeks))
    agg = rows.groupBy("module").agg(
        F.count_if(F.col("week") < recent).alias("r"), F.count_if(F.col("week") >= recent).alias("o"), F.max("ts").alias("last_commit"))
    r = F.col("r") / F.lit(float(recent))
    o = F.col("o") / F.lit(float(older)) if older else r
    trend = (F.when(r == 0, "stale").when(r > o * 1.3, "accelerating").when(r < o * 0.7, "declining").otherwise("stable"))
    return agg.select("module", S.half_up(r, 1).alias("touches_per_week"), trend.alias("trend"), "last_commit")


def churn_window(touches: DataFrame, as_of: Column, window_days: int = 90) -> DataFrame:
    """Touches of each file in the last ``window_days`` days before as_of."""
    age = S.micros(as_of) - S.micros("ts")
    return touches.filter((age >= 0) & (age <= window_days * S.MICROS_PER_DAY)).groupBy("file").agg(F.count("*").alias("churn"))


def churn_last_n(commits: DataFrame, touches: DataFrame, n: int = 200) -> DataFrame:
    """Touches of each file in the newest n commits."""
    newest = commits.select("sha", "ts").orderBy(F.desc("ts"), F.desc("sha")).limit(n)
    return touches.join(newest.select("sha"), "sha").groupBy("file").agg(F.count("*").alias("churn"))


# Suffix -> language, and the conventional-subject pattern.
LANGUAGES = {
    "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript",
    "py": "Python", "go": "Go", "rs": "Rust", "rb": "Ruby", "java": "Java", "kt": "Kotlin",
    "swift": "Swift", "cs": "C#", "cpp": "C++", "c": "C",
}
CONVENTIONAL = r"^(feat|fix|chore|docs|style|refactor|test|build|ci|perf|revert)(\(.+\))?(!)?:"


def author_signals(touches: DataFrame, stats: DataFrame | None = None, test_pattern: str = S.TEST_FILE["authors"], conventional: str = CONVENTIONAL) -> DataFrame:
    """Signals per author from touches(author, sha, subject, file) and, when
    given, stats(author, adds, dels) rows.

    Columns: total_commits, test_commit_ratio, primary_dirs (top 3, comma
    joined), primary_language, conventional, avg_lines, tests, depth.
    """
    per_commit = touches.groupBy("author", "sha").agg(
        F.max(F.col("file").rlike(test_pattern)).alias("is_test"), F.max(F.col("subject").rlike(conventional)).alias("conv"))
    base = per_commit.groupBy("author").agg(
        F.count("*").alias("total_commits"),
        (F.count_if("is_test") / F.count("*")).alias("test_commit_ratio"),
        (F.count_if("conv") / F.count("*") > 0.6).alias("conventional"))
    dirs = touches.groupBy("author", S.first_segment("file").alias("dir")).agg(F.count("*").alias("n"))
    top3 = top_k(dirs, ["author"], [F.desc("n"), F.asc("dir")], 3, rank="r").groupBy("author").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "dir"))), lambda x: x["dir"]), ",").alias("primary_dirs"))
    ext = S.suffix_of("file").substr(2, 64)
    exts = touches.select("author", ext.alias("ext")).filter(F.col("ext") != "").groupBy("author", "ext").agg(F.count("*").alias("n"))
    langs = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    lang = exts.groupBy("author").agg(first_by(F.col("ext"), F.struct((-F.col("n")).alias("n"), F.col("ext"))).alias("ext")).select(
        "author", F.coalesce(F.try_element_at(langs, F.col("ext")), F.upper("ext")).alias("primary_language"))
    out = base.join(top3, "author", "left").join(lang, "author", "left")
    if stats is not None:
        mean = stats.groupBy("author").agg(S.half_up(F.sum(F.col("adds") + F.col("dels")) / F.count("*")).cast("bigint").alias("avg_lines"))
        out = out.join(mean, "author", "left")
    else:
        out = out.withColumn("avg_lines", F.lit(0).cast("bigint"))
    ratio, avg = F.col("test_commit_ratio"), F.coalesce("avg_lines", F.lit(0).cast("bigint"))
    return out.select(
        "author", "total_commits", "test_commit_ratio", "primary_dirs",
        F.coalesce("primary_language", F.lit("unknown")).alias("primary_language"), "conventional", avg.alias("avg_lines"),
        F.when(ratio > 0.6, "always").when(ratio > 0.2, "on-request").otherwise("inferred-rarely").alias("tests"),
        F.when(avg > 300, "production-hardened").when(avg > 80, "standard").otherwise("spike").alias("depth"))
