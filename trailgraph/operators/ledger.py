"""Ledgers: experiments, flights, telemetry, verification records, memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgraph.functions import scalar as S
from trailgraph.functions.ranking import exact_median, top_k
from trailgraph.runtime import dealt


# -- telemetry ---------------------------------------------------------------

def transcript_totals(lines: DataFrame) -> DataFrame:
    """Per session: turns with usage, token sums and whether a context tool ran.

    lines: session_id, line (one JSON message per line; bad lines are skipped,
    the message may be nested under "message", content a string or an array).
    """
    doc = F.try_parse_json("line")

    def get(path: str, kind: str) -> Column:
        return F.coalesce(F.try_variant_get(doc, f"$.message.{path}", kind), F.when(F.try_variant_get(doc, "$.message", "variant").isNull(), F.try_variant_get(doc, f"$.{path}", kind)))

    zero = F.lit(0).cast("bigint")
    tools = F.from_json(F.coalesce(F.get_json_object("line", "$.message.content"), F.get_json_object("line", "$.content")), "array<struct<type:string,name:string>>")
    rows = lines.filter(doc.isNotNull()).select(
        "session_id", get("usage", "variant").isNotNull().alias("u"),
        F.coalesce(get("usage.input_tokens", "bigint"), zero).alias("i"), F.coalesce(get("usage.output_tokens", "bigint"), zero).alias("o"),
        F.coalesce(get("usage.cache_read_input_tokens", "bigint"), zero).alias("c"),
        F.coalesce(F.exists(tools, lambda t: (t["type"] == "tool_use") & t["name"].contains("get_context")), F.lit(False)).alias("ctx"))
    used = F.col("u")
    return rows.groupBy("session_id").agg(
        F.count_if(used).alias("turns"), F.coalesce(F.sum(F.when(used, F.col("i"))), zero).alias("input_tokens"),
        F.coalesce(F.sum(F.when(used, F.col("o"))), zero).alias("output_tokens"), F.coalesce(F.sum(F.when(used, F.col("c"))), zero).alias("cache_read_tokens"),
        F.max("ctx").alias("context_used"))


def cohorts(sessions: DataFrame) -> DataFrame:
    """With and without context: sessions, input per turn (ratio of sums),
    output per session, turns. Both rows always appear."""
    agg = sessions.groupBy("context_used").agg(F.count("*").alias("n"), F.sum("turns").alias("t"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    both = sessions.sparkSession.createDataFrame([(True,), (False,)], "context_used boolean").join(agg, "context_used", "left")
    n, t = F.coalesce("n", F.lit(0)), F.coalesce("t", F.lit(0))
    zero = F.lit(0).cast("bigint")
    return both.select(
        "context_used", n.cast("bigint").alias("sessions"),
        F.when(t > 0, S.half_up(F.col("i") / t).cast("bigint")).otherwise(zero).alias("avg_input_per_turn"),
        F.when(n > 0, S.half_up(F.col("o") / n).cast("bigint")).otherwise(zero).alias("avg_output_per_session"),
        F.when(n > 0, S.half_up(t / n, 1)).otherwise(0.0).alias("avg_turns"))


# -- experiments -------------------------------------------------------------

def compare_metric(df: DataFrame, goal: Column, baseline: str = "baseline", measured: str = "measured", tolerance: float = 0.0, target: float = 0.0) -> DataFrame:
    """Add delta_percent and improved for minimize, maximize or target goals."""
    b, m = F.col(baseline), F.col(measured)
    denom = F.when(F.abs(b) == 0, 1.0).otherwise(F.abs(b))
    gap_b, gap_m = F.abs(b - target), F.abs(m - target)
    low = 1 - tolerance / 100
    better = (F.when(goal == "minimize", (m <= b * low) & (m < b)).when(goal == "maximize", (m >= b * (1 + tolerance / 100)) & (m > b))
              .otherwise((gap_m <= gap_b * low) & (gap_m < gap_b)))
    return df.withColumn("delta_percent", S.half_up((m - b) / denom * 100, 2)).withColumn("improved", better)


def numeric_metric(output: Column | str, pattern: str | None = None) -> Column:
    """Number in command output: own pattern, else a labelled number, else the last number."""
    text = S.col(output)
    # Metric labels.
    label = r"(?i)(?:latency|p95|p99|time|score|duration|memory|errors?|count|size)[\s:=]+([0-9]+(?:\.[0-9]+)?)"
    options = [F.regexp_extract(text, label, 1).try_cast("double"),
               F.try_element_at(F.regexp_extract_all(text, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(1)), F.lit(-1)).try_cast("double")]
    if pattern:
        import re

        group = 1 if re.compile(pattern).groups else 0
        options.insert(0, F.regexp_replace(F.regexp_extract(text, f"(?m){pattern}", group), r"[^0-9.-]", "").try_cast("double"))
    return F.coalesce(*options)


def rounded_median(values: DataFrame, column: str) -> DataFrame:
    """Median with the even-count mean rounded half up, and the maximum; 0 for
    no values."""
    m = exact_median(values, [], column).agg(F.max("median")).scalar()
    return values.agg(F.coalesce(S.half_up(m).cast("bigint"), F.lit(0).cast("bigint")).alias("median"), F.coalesce(F.max(column), F.lit(0)).cast("bigint").alias("maximum"))


def replay_summary(commits: DataFrame) -> DataFrame:
    """Share of source-touching commits whose facts changed; churn of those.
    commits: source_touched, added, removed."""
    t = commits.filter("source_touched").withColumn("churn", F.col("added") + F.col("removed"))
    seen = F.col("churn") > 0
    middle = exact_median(t.filter(seen), [], "churn").agg(F.max("median")).scalar()
    zero = F.lit(0).cast("bigint")
    return t.agg(F.count("*").alias("touched"), F.count_if(seen).alias("detected"),
                 S.half_up(F.count_if(seen) / F.count("*"), 3).alias("detection_rate"),
                 F.coalesce(F.max(F.when(seen, F.col("churn"))), zero).cast("bigint").alias("max_churn")).withColumn(
        "median_churn", F.coalesce(S.half_up(middle).cast("bigint"), zero))


def step_verdict(in_scope: Column, gates_ok: Column, tests_ok: Column, improved: Column) -> Column:
    """struct(verdict, revert_reason): first failing tier decides."""
    reason = (F.when(~in_scope, "out_of_bounds").when(~gates_ok, "gate_failed").when(~tests_ok, "test_failed").when(~improved, "metric_regressed"))
    return F.struct(F.when(reason.isNull(), "KEEP").otherwise("REVERT").alias("verdict"), reason.alias("revert_reason"))


def history_summary(experiments: DataFrame) -> DataFrame:
    n = F.count("*")
    keep = F.count_if(F.col("verdict") == "KEEP")
    return experiments.agg(n.alias("total"), keep.alias("kept"), F.count_if(F.col("verdict") == "REVERT").alias("reverted"), S.half_up(100 * keep / n).cast("bigint").alias("kept_percent"))


def prune_expired(experiments: DataFrame, as_of: Column, ttl_days: int = 30) -> DataFrame:
    """Drop reverted experiments closed before the cut-off; keep all others."""
    old = F.coalesce(S.micros("closed_at") < S.micros(as_of) - ttl_days * S.MICROS_PER_DAY, F.lit(False))
    return experiments.filter(~((F.col("verdict") == "REVERT") & old))


def negative_constraints(experiments: DataFrame, as_of: Column, terms: list[str], requested: list[str], ttl_days: int = 30, k: int = 5) -> DataFrame:
    """Reverted experiments that bear on a task: same file, or a shared word."""
    live = prune_expired(experiments, as_of, ttl_days).filter("verdict = 'REVERT'")
    task = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    related = (F.col("target_file").isin(requested) | (S.contained("target_file", terms) > 0)
               | F.arrays_overlap(S.words(F.concat_ws(" ", "hypothesis", "goal")), task))
    return live.filter(related).orderBy("ord").limit(k)


# -- flights and verification records ---------------------------------------

def latest_open(flights: DataFrame) -> DataFrame:
    return flights.filter("status = 'open'").orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def predicted_files(declared: DataFrame, evidence: DataFrame) -> DataFrame:
    """Declared files and the files of the impacted nodes' first evidence."""
    f = S.evidence_file("evidence")
    found = evidence.filter(f.rlike(S.SOURCE_SUFFIX)).select(S.slashes(f).alias("path"))
    return declared.select("path").unionByName(found).distinct()


def audit_flight(changed: DataFrame, declared: DataFrame, predicted: DataFrame, by: list[str] | None = None, tasks: int = 1) -> DataFrame:
    """Every changed or declared file: in_bounds, out_of_bounds or untouched.

    ``tasks`` is the least number of tasks that group the marks of the files.
    """
    key = [*(by or []), "path"]
    marks = (
        changed.select(*key, F.lit(True).alias("c"), F.lit(False).alias("d"), F.lit(False).alias("p"))
        .unionByName(declared.select(*key, F.lit(False).alias("c"), F.lit(True).alias("d"), F.lit(False).alias("p")))
        .unionByName(predicted.select(*key, F.lit(False).alias("c"), F.lit(False).alias("d"), F.lit(True).alias("p"))))
    m = dealt(marks, tasks, *key).groupBy(*key).agg(F.max("c").alias("c"), F.max("d").alias("d"), F.max("p").alias("p"))
    state = F.when(F.col("c"), F.when(F.col("d") | F.col("p"), "in_bounds").otherwise("out_of_bounds")).when(F.col("d"), "untouched")
    return m.select(*key, state.alias("state")).filter(F.col("state").isNotNull())


def flight_verdict(audit: DataFrame, by: list[str]) -> DataFrame:
    n = {s: F.count_if(F.col("state") == s).alias(s) for s in ("in_bounds", "out_of_bounds", "untouched")}
    return audit.groupBy(*by).agg(*n.values()).withColumn("verdict", F.when(F.col("out_of_bounds") == 0, "clean").otherwise("flagged"))


def actual_changes(dirty: DataFrame, baseline_dirty: DataFrame, committed: DataFrame) -> DataFrame:
    """Dirty now but not at the baseline, plus committed since; source files only."""
    new = dirty.select("path").join(baseline_dirty.select("path"), "path", "left_anti")
    return new.unionByName(committed.select("path").filter(F.col("path").rlike(S.SOURCE_SUFFIX))).distinct()


def _file_bits(name: str) -> list[Column]:
    """Aggregates: four 64-bit masks in which every file key `_k` sets one bit."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("_k", F.lit(64)).cast("int"))
    word = F.pmod(F.call_function("shiftright", F.col("_k"), F.lit(6)), F.lit(4))
    return [F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"{name}{i}") for i in range(4)]


def covering_records(current: DataFrame, records: DataFrame, record_files: DataFrame, by: list[str]) -> DataFrame:
    """Passing records that hold the current hash of every file of a change.

    current: by, path, hash. record_files: record_id, path, hash. records:
    record_id, verdict, provenance, ord (newest first). A covering record must
    hold the change's rarest file, so only records with that file are tried. A
    record carries 256 bits, one set for each of its files, and the join drops
    records that lack a bit of the change, so of the tries hardly more than the
    covering ones are shuffled; those are then compared file by file. Up to
    there a 64-bit hash stands for (path, hash): it may try too many records,
    never too few.
    """
    key = F.xxhash64("path", "hash").alias("_k")
    tag = current.select(*by, "path", "hash").distinct()
    passing = records.filter("verdict = 'pass'").select("record_id", "provenance", "ord")
    held = record_files.select("record_id", "path", "hash").join(passing.select("record_id"), "record_id", "left_semi").distinct()
    keys = held.select("record_id", key)
    bits = keys.groupBy("record_id").agg(*_file_bits("_r"))
    rarity = keys.groupBy("_k").agg(F.count("*").alias("n"))
    known = tag.select(*by, key).join(rarity, "_k", "left")
    probe = known.groupBy(*by).agg(F.count("*").alias("need"), F.count("n").alias("found"), F.min(F.struct("n", "_k")).alias("m"), *_file_bits("_c")).filter("need = found")
    subset = [F.col(f"_r{i}").bitwiseAND(F.col(f"_c{i}")) == F.col(f"_c{i}") for i in range(4)]
    tries = probe.select(*by, "need", F.col("m._k").alias("_k"), *[f"_c{i}" for i in range(4)]).join(keys.join(bits, "record_id"), "_k").filter(
        subset[0] & subset[1] & subset[2] & subset[3]).select(*by, "need", "record_id").distinct()
    got = tries.join(tag, by).join(held, ["record_id", "path", "hash"], "left_semi").groupBy(*by, "record_id", "need").agg(F.count("*").alias("got"))
    full = got.filter("got = need").join(passing, "record_id")
    out = full.groupBy(*by).agg(F.min(F.struct("ord", "record_id", "provenance")).alias("f"), F.max(F.col("provenance") == "human").alias("h"), F.count("*").alias("records"))
    return out.select(*by, F.col("f.record_id").alias("record_id"), "records", ((F.col("f.provenance") == "agent") & ~F.col("h")).alias("agent_only"))


def coverage_for(current: DataFrame, records: DataFrame, record_files: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Is each change vouched for by a passing record? (verdicts, uncovered files).

    current: by, path, hash (null: unreadable), mtime. records: record_id,
    verdict, provenance, ord (newest first), created_at, versioned (false: made
    without version control, so it vouches by time, for files that have not
    changed since). record_files: record_id, path, hash.

    verdicts: by, covered, record_id, agent_only; a change without readable
    files needs no record. uncovered: by, path, what the newest passing record
    lacks. Records made without version control come newest first, so the newest
    of them decides for every change at once; the others are found through the
    change's rarest file (``covering_records``).
    """
    readable = current.filter(F.col("hash").isNotNull())
    every = current.select(*by).distinct()
    hashed = covering_records(readable, records.filter("versioned"), record_files, by)
    timed = records.filter("verdict = 'pass' and not versioned")
    newest = timed.agg(F.min(F.struct("ord", "created_at", "record_id", "provenance")).alias("t"), F.max(F.when(F.col("provenance") == "human", F.col("created_at"))).alias("human"))
    one = lambda c: newest.select(F.col(c).alias("x")).scalar()
    seen = current.groupBy(*by).agg(F.max("mtime").alias("changed"), F.max(F.col("mtime").isNull()).alias("unknown"), F.count("hash").alias("readable"))
    held = F.coalesce(~F.col("unknown") & (F.col("changed") <= one("t.created_at")), F.lit(False))
    by_time = seen.withColumn("held", held).select(
        *by, "readable", F.when(F.col("held"), one("t.ord")).alias("t_ord"), F.when(F.col("held"), one("t.record_id")).alias("t_record"),
        (one("t.provenance") == "agent").alias("t_agent"), (F.col("changed") <= one("human")).alias("t_human"))
    order = records.select(F.col("record_id").alias("h_record"), F.col("ord").alias("h_ord"))
    by_hash = hashed.select(*by, F.col("record_id").alias("h_record"), F.col("agent_only").alias("h_agent")).join(order, "h_record")
    j = every.join(by_time, by).join(by_hash, by, "left")
    first = F.col("t_ord").isNotNull() & F.coalesce(F.col("t_ord") < F.col("h_ord"), F.lit(True))
    record = F.when(first, F.col("t_record")).otherwise(F.col("h_record"))
    needed = F.col("readable") > 0
    agent = F.when(first, F.col("t_agent") & ~F.coalesce("t_human", F.lit(False))).otherwise(F.col("h_agent"))
    verdicts = j.select(*by, (~needed | record.isNotNull()).alias("covered"), F.when(needed, record).alias("record_id"), F.when(needed & record.isNotNull(), agent).alias("agent_only"))
    latest = records.filter("verdict = 'pass'").agg(F.min(F.struct("ord", "record_id")).alias("m")).select("m.record_id")
    has = record_files.join(latest, "record_id", "left_semi").select("path", "hash").distinct()
    open_ = readable.join(verdicts.filter(~F.col("covered")).select(*by), by, "left_semi")
    return verdicts, open_.join(has, ["path", "hash"], "left_anti").select(*by, "path").distinct()


def newest_records(records: DataFrame, by: list[str], order: list[Column], cap: int = 20) -> DataFrame:
    """Ring buffer: the newest ``cap`` rows of each group."""
    return top_k(records, by, order, cap, rank="position")


# -- project memory ----------------------------------------------------------

# Kinds of learned pattern.
PATTERN_TYPES = ["convention", "regression", "constraint"]


def parse_bullets(content: DataFrame) -> DataFrame:
    """'- ' and '* ' lines of notes as rows: other columns, item."""
    others = [c for c in content.columns if c != "content"]
    line = S.trim("l")
    return content.select(*others, F.explode(F.split("content", "\n")).alias("l")).filter(line.startswith("- ") | line.startswith("* ")).select(
        *others, F.regexp_replace(line, r"^[-*]\s+", "").alias("item"))


def memory_terms(file: str | None = None, topic: str | None = None) -> list[str]:
    import re

    found = re.split(r"[\\/._-]+", file.lower()) if file else []
    found += topic.lower().split() if topic else []
    return [w for w in found if len(w) > 2]


def query_memory(items: DataFrame, terms: list[str], column: str = "item") -> DataFrame:
    """Items holding any of the terms; no terms keeps all."""
    return items.filter(S.contained(column, terms) > 0) if terms else items


def pattern_entry(title: Column, rule: Column, description: Column, files: Column, provenance: Column) -> Column:
    """Bullet text of a learned pattern."""
    ev = F.when(F.size(files) > 0, F.concat(F.lit(" (evidence: "), F.array_join(files, ", "), F.lit(")"))).otherwise("")
    prov = F.when(provenance.isNotNull(), F.concat(F.lit(" [provenance: "), provenance, F.lit("]"))).otherwise("")
    return F.concat(F.lit("- **"), title, F.lit(":** "), rule, F.lit(" ("), description, F.lit(")"), ev, prov)
