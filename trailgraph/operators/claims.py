"""Facts re-derived from the graph, claims pinned to source spans, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgraph.functions import scalar as S
from trailgraph.functions.ranking import first_by


def derive_facts(nodes: DataFrame, edges: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """Facts of four types, one row per fact_key: type, fact_key, statement, evidence.

    nodes: id, kind, label, path, confidence, declared, dev, evidence.
    edges: src, dst, relation, trust_state, provider, corroborated, evidence.
    routes: method, route, file.
    """
    n = nodes.select("id", "kind", "label", "path", "confidence", "declared", "dev", "evidence")
    sources = n.filter((F.col("kind") == "module") & F.col("path").isNotNull() & (F.col("confidence") == "verified")).select(
        F.lit("source-file").alias("type"), F.concat_ws("|", F.lit("source-file"), "path").alias("fact_key"),
        F.format_string("Source module `%s` is in the approved project scope.", "path").alias("statement"), F.col("path").alias("evidence"))
    trusted = F.coalesce("trust_state", F.lit("fresh")) == "fresh"
    backed = F.col("provider").isNull() | F.coalesce("corroborated", F.lit(False))
    a = n.filter(F.col("path").isNotNull()).select(F.col("id").alias("src"), F.col("path").alias("from_path"))
    b = n.filter(F.col("path").isNotNull() & (F.col("confidence") == "verified")).select(F.col("id").alias("dst"), F.col("path").alias("to_path"))
    imports = edges.filter((F.col("relation") == "imports") & trusted & backed).select("src", "dst", F.col("evidence").alias("e")).join(a, "src").join(b, "dst").select(
        F.lit("module-imports").alias("type"), F.concat_ws("|", F.lit("module-imports"), "from_path", "to_path").alias("fact_key"),
        F.format_string("Module `%s` imports `%s`.", "from_path", "to_path").alias("statement"), F.coalesce("e", "from_path").alias("evidence"))
    packages = n.filter((F.col("kind") == "package") & F.coalesce("declared", F.lit(False)) & ~F.coalesce("dev", F.lit(False))).select(
        F.lit("package-dependency").alias("type"), F.concat_ws("|", F.lit("package-dependency"), "label").alias("fact_key"),
        F.format_string("`%s` is a declared package dependency.", "label").alias("statement"), F.coalesce("evidence", F.lit("package.json")).alias("evidence"))
    out = sources.unionByName(imports).unionByName(packages)
    if routes is not None:
        out = out.unionByName(routes.filter(F.coalesce("route", F.lit("")) != "").select(
            F.lit("http-route").alias("type"), F.concat_ws("|", F.lit("http-route"), "method", "route", "file").alias("fact_key"),
            F.format_string("HTTP route `%s %s` is defined in `%s`.", "method", "route", "file").alias("statement"), F.col("file").alias("evidence")))
    return out.groupBy("fact_key").agg(F.first("type").alias("type"), F.first("statement").alias("statement"), F.min("evidence").alias("evidence"))


def fact_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """fact_key, change (added or removed)."""
    a, b = before.select("fact_key").distinct(), after.select("fact_key").distinct()
    added = b.join(a, "fact_key", "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(a.join(b, "fact_key", "left_anti").withColumn("change", F.lit("removed")))


def evidence_state(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """State of each pinned span: ok, stale or missing.

    evidence: claim_id, path, start, end (both NULL for a whole file), hash.
    Every distinct span is cut and hashed once, then joined back to the claims.
    """
    spans = evidence.select("path", "start", "end").distinct()
    text = F.when(F.col("start").isNull(), F.col("content")).otherwise(S.line_span("content", F.col("start"), F.col("end")))
    now = spans.join(files.select("path", "content"), "path").select("path", "start", "end", S.span_hash(text).alias("now"))
    cond = (F.col("e.path") == F.col("h.path")) & F.col("e.start").eqNullSafe(F.col("h.start")) & F.col("e.end").eqNullSafe(F.col("h.end"))
    state = F.when(F.col("h.now").isNull(), "missing").when(F.col("h.now") == F.col("e.hash"), "ok").otherwise("stale")
    return evidence.alias("e").join(now.alias("h"), cond, "left").select("e.*", F.col("h.now"), state.alias("state"))


def verify_claims(claims: DataFrame, evidence: DataFrame, files: DataFrame, facts: DataFrame) -> DataFrame:
    """id, kind, status, stale, missing. claims: id, kind, fact_key."""
    state = evidence_state(evidence, files).groupBy(F.col("claim_id").alias("id")).agg(
        F.count_if(F.col("state") == "stale").alias("stale"), F.count_if(F.col("state") == "missing").alias("missing"))
    true_facts = facts.select("fact_key", F.lit(True).alias("holds")).distinct()
    c = claims.withColumn("kind", F.when((F.col("kind") == "derived") & F.col("fact_key").isNotNull(), "derived").otherwise("asserted"))
    zero = F.lit(0).cast("bigint")
    j = c.join(state, "id", "left").join(true_facts, "fact_key", "left").withColumn("stale", F.coalesce("stale", zero)).withColumn("missing", F.coalesce("missing", zero))
    status = (F.when(F.col("kind") == "derived", F.when(F.col("holds"), "verified").otherwise("refuted"))
              .when(F.col("missing") > 0, "missing").when(F.col("stale") > 0, "stale").otherwise("unverified"))
    return j.select("id", "kind", status.alias("status"), "stale", "missing")


# Claim states.
STATUSES = ["verified", "refuted", "unverified", "stale", "missing"]


def status_counts(verified: DataFrame) -> DataFrame:
    return verified.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def claims_from_facts(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Derived claims pinned to the current bytes; facts without a file drop.

    Claim ids hash the fact, so they need no global numbering and stay the same
    between runs.
    """
    pinned = facts.withColumn("path", S.evidence_file("evidence"))
    hashed = files.select("path", S.span_hash("content").alias("hash"))
    return pinned.join(hashed, "path").select(
        F.concat(F.lit("CLM-D"), F.substring(F.sha2("fact_key", 256), 1, 12)).alias("id"), F.lit("derived").alias("kind"), "fact_key", "statement", "path", "hash")


def refresh_pins(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Evidence re-pinned to what the files hold now; missing spans keep theirs."""
    s = evidence_state(evidence, files)
    return s.select("claim_id", "path", "start", "end", F.coalesce("now", "hash").alias("hash"), (F.col("state") == "stale").alias("changed"))


def parse_evidence_spec(spec: DataFrame, column: str = "spec") -> DataFrame:
    """'a.ts:10-25,b.ts:7,c.ts' -> path, start, end rows."""
    others = [c for c in spec.columns if c != column]
    t = spec.select(*others, F.explode(F.filter(F.transform(F.split(column, ","), lambda x: S.trim(x)), lambda x: x != "")).alias("token"))
    pat = r"^(.*):(\d+)(?:-(\d+))?$"
    hit = F.col("token").rlike(pat)
    num = lambda g: F.when(F.regexp_extract("token", pat, g) != "", F.regexp_extract("token", pat, g)).cast("int")
    return t.select(*others, F.when(hit, F.regexp_extract("token", pat, 1)).otherwise(F.col("token")).alias("path"),
                    F.when(hit, num(2)).alias("start"), F.when(hit, F.coalesce(num(3), num(2))).alias("end"))


def citations(docs: DataFrame) -> DataFrame:
    """`file:line` citations in documents: doc, file, line."""
    pat = r"`([\w./\-]+\.\w+):(\d+)`"
    found = docs.select(F.col("path").alias("doc"), F.explode(F.arrays_zip(
        F.regexp_extract_all("content", F.lit(pat), F.lit(1)).alias("file"), F.regexp_extract_all("content", F.lit(pat), F.lit(2)).alias("line"))).alias("c"))
    return found.select("doc", F.col("c.file").alias("file"), F.col("c.line").cast("bigint").alias("line")).distinct()


def pin_citations(cites: DataFrame, lines: DataFrame) -> DataFrame:
    """Add the hash of each cited line. lines: path, line_no, line."""
    h = lines.select(F.col("path").alias("file"), F.col("line_no").alias("line"), F.substring(F.sha1("line"), 1, 16).alias("hash"))
    return cites.join(h, ["file", "line"])


def check_citations(pins: DataFrame, lines: DataFrame, window: int = 25, bucket: int | None = None) -> DataFrame:
    """ok, relocated (nearest identical line within the window), stale,
    missing-line or missing-file for every pinned citation.

    Identical lines are found by an equality join on (file, line hash, block of
    lines): a citation looks into the blocks its window touches, so a line text
    that repeats through a huge file meets only its neighbours.
    """
    size = bucket or (2 * window + 1)
    now = lines.select(F.col("path").alias("file"), "line_no", F.substring(F.sha1("line"), 1, 16).alias("hash"))
    same = now.select("file", F.col("line_no").alias("line"), F.col("hash").alias("here"))
    files = now.groupBy("file").agg(F.max("line_no").alias("n_lines"))
    blocked = now.withColumn("block", F.floor(F.col("line_no") / size))
    want = pins.withColumn("block", F.explode(F.sequence(F.floor((F.col("line") - window) / size), F.floor((F.col("line") + window) / size))))
    near = (
        want.join(blocked, ["file", "hash", "block"]).withColumn("dist", F.abs(F.col("line_no") - F.col("line")))
        .filter((F.col("dist") <= window) & (F.col("dist") > 0))
        .groupBy("doc", "file", "line").agg(F.min(F.struct("dist", "line_no")).getField("line_no").alias("relocated_line")))
    j = pins.join(same, ["file", "line"], "left").join(files, "file", "left").join(near, ["doc", "file", "line"], "left")
    status = (F.when(F.col("n_lines").isNull(), "missing-file").when(F.col("here") == F.col("hash"), "ok")
              .when(F.col("relocated_line").isNotNull(), "relocated").when(F.col("here").isNull(), "missing-line").otherwise("stale"))
    return j.select("doc", "file", "line", status.alias("status"), F.when(status == "relocated", F.col("relocated_line")).alias("relocated_line"))


def knowledge_references(docs: DataFrame, known_paths: DataFrame) -> DataFrame:
    """Back-ticked file references, each once with the first document that names
    it, and whether the file exists. docs: path, content, ord."""
    # Suffixes of a file reference.
    pat = r"`([\w./\-]+\.(?:ts|tsx|js|mjs|cjs|py|go|rs|rb|java|kt|json|md|toml|yml|yaml))(?::\d+)?`"
    refs = docs.select("path", "ord", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pat), F.lit(1)))).alias("reference"))
    once = refs.groupBy("reference").agg(first_by(F.col("path"), F.col("ord")).alias("file"))
    have = known_paths.select(F.col("path").alias("reference"), F.lit(True).alias("exists")).distinct()
    return once.join(have, "reference", "left").select("file", "reference", F.coalesce("exists", F.lit(False)).alias("exists"))
