"""Graph questions: reachability, impact, callers, paths, degree, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailgraph.functions import scalar as S
from trailgraph.functions.ranking import top_k
from trailgraph.runtime import RoundStore, cut_lineage

CHURN_RISK = 8


def reach(edges: DataFrame, seeds: DataFrame, *, forward: bool = False, max_depth: int | None = None,
          keys: tuple[str, ...] = (), arrival: bool = False) -> DataFrame:
    """Nodes reachable from the seeds, with their distance (seeds are depth 0).

    One round per level: the frontier joins the edge table, duplicates fold
    before the shuffle, and an anti join drops what earlier rounds hold. Each
    round is written once and never recomputed. ``keys`` (for example an origin)
    keeps separate searches apart. With ``arrival`` every node carries the edge
    ordinals of its first-found path, whose lexicographic order is breadth-first
    arrival order; no global row numbering is needed. Seeds then bring ``ord``.
    """
    near, far = ("src", "dst") if forward else ("dst", "src")
    cols = [F.col(near).alias("node"), F.col(far).alias("next")]
    steps = edges.select(*cols, F.col("ord").alias("step")) if arrival else edges.select(*cols)
    steps = cut_lineage(steps)
    group = [*keys, "node"]
    start = seeds.select(*group, *(["ord"] if arrival else []))
    if arrival:
        level = start.groupBy(*group).agg(F.array(F.min("ord").cast("bigint")).alias("arrival"))
    else:
        level = start.distinct()
    level = level.withColumn("depth", F.lit(0).cast("bigint"))
    store = RoundStore(edges.sparkSession, level.schema)
    level = store.append(level)
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        hop = level.join(steps, "node")
        if arrival:
            found = hop.select(*keys, F.col("next").alias("node"), F.concat("arrival", F.array("step")).alias("arrival")).groupBy(*group).agg(
                F.min("arrival").alias("arrival"))
        else:
            found = hop.select(*keys, F.col("next").alias("node")).distinct()
        fresh = found.join(store.all().select(*group), group, "left_anti").withColumn("depth", F.lit(depth).cast("bigint"))
        level = store.append(fresh)
        if level.isEmpty():
            break
    return store.all()


def read_place(evidence: Column | str) -> Column:
    """struct(file, line) of a `path:line` text: where it stands in reading order."""
    e = S.col(evidence)
    line = F.regexp_extract(e, r":(\d+)$", 1)
    return F.struct(F.regexp_replace(e, r":\d+$", "").alias("file"), F.when(line != "", line.cast("bigint")).alias("line"))


def surfacing(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """What reaches the seeds against the edges, each node with the edge that first surfaced it.

    edges: src, dst, ord (any orderable type, such as ``read_place``) and
    optionally confidence, evidence. seeds: node, ord. Columns: node, depth,
    place (order of arrival within a depth), parent, ord, confidence, evidence.

    Every level is numbered in order of (its parent's number, edge), so a node
    carries one pointer instead of its whole path, however deep the search goes.
    A level's numbers come from one range sort of that level; they rise with
    the order but have gaps.
    """
    extra = [c if c in edges.columns else F.lit(None).cast("string").alias(c) for c in ("confidence", "evidence")]
    steps = edges.select(F.col("dst").alias("parent"), F.col("src").alias("node"), "ord", *extra)
    if max_depth != 1:
        steps = cut_lineage(steps)
    kind = edges.schema["ord"].dataType
    seed = seeds.groupBy("node").agg(F.min("ord").alias("_o")).orderBy("_o", "node").select("node", F.lit(0).cast("bigint").alias("depth"), F.monotonically_increasing_id().alias("place"))
    node_type = steps.schema["node"].dataType
    blank = [F.lit(None).cast(node_type).alias("parent"), F.lit(None).cast(kind).alias("ord"), *[F.lit(None).cast("string").alias(c) for c in ("confidence", "evidence")]]
    seed = seed.select(F.col("node").cast(node_type).alias("node"), "depth", "place", *blank)
    store = RoundStore(edges.sparkSession, seed.schema)
    level, depth = store.append(seed), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        hop = level.select(F.col("node").alias("parent"), F.col("place").alias("_p")).join(steps, "parent")
        first = hop.groupBy("node").agg(F.min(F.struct("_p", "ord", "parent", "confidence", "evidence")).alias("m"))
        fresh = first.join(store.all().select("node"), "node", "left_anti").orderBy("m._p", "m.ord", "node")
        level = store.append(fresh.select("node", F.lit(depth).cast("bigint").alias("depth"), F.monotonically_increasing_id().alias("place"), "m.parent", "m.ord", "m.confidence", "m.evidence"))
        if level.isEmpty():
            break
    return store.all()


def change_seeds(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Seeds of a change: the module of every changed path and its symbols.

    Columns: node, known (is there such a node), ord.
    """
    mods = changed.select(S.module_id(S.slashes("path")).alias("node"), F.col("ord")).groupBy("node").agg(F.min("ord").alias("ord"))
    known = mods.join(nodes.select(F.col("id").alias("node"), F.lit(True).alias("known")).distinct(), "node", "left").select(
        "node", F.coalesce("known", F.lit(False)).alias("known"), "ord")
    symbols = nodes.filter(F.col("kind") == "symbol").select(
        F.col("id"), F.when(F.col("id").startswith("symbol:"), S.symbol_module("id")).otherwise(F.concat(F.lit("module:"), F.col("path"))).alias("node"))
    owned = symbols.join(mods, "node").select(F.col("id").alias("node"), F.lit(True).alias("known"), "ord")
    return known.unionByName(owned)


def impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, evidence: bool = True) -> DataFrame:
    """Everything that depends on the seeds, most relevant first when sorted by
    (hop, churn desc nulls last, id).

    Columns: id, kind, label, path, hop, depth, churn, is_test, high_churn and,
    with ``evidence``, of the edge that first surfaced the node: link_ord,
    evidence, through (its target); and place, the order within the depth.
    """
    found = (surfacing(edges, seeds) if evidence else reach(edges, seeds)).filter(F.col("depth") > 0)
    cols = ["id", "kind", "label", "path", "churn"] + (["is_test"] if "is_test" in nodes.columns else [])
    info = nodes.select(*cols).withColumnRenamed("id", "node")
    out = found.join(info, "node", "left")
    is_test = F.coalesce("is_test", F.lit(False)) if "is_test" in nodes.columns else F.coalesce(F.col("path").rlike(S.TEST_FILE["graph"]), F.lit(False))
    return out.select(
        F.col("node").alias("id"), F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("label", F.col("node").cast("string")).alias("label"), "path",
        F.when(F.col("depth") == 1, "direct").otherwise("indirect").alias("hop"), "depth", "churn", is_test.alias("is_test"),
        F.coalesce(F.col("churn") >= CHURN_RISK, F.lit(False)).alias("high_churn"),
        *([F.col("ord").alias("link_ord"), "evidence", F.col("parent").alias("through"), "place"] if evidence else []))


def rank_impact(details: DataFrame, limit: int | None = None) -> DataFrame:
    """Direct first, then highest churn, then id; all of them unless a limit is asked for."""
    ordered = details.orderBy("hop", F.desc(F.coalesce("churn", F.lit(-1))), "id")
    return ordered if limit is None else ordered.limit(limit)


def test_impact(nodes: DataFrame, edges: DataFrame, changed: DataFrame, pattern: str = S.TEST_FILE["impact"]) -> DataFrame:
    """Tests reached by each changed file: test, origin (one row per reason)."""
    by_path = nodes.select(F.col("path").alias("origin"), F.col("id").alias("node"))
    by_id = nodes.select(F.col("id").alias("origin"), F.col("id").alias("node"))
    origins = changed.select(F.col("path").alias("origin")).distinct()
    seeds = by_path.unionByName(by_id).join(origins, "origin")
    hit = reach(edges, seeds, keys=("origin",))
    tests = nodes.filter(F.col("path").rlike(pattern)).select(F.col("id").alias("node"), F.col("path").alias("test"))
    return hit.join(tests, "node").select("test", "origin").distinct()


def find_symbols(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Match names to symbols: exact label or last dotted part; only names with
    no such match fall back to case-insensitive. Columns: name, tier, id, label."""
    # Distinct symbols and names meet at most once by each key: what a popular name matches is never deduplicated.
    sym = nodes.select("id", "label").distinct().withColumn("bare", F.element_at(F.split("label", r"\."), -1))
    keyed = sym.select("id", "label", F.explode(F.array_distinct(F.array("label", "bare"))).alias("key"))
    names = names.select("name").distinct()
    exact = keyed.join(names.withColumn("key", F.col("name")), "key").select("name", F.lit(1).cast("bigint").alias("tier"), "id", "label")
    rest = names.join(keyed.select(F.col("key").alias("name")).distinct(), "name", "left_anti")
    lower = sym.select("id", "label", F.explode(F.array_distinct(F.array(F.lower("label"), F.lower("bare")))).alias("key"))
    loose = lower.join(rest.withColumn("key", F.lower("name")), "key").select(
        "name", F.lit(2).cast("bigint").alias("tier"), "id", "label")
    return exact.unionByName(loose)


def confidence_rank() -> Column:
    return F.when(F.col("confidence") == "verified", 0).when(F.col("confidence") == "inferred", 1).otherwise(2)


def callers(edges: DataFrame, targets: DataFrame, transitive: bool = False) -> DataFrame:
    """Callers of the targets: id, depth, confidence, ordinal and evidence of the
    surfacing edge, through (its target), arrival (order within the depth).
    Targets bring node, ord; edges bring src, dst, confidence, ord."""
    hit = surfacing(edges, targets, None if transitive else 1).filter(F.col("depth") > 0)
    return hit.select(F.col("node").alias("id"), "depth", "confidence", "ord", "evidence", F.col("parent").alias("through"), F.col("place").alias("arrival"))


def rank_callers(found: DataFrame, limit: int = 50) -> DataFrame:
    """Verified before inferred, then breadth-first arrival."""
    return found.orderBy(confidence_rank(), "depth", "arrival").limit(limit)


def resolve_ids(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Resolve each wanted name to one node: id, else label, else path or path
    suffix; ties go to the lowest ord. Suffixes join on equality: every node
    offers the tails of its path."""
    n = nodes.select("id", "label", "path", "ord")
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    keys = (
        n.select(F.col("id").alias("name"), "id", F.lit(0).alias("tier"), "ord")
        .unionByName(n.select(F.col("label").alias("name"), "id", F.lit(1).alias("tier"), "ord"))
        .unionByName(n.filter(F.col("path").isNotNull()).select(F.explode(tails).alias("name"), "id", F.lit(2).alias("tier"), "ord")))
    hit = keys.join(wanted.select("name").distinct(), "name")
    return hit.groupBy("name").agg(F.min(F.struct("tier", "ord", "id")).getField("id").alias("id"))


def simple_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 5, cap: int = 10) -> DataFrame:
    """Cycle-free paths of each (s, t) pair with at most max_depth edges, the
    first ``cap`` in breadth-first order. Columns: s, t, hops, path.

    Both ends are searched first; a partial path only grows along nodes from
    which t is still in reach within the remaining hops, so dead ends are never
    expanded. A pair stops growing once it holds ``cap`` paths.
    """
    spark = edges.sparkSession
    pairs = cut_lineage(pairs.select("s", "t").distinct())
    step = cut_lineage(edges.select("src", "dst", "ord"))
    goal = pairs.filter(F.col("s") != F.col("t")).select("t", F.col("t").alias("node")).distinct()
    to_goal = reach(step, goal, keys=("t",), max_depth=max_depth).select("t", F.col("node").alias("dst"), F.col("depth").alias("left"))
    schema = T.StructType([T.StructField("s", T.StringType()), T.StructField("t", T.StringType()), T.StructField("at", T.StringType()),
                           T.StructField("path", T.ArrayType(T.StringType())), T.StructField("ords", T.ArrayType(T.LongType()))])
    done, open_ = RoundStore(spark, schema), RoundStore(spark, schema)
    text = [F.col(c).cast("string").alias(c) for c in ("s", "t")]
    base = pairs.select(*text, F.col("s").cast("string").alias("at"), F.array(F.col("s").cast("string")).alias("path"),
                        F.array().cast("array<bigint>").alias("ords"))
    done.append(base.filter(F.col("s") == F.col("t")))
    level = open_.append(base.filter(F.col("s") != F.col("t")))
    for hop in range(1, max_depth + 1):
        grown = (
            level.join(step.withColumnRenamed("src", "at"), "at")
            .filter(~F.array_contains("path", F.col("dst")))
            .join(to_goal.filter(F.col("left") <= max_depth - hop), ["t", "dst"])
            .select("s", "t", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), F.concat("ords", F.array("ord")).alias("ords")))
        grown = open_.append(grown)
        if grown.isEmpty():
            break
        done.append(grown.filter(F.col("at") == F.col("t")))
        full = done.all().groupBy("s", "t").agg(F.count("*").alias("n")).filter(F.col("n") >= cap)
        level = grown.filter(F.col("at") != F.col("t")).join(full, ["s", "t"], "left_anti")
    hops = F.size("ords").cast("bigint")
    return top_k(done.all().withColumn("hops", hops), ["s", "t"], [F.asc("hops"), F.asc("ords")], cap).select("s", "t", "hops", "path", "ords")


def in_degree(edges: DataFrame, relation: str | None = None, target_prefix: str | None = None) -> DataFrame:
    e = edges
    if relation:
        e = e.filter(F.col("relation") == relation)
    if target_prefix:
        e = e.filter(F.col("dst").startswith(target_prefix))
    return e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))


def degree(edges: DataFrame) -> DataFrame:
    """Undirected degree: every edge counts at both ends."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def seeds_by_relevance(nodes: DataFrame, terms: list[str], k: int = 8) -> DataFrame:
    """Nodes whose id, label or path hold most of the terms: id, score."""
    text = F.concat_ws(" ", "id", "label", F.coalesce("path", F.lit("")))
    return nodes.select("id", S.contained(text, terms).alias("score")).filter(F.col("score") > 0).orderBy(F.desc("score"), "id").limit(k)


def seeds_by_file(nodes: DataFrame, requested: DataFrame) -> DataFrame:
    """Nodes whose path or evidence file is requested; evidence is optional."""
    paths = F.array(F.col("path")) if "evidence" not in nodes.columns else F.concat(
        F.array(F.col("path")), F.transform("evidence", lambda e: F.substring_index(e, ":", 1)))
    owned = nodes.select("id", F.explode(F.array_distinct(paths)).alias("path"))
    return owned.join(requested.select("path").distinct(), "path", "left_semi").select("id").distinct()


def trust_of(df: DataFrame) -> Column:
    return F.coalesce("trust_state", F.lit("fresh")) if "trust_state" in df.columns else F.lit("fresh")


def neighbourhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds plus one hop both ways over trusted edges: (nodes, induced edges)."""
    e = edges.filter(trust_of(edges) == "fresh")
    s = seeds.select("id")
    out = e.join(s.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    inc = e.join(s.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    chosen = cut_lineage(s.unionByName(out).unionByName(inc).distinct())
    kept = e.join(chosen.withColumnRenamed("id", "src"), "src", "left_semi").join(chosen.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes.filter(trust_of(nodes) == "fresh").join(chosen, "id", "left_semi"), kept


def coverage_gaps(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, pattern: str = S.TEST_FILE["impact"]) -> DataFrame:
    """Symbols without an incoming edge from a test node."""
    tests = nodes.filter(F.col("path").rlike(pattern)).select(F.col("id").alias("src"))
    covered = edges.join(tests, "src", "left_semi").select(F.col("dst").alias("id"))
    return symbols.join(covered, "id", "left_anti")


# Candidate thresholds, caps and the I/O name pattern.
IO_NAME = r"(?i)(db|repo|query|fetch|api|client|service|cache)"


def candidates(nodes: DataFrame, edges: DataFrame, churn: DataFrame, top_n: int = 10) -> DataFrame:
    """Improvement candidates from fan-in, churn and name. churn: path, churn."""
    n = nodes.select("id", "kind", "label", "path", "ord").filter(F.col("path").isNotNull())
    scored = (
        n.join(in_degree(edges), "id", "left").join(churn.select("path", F.col("churn").alias("c")), "path", "left")
        .withColumn("f", F.coalesce("in_degree", F.lit(0))).withColumn("c", F.coalesce("c", F.lit(0))))
    f, c = F.col("f"), F.col("c")
    hot, fan, churny = (c >= 5) & (f >= 2), f >= 3, c >= 8
    category = F.when(hot, "hotspot").when(fan, "fan_in").when(churny, "hotspot").when(F.col("label").rlike(IO_NAME), "caller_chain")
    score = (F.when(hot, F.least(F.lit(95), 50 + c * 3 + f * 5)).when(fan, F.least(F.lit(90), 40 + f * 8))
             .when(churny, F.least(F.lit(85), 30 + c * 4)).otherwise(65)).cast("bigint")
    return (
        scored.withColumn("category", category).filter(F.col("category").isNotNull())
        .select("id", "path", "label", "kind", "category", score.alias("score"), f.cast("bigint").alias("direct_dependents"), c.cast("bigint").alias("churn"), "ord")
        .orderBy(F.desc("score"), "ord").limit(top_n).drop("ord"))


def filter_graph(df: DataFrame, pattern: str | None, fields: list[str], equals: dict[str, str] | None = None, limit: int | None = 100) -> DataFrame:
    """Case-insensitive pattern over any of the fields plus equality filters, in
    reading order. A pattern that is not a valid expression filters nothing."""
    for k, v in (equals or {}).items():
        df = df.filter(F.col(k) == v)
    if pattern:
        import re

        try:
            re.compile(pattern)
            cond = F.lit(False)
            for f in fields:
                cond = cond | F.col(f).rlike(f"(?i){pattern}")
            df = df.filter(cond)
        except re.error:
            pass
    out = df.orderBy("ord")
    return out if limit is None else out.limit(limit)


def link_layer(layers: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Merge display layers: nodes once by id (first layer wins), undirected
    links once by unordered pair, only between known nodes."""
    nodes = links = None
    for rank, (n, e) in enumerate(layers):
        n = n.select("id", "label", F.lit(rank).alias("layer"))
        e = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "kind", F.lit(rank).alias("layer"))
        nodes = n if nodes is None else nodes.unionByName(n)
        links = e if links is None else links.unionByName(e)
    nodes = nodes.groupBy("id").agg(F.min(F.struct("layer", "label")).alias("m")).select("id", "m.label", "m.layer")
    links = links.filter(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.min(F.struct("layer", "kind")).getField("kind").alias("kind"))
    ids = nodes.select("id")
    links = links.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    return nodes, links


def attach_experiments(nodes: DataFrame, edges: DataFrame, experiments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and `evaluated` edges for experiments not yet in the graph.

    Target: a symbol with the wanted label or id tail, else a node of the wanted
    file, else a made-up module id.
    """
    new = experiments.withColumn("node", F.concat(F.lit("experiment:"), "id")).join(nodes.select(F.col("id").alias("node")), "node", "left_anti")
    sym = nodes.filter(F.col("kind") == "symbol")
    by_symbol = new.filter(F.col("target_symbol").isNotNull()).join(
        sym.select(F.explode(F.array_distinct(F.array("label", F.element_at(F.split("id", "#"), -1)))).alias("target_symbol"), F.col("id").alias("hit"), F.col("ord").alias("at")),
        "target_symbol").select("node", "hit", F.col("at").alias("ord"), F.lit(0).alias("tier"))
    by_file = new.select("node", F.col("target_file").alias("name")).join(
        resolve_ids(nodes.withColumn("label", F.lit(None).cast("string")), new.select(F.col("target_file").alias("name"))), "name").select(
        "node", F.col("id").alias("hit"), F.lit(0).cast("bigint").alias("ord"), F.lit(1).alias("tier"))
    best = by_symbol.unionByName(by_file).groupBy("node").agg(F.min(F.struct("tier", "ord", "hit")).getField("hit").alias("hit"))
    tied = new.join(best, "node", "left").withColumn(
        "dst", F.coalesce("hit", F.concat(F.lit("module:"), F.regexp_replace("target_file", r"\.[^/.]+$", ""))))
    new_nodes = tied.select(F.col("node").alias("id"), F.lit("experiment").alias("kind"), F.concat("id", F.lit(" ("), "verdict", F.lit(")")).alias("label"))
    new_edges = tied.select(F.col("node").alias("src"), "dst", F.lit("evaluated").alias("relation"), (F.col("verdict") == "KEEP").alias("improved"))
    return new_nodes, new_edges
