"""Graph construction: first-wins dedup, merge, validation, dangling ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgraph.functions import scalar as S
from trailgraph.functions.ranking import first_by
from trailgraph.runtime import cut_lineage

EDGE_KEY = ["src", "dst", "relation"]
CONFIDENCES = ["verified", "inferred", "unknown"]


def dedup_nodes(nodes: DataFrame, wins: list[str], merged: list[str]) -> DataFrame:
    """One node per id. ``wins`` columns come from the first row in ord;
    ``merged`` (metadata) columns from the first row that has them. All of it is
    a map-side combined aggregate, so a node seen everywhere is no hot sort."""
    return nodes.groupBy("id").agg(
        F.min(F.struct("ord", *wins)).alias("_f"),
        *[first_by(F.col(c), F.col("ord"), F.col(c).isNotNull()).alias(c) for c in merged]).select("id", *[f"_f.{c}" for c in wins], *merged, "_f.ord")


def dedup_edges(edges: DataFrame, wins: list[str]) -> DataFrame:
    """One edge per (src, dst, relation); the first row wins wholesale."""
    return edges.groupBy(*EDGE_KEY).agg(F.min(F.struct("ord", *wins)).alias("_f")).select(*EDGE_KEY, *[f"_f.{c}" for c in wins], "_f.ord")


def merged_evidence(rows: DataFrame, key: list[str], evidence: str = "evidence") -> DataFrame:
    """Distinct evidence of each key with the ordinal it was first seen at. Kept
    as rows: a hub's evidence has no bound and is never one array."""
    return rows.filter(F.col(evidence).isNotNull()).groupBy(*key, evidence).agg(F.min("ord").alias("ord"))


def first_evidence(evidence_rows: DataFrame, key: list[str]) -> DataFrame:
    return evidence_rows.groupBy(*key).agg(first_by(F.col("evidence"), F.col("ord")).alias("first_evidence"), F.count("*").alias("evidence_count"))


def drop_unknown_sources(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi")


def unknown_targets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is no node, as notes."""
    lost = edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti")
    return lost.select("src", "dst", F.format_string('unresolved target "%s" referenced from "%s"', "dst", "src").alias("note"))


def count_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of each relation and those whose target is no node: relation, kept, dangling.

    Edges are counted by target before they meet the nodes. Without a target
    an edge isn't dangling.
    """
    known = nodes.select(F.col("id").alias("dst"), F.lit(True).alias("_known")).distinct()
    to = edges.groupBy("relation", "dst").agg(F.count("*").alias("_n")).join(known, "dst", "left")
    lost = F.when(F.col("dst").isNotNull() & F.col("_known").isNull(), F.col("_n")).otherwise(0)
    return to.groupBy("relation").agg(F.sum("_n").alias("kept"), F.sum(lost).alias("dangling"))


def provider_only(provider: str = "provider") -> Column:
    """Rows a second source added and the native graph does not confirm."""
    providers = F.coalesce(F.col("providers"), F.array().cast("array<string>"))
    return F.coalesce((F.col(provider).isNotNull()) & ~F.array_contains(providers, "native"), F.lit(False))


def merge_update(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace what changed files own, keep inbound edges of what survives.

    Nodes need id, path, ord; edges src, dst, relation, ord; a boolean
    ``provider_only`` column, where present, marks rows of a second source that
    are dropped and rebuilt later. New rows rank after kept ones.
    """
    key = S.strip_suffix(S.slashes("path"))
    owned = nodes.withColumn("_k", key).join(changed.select(key.alias("_k")).distinct(), "_k", "left_semi").select("id")
    borrowed = nodes.filter("provider_only").select("id") if "provider_only" in nodes.columns else owned.limit(0)
    gone = cut_lineage(owned.unionByName(borrowed).distinct())
    kept_nodes = nodes.join(gone, "id", "left_anti")
    kept_edges = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
    if "provider_only" in nodes.columns:
        kept_edges = kept_edges.join(borrowed.withColumnRenamed("id", "dst"), "dst", "left_anti")
    if "provider_only" in edges.columns:
        kept_edges = kept_edges.filter(~F.col("provider_only"))
    late = F.lit(1 << 60)
    all_nodes = kept_nodes.unionByName(new_nodes.withColumn("ord", F.col("ord") + late), allowMissingColumns=True)
    all_edges = kept_edges.unionByName(new_edges.withColumn("ord", F.col("ord") + late), allowMissingColumns=True)
    wins_n = [c for c in all_nodes.columns if c not in ("id", "ord")]
    wins_e = [c for c in all_edges.columns if c not in (*EDGE_KEY, "ord")]
    merged_nodes = cut_lineage(dedup_nodes(all_nodes, wins_n, []))
    merged_edges = dedup_edges(all_edges, wins_e)
    ids = merged_nodes.select("id")
    merged_edges = merged_edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return merged_nodes, merged_edges


def validate_nodes(nodes: DataFrame) -> DataFrame:
    """Rule violations of node rows: id, violation."""
    rules = [("id is empty", F.coalesce("id", F.lit("")) == ""), ("kind is empty", F.coalesce("kind", F.lit("")) == ""),
             ("confidence is not known", ~F.coalesce(F.col("confidence").isin(CONFIDENCES), F.lit(False)))]
    return _violations(nodes, "id", rules)


def validate_edges(edges: DataFrame) -> DataFrame:
    rules = [(f"{c} is empty", F.coalesce(F.col(c), F.lit("")) == "") for c in EDGE_KEY]
    rules.append(("confidence is not known", ~F.coalesce(F.col("confidence").isin(CONFIDENCES), F.lit(False))))
    return _violations(edges.withColumn("id", F.concat_ws(" ", *EDGE_KEY)), "id", rules)


def _violations(df: DataFrame, key: str, rules: list) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(cond, F.lit(text)) for text, cond in rules]))
    return df.select(key, F.explode(found).alias("violation"))


def external_targets(imports: DataFrame, policy) -> tuple[DataFrame, DataFrame]:
    """Imports of files that the file policy leaves out, re-pointed to `external:` nodes.

    Returns (imports, externals). externals: id, label, excluded_path,
    policy_source, policy_pattern, policy_reason, one row per file. Every
    distinct target is judged once, by the last rule that matches it; the
    imports then meet one row per target.
    """
    # Written, or the decision's filter would be tried on every import before they are made distinct.
    targets = cut_lineage(imports.filter((F.col("kind") == "module") & F.col("target_path").isNotNull()).select(F.col("target_path").alias("path")).distinct())
    decided = targets.select("path", policy.decide(S.slashes("path")).alias("_d")).filter(~F.col("_d.included"))
    out = cut_lineage(decided.select(F.concat(F.lit("external:"), "path").alias("id"), S.basename("path").alias("label"), F.col("path").alias("excluded_path"),
                                     F.col("_d.source").alias("policy_source"), F.col("_d.pattern").alias("policy_pattern"), F.col("_d.reason").alias("policy_reason")))
    j = imports.join(out.select(F.col("excluded_path").alias("target_path"), F.col("id").alias("_id")), "target_path", "left")
    away = F.col("_id").isNotNull()
    cols = {"target": F.coalesce("_id", "target"), "kind": F.when(away, "external").otherwise(F.col("kind")), "target_path": F.when(~away, F.col("target_path"))}
    return j.select(*[cols[c].alias(c) if c in cols else c for c in imports.columns]), out


def name_table(symbols: DataFrame) -> DataFrame:
    """(name, id, module if there): full label and, for methods, the bare name."""
    return symbols.select("id", *[c for c in ("module",) if c in symbols.columns], F.explode(F.array_distinct(F.array("label", F.element_at(F.split("label", r"\."), -1)))).alias("name")).distinct()


def resolve_calls(pending: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Tie pending calls (caller, callee_name, ord, evidence) to symbols.

    A name resolves to the only candidate its module or an imported module
    defines, else to the only candidate anywhere. Uniqueness is decided on
    aggregated tables (one row per name, one row per module and name), so a
    popular name never multiplies its callers by its definitions. A module's
    wanted names meet its imports first, so what else a much imported module
    defines is never paired with its importers.

    Modules are read from the ids of callers and symbols. Tables that know them
    bring them as ``module``, in one type with the imports' ends; ids may then
    be of any type that has an order.
    """
    module_of = lambda df, c: F.col("module") if "module" in df.columns else S.symbol_module(c)
    names = cut_lineage(name_table(symbols))
    everywhere = names.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("only")).filter(F.col("n") == 1).select(
        F.col("name").alias("callee_name"), F.col("only").alias("global_hit"))
    calls = pending.withColumn("module", module_of(pending, "caller"))
    wanted = cut_lineage(calls.select("module", F.col("callee_name").alias("name")).distinct())
    called = names.join(wanted.select("name").distinct(), "name", "left_semi").withColumn("target", module_of(names, "id"))
    called = cut_lineage(called.groupBy("target", "name").agg(F.count("*").alias("ids"), F.min("id").alias("only")))
    # A module sees itself, which matters only where it defines something called.
    itself = called.select(F.col("target").alias("module"), "target")
    scope = imports.select(F.col("src").alias("module"), F.col("dst").alias("target")).unionByName(itself).distinct()
    # Which symbol it is matters only where there is one; until then its module stands for it.
    seen = (
        wanted.join(scope, "module").join(called.select("target", "name", "ids"), ["target", "name"])
        .groupBy("module", "name").agg(F.sum("ids").alias("n"), F.min("target").alias("target")).filter(F.col("n") == 1))
    visible = seen.join(called.select("target", "name", "only"), ["target", "name"]).select("module", F.col("name").alias("callee_name"), F.col("only").alias("scoped_hit"))
    hit = calls.join(visible, ["module", "callee_name"], "left").join(everywhere, "callee_name", "left").withColumn("dst", F.coalesce("scoped_hit", "global_hit"))
    return hit.filter(F.col("dst").isNotNull() & (F.col("dst") != F.col("caller"))).groupBy(F.col("caller").alias("src"), "dst").agg(
        F.lit("calls").alias("relation"), F.lit("inferred").alias("confidence"), first_by(F.col("evidence"), F.col("ord")).alias("evidence"), F.min("ord").alias("ord"))


def attach_churn(modules: DataFrame, churn: DataFrame) -> DataFrame:
    """Add churn by exact path, else by path plus the first known suffix that
    has any. churn: file, churn."""
    # Suffix order.
    order = [".ts", ".tsx", ".js", ".mjs", ".cjs", ".py", ".go", ".rs", ".rb", ".java", ".kt"]
    rel = F.coalesce("path", F.regexp_replace("id", r"^module:", ""))
    keyed = churn.select(F.col("file").alias("_p"), "churn", F.lit(0).alias("_r")).unionByName(
        churn.select(F.regexp_extract("file", r"^(.*?)(\.[a-z]+)$", 1).alias("_p"), "churn",
                     F.array_position(F.array(*map(F.lit, order)), F.regexp_extract("file", r"(\.[a-z]+)$", 1)).cast("int").alias("_r")).filter(F.col("_r") > 0))
    best = keyed.groupBy("_p").agg(F.min(F.struct("_r", "churn")).getField("churn").alias("churn"))
    return modules.withColumn("_p", rel).join(best, "_p", "left").drop("_p")


def mark_tests(nodes: DataFrame, evidence: str = "first_evidence") -> DataFrame:
    rel = F.coalesce(F.translate("path", "\\", "/"), F.regexp_replace("id", r"^module:", ""))
    hit = rel.rlike(S.TEST_FILE["graph"])
    if evidence in nodes.columns:
        hit = hit | F.coalesce(F.col(evidence).rlike(S.TEST_FILE["graph"]), F.lit(False))
    return nodes.withColumn("is_test", hit)


def mark_dev(edges: DataFrame, dev_packages: DataFrame) -> DataFrame:
    dev = dev_packages.select(F.col("id").alias("dst"), F.lit(True).alias("_d")).distinct()
    return edges.join(dev, "dst", "left").withColumn("dev", F.coalesce("_d", F.lit(False)) & (F.col("relation") == "imports")).drop("_d")
