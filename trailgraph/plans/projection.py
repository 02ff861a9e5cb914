"""A second source's evidence projected onto the native graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgraph.operators import trust as TR
from trailgraph.runtime import cut_lineage
from trailgraph.sources.policy import FilePolicy


def project(nodes: DataFrame, edges: DataFrame, raw: dict[str, DataFrame], manifest: tuple[DataFrame, DataFrame], current: DataFrame,
            policy: FilePolicy, provider: str, root: str, workspace: str) -> dict[str, DataFrame]:
    """Nodes, edges, notes and counters after a second source is taken in.

    nodes: id, kind, label, path, confidence, ord; edges: src, dst, relation,
    confidence, ord. raw: nodes and edges of ``read_provider_graph``. manifest:
    of ``read_run_manifest``; where it is invalid the graph stays native and one
    item counts as rejected. current: path, hash of today's files. Rows whose
    file lies outside ``root`` or is left out by the policy are rejected.
    """
    expected, problems = manifest
    broken = not problems.isEmpty()

    def placed(df: DataFrame) -> DataFrame:
        path = TR.source_path("source_file", root, workspace)
        named = TR.text_or_null("source_file").isNotNull()
        out = df.withColumn("_p", path).withColumn("excluded", named & (F.col("_p").isNull() | ~F.coalesce(policy.decide(F.col("_p")).getField("included"), F.lit(True))))
        return out.withColumn("source_file", F.col("_p")).drop("_p")

    hashes = current.select("path", F.col("hash").alias("current")).join(expected, "path", "full")
    raw_nodes, raw_edges = (placed(raw[k].limit(0) if broken else raw[k]) for k in ("nodes", "edges"))
    node_rows = cut_lineage(TR.reconcile_nodes(nodes, raw_nodes, hashes, provider))
    edge_rows = cut_lineage(TR.reconcile_edges(edges, node_rows, raw_edges, hashes))
    counts = TR.counters(node_rows, edge_rows)
    if broken:
        counts = counts.withColumn("rejected_evidence", F.lit(1).cast("bigint"))
    said = problems if broken else TR.notes(counts, provider)
    return {"nodes": TR.project_nodes(nodes, node_rows, provider), "edges": TR.project_edges(edges, edge_rows, provider), "notes": said, "counters": counts}
