"""Saved graphs, second-source graphs and claim stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["nodes", "edges", "evidence", "unknowns"]

NODE = "id string, kind string, label string, path string, confidence string, metadata map<string,string>, evidence array<string>"
EDGE = "from string, to string, relation string, confidence string, metadata map<string,string>, evidence array<string>"
GRAPH = f"schemaVersion int, graphType string, scope string, commit string, workspaceHash string, nodes array<struct<{NODE}>>, edges array<struct<{EDGE}>>, unknowns array<string>"
RAW_NODE = "id string, label string, kind string, type string, source_file string, source_location string, confidence string, confidence_score double"
RAW_EDGE = "source string, target string, from string, to string, relation string, type string, confidence string, source_file string, source_location string"
CLAIM_FIELDS = ("id:string,kind:string,statement:string,confidence:string,author:string,fact:struct<type:string,path:string,`from`:string,`to`:string,name:string,method:string,route:string,file:string>,"
                "evidence:array<struct<path:string,lines:array<int>,contentHash:string>>")


def save(graph, path: str) -> None:
    """Write the graph's tables; nodes and edges sorted inside their files."""
    for name in TABLES:
        df = getattr(graph, name)
        df.sortWithinPartitions(*[c for c in ("src", "id", "dst", "note") if c in df.columns]).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str):
    from trailgraph.plans.build_graph import Graph

    return Graph(*[spark.read.parquet(f"{path}/{name}") for name in TABLES])


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file; unreadable files give no rows."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def read_graph_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes, edges, unknowns and meta of JSON graph documents; `ord` is the
    place in the document."""
    doc = _document(spark, path, _schema(GRAPH))
    n = doc.select(F.posexplode("nodes").alias("ord", "x")).select("x.*", F.col("ord").cast("bigint").alias("ord"))
    e = doc.select(F.posexplode("edges").alias("ord", "x")).select(F.col("x.from").alias("src"), F.col("x.to").alias("dst"), "x.relation", "x.confidence", "x.metadata", "x.evidence", F.col("ord").cast("bigint").alias("ord"))
    flag = lambda df: df.withColumn("trust_state", F.try_element_at("metadata", F.lit("trustState"))).withColumn("provider", F.try_element_at("metadata", F.lit("provider"))).withColumn(
        "churn", F.try_element_at("metadata", F.lit("churn")).try_cast("bigint")).withColumn("is_test", F.coalesce(F.try_element_at("metadata", F.lit("isTest")).try_cast("boolean"), F.lit(False)))
    return {"nodes": flag(n), "edges": flag(e), "unknowns": doc.select(F.explode("unknowns").alias("note")), "meta": doc.select("schemaVersion", "graphType", "scope", "commit", "workspaceHash")}


def _schema(fields: str) -> str:
    """Top-level DDL whose nested struct fields use the name:type form."""
    out = fields
    for part in (NODE, EDGE, RAW_NODE, RAW_EDGE):
        out = out.replace(part, ",".join(f"`{n}`:{t}" for n, t in (f.strip().split(" ", 1) for f in part.split(", "))))
    return out


def read_provider_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Raw nodes and edges of a second source; edges may be called links, and
    their ends source/target or from/to."""
    doc = _document(spark, path, _schema(f"nodes array<struct<{RAW_NODE}>>, edges array<struct<{RAW_EDGE}>>, links array<struct<{RAW_EDGE}>>"))
    n = doc.select(F.posexplode("nodes").alias("ord", "x")).select(F.col("x.id").alias("raw_id"), F.coalesce("x.label", "x.id").alias("label"), F.coalesce("x.kind", "x.type", F.lit("provider-symbol")).alias("kind"),
                                                                     "x.source_file", "x.source_location", "x.confidence", "x.confidence_score", F.col("ord").cast("bigint").alias("ord"))
    e = doc.select(F.posexplode(F.coalesce("edges", "links")).alias("ord", "x")).select(
        F.coalesce("x.source", "x.from").alias("source"), F.coalesce("x.target", "x.to").alias("target"), F.coalesce("x.relation", "x.type").alias("relation"), "x.confidence", "x.source_file", "x.source_location", F.col("ord").cast("bigint").alias("ord"))
    return {"nodes": n, "edges": e}


def read_run_manifest(spark: SparkSession, path: str, provider: str) -> tuple[DataFrame, DataFrame]:
    """(hashes: path, expected; problems: note) of a second source's run manifest.

    A manifest of another version or provider gives no hashes and one note, so
    nothing the run reports counts as current. No readable file gives neither.
    """
    doc = _document(spark, path, "schemaVersion int, provider string, providerVersion string, sourceCommit string, sourceHashes map<string,string>")
    valid = F.coalesce((F.col("schemaVersion") == 1) & (F.col("provider") == provider), F.lit(False))
    name = provider[:1].upper() + provider[1:]
    bad = doc.filter(~valid).select(F.lit(f"{name} evidence manifest is invalid and was ignored.").alias("note")).distinct()
    return doc.filter(valid).select(F.explode("sourceHashes").alias("path", "expected")), bad


def read_claims(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(claims: id, kind, fact_key), (evidence: claim_id, path, start, end, hash)."""
    doc = _document(spark, path, "claims array<struct<" + CLAIM_FIELDS + ">>")
    c = doc.select(F.explode("claims").alias("c")).select("c.*")
    f = F.col("fact")
    key = F.when(f.isNotNull(), F.concat_ws("|", f["type"], f["path"], f["from"], f["to"], f["name"], f["method"], f["route"], f["file"]))
    ev = c.select(F.col("id").alias("claim_id"), F.explode("evidence").alias("e")).select("claim_id", "e.path", F.try_element_at("e.lines", F.lit(1)).alias("start"), F.try_element_at("e.lines", F.lit(2)).alias("end"), F.col("e.contentHash").alias("hash"))
    return c.select("id", F.coalesce("kind", F.lit("asserted")).alias("kind"), key.alias("fact_key")), ev
