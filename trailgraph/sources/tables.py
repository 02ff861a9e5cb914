"""Views that give warehouse tables the shapes the operators expect: commits and
touches from orders and line items, a property graph from foreign keys, files
and lines from documents, and source trees whose text is built from the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailgraph.runtime import dealt, tasks_for


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread an input that has fewer splits than the session has cores (a small
    table in one row group) before costly per-row work; others stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# -- history ---------------------------------------------------------------

def commits(spark: SparkSession, root: str) -> DataFrame:
    """sha, author, ts, subject"""
    o = table(spark, root, "orders")
    return o.select(
        F.col("o_orderkey").alias("sha"),
        F.col("o_custkey").alias("author"),
        F.col("o_orderdate").alias("ts"),
        F.concat_ws(": ", F.lower(F.regexp_extract("o_orderpriority", r"-(\w+)", 1)), F.col("o_orderstatus")).alias("subject"),
    )


def part_files(spark: SparkSession, root: str) -> DataFrame:
    """partkey -> module, file"""
    return table(spark, root, "part").select(
        F.col("p_partkey").alias("partkey"),
        F.col("p_brand").alias("module"),
        F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("file"),
    )


def touch_keys(spark: SparkSession, root: str) -> DataFrame:
    """sha, partkey: one row per line item, unlabelled"""
    return table(spark, root, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("partkey"))


def touches(spark: SparkSession, root: str) -> DataFrame:
    """sha, author, ts, subject, module, file"""
    return (
        touch_keys(spark, root)
        .join(commits(spark, root), "sha")
        .join(part_files(spark, root), "partkey")
        .select("sha", "author", "ts", "subject", "module", "file")
    )


# -- foreign-key graph -----------------------------------------------------

def node_id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def fk_nodes(spark: SparkSession, root: str) -> DataFrame:
    """id, kind, label, path, churn; ord gives the reading order"""
    spec = [
        ("region", "region", "r_regionkey", "r_name", None),
        ("nation", "nation", "n_nationkey", "n_name", None),
        ("supplier", "supplier", "s_suppkey", "s_name", None),
        ("customer", "customer", "c_custkey", "c_name", None),
        ("part", "part", "p_partkey", "p_name", "p_size"),
        ("orders", "order", "o_orderkey", "o_orderpriority", None),
    ]
    out = None
    for rank, (tbl, kind, key, label, churn) in enumerate(spec):
        df = table(spark, root, tbl).select(
            node_id(kind, key).alias("id"),
            F.lit(kind).alias("kind"),
            F.col(label).alias("label"),
            F.concat_ws("/", F.lit(tbl), F.col(key).cast("string")).alias("path"),
            (F.col(churn) if churn else F.lit(None)).cast("bigint").alias("churn"),
            (F.lit(rank * 10**12) + F.col(key)).cast("bigint").alias("ord"),
        )
        out = df if out is None else out.unionByName(df)
    return out


def fk_edges(spark: SparkSession, root: str) -> DataFrame:
    """src (child) -> dst (parent), relation, confidence, ord"""
    def one(tbl, kind, key, other, fk, relation, rank):
        return table(spark, root, tbl).select(
            node_id(kind, key).alias("src"), node_id(other, fk).alias("dst"), F.lit(relation).alias("relation"),
            F.lit("verified").alias("confidence"), (F.lit(rank * 10**12) + F.col(key)).cast("bigint").alias("ord"))

    return (
        one("nation", "nation", "n_nationkey", "region", "n_regionkey", "belongs_to", 1)
        .unionByName(one("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "located_in", 2))
        .unionByName(one("customer", "customer", "c_custkey", "nation", "c_nationkey", "located_in", 3))
        .unionByName(one("orders", "order", "o_orderkey", "customer", "o_custkey", "placed_by", 4))
        .unionByName(item_edges(spark, root))
    )


def item_edges(spark: SparkSession, root: str) -> DataFrame:
    """order -> part and order -> supplier, one edge per distinct pair"""
    li = table(spark, root, "lineitem")
    tasks = tasks_for(li)
    out = None
    for rank, (other, fk, relation) in enumerate([("part", "l_partkey", "contains"), ("supplier", "l_suppkey", "ships_from")], 5):
        df = dealt(li.select("l_orderkey", fk, "l_linenumber"), tasks, "l_orderkey", fk).groupBy("l_orderkey", fk).agg(F.min("l_linenumber").alias("line")).select(
            node_id("order", "l_orderkey").alias("src"), node_id(other, fk).alias("dst"), F.lit(relation).alias("relation"),
            F.lit("verified").alias("confidence"), (F.lit(rank * 10**12) + F.col("l_orderkey") * 100 + F.col("line")).cast("bigint").alias("ord"))
        out = df if out is None else out.unionByName(df)
    return out


def _successors(spark: SparkSession, root: str) -> DataFrame:
    """part -> next part in the same order, one row per place: src, dst, l_orderkey, l_linenumber

    Lines of one order are ordered inside slices of 1024 line numbers; only one
    boundary row per slice is ordered over the whole order, so an order with a
    huge share of all lines still spreads over many tasks.
    """
    li = table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.col("l_linenumber") / 1024).alias("slice"))
    w = W.partitionBy("l_orderkey", "slice").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = li.select(
        "l_orderkey", "l_linenumber", "slice", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"),
        F.first("l_partkey").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("head"))
    ends = rows.filter(F.col("dst").isNull())
    bridge = ends.select("l_orderkey", "l_linenumber", "src", F.lead("head").over(W.partitionBy("l_orderkey").orderBy("slice")).alias("dst"))
    return rows.select("src", "dst", "l_orderkey", "l_linenumber").unionByName(bridge).filter(F.col("dst").isNotNull())


def successor_edges(spark: SparkSession, root: str) -> DataFrame:
    """part -> next part in the same order (cyclic, sparse): src, dst, n"""
    return _successors(spark, root).groupBy("src", "dst").agg(F.count("*").alias("n"))


def located_successors(spark: SparkSession, root: str) -> DataFrame:
    """Successor edges with the first place of each, as `orders/<key>:<line>`: src, dst, n, confidence, evidence"""
    at = F.min(F.struct("l_orderkey", "l_linenumber"))
    found = _successors(spark, root).groupBy("src", "dst").agg(F.count("*").alias("n"), at.alias("at"))
    file = F.format_string("orders/%012d", "at.l_orderkey")
    return found.select("src", "dst", "n", F.when(F.col("n") >= 3, "verified").otherwise("inferred").alias("confidence"), F.concat_ws(":", file, F.col("at.l_linenumber").cast("string")).alias("evidence"))


# -- documents -------------------------------------------------------------

def files(spark: SparkSession, root: str) -> DataFrame:
    """path, content, ext, doc_id"""
    return spread(table(spark, root, "documents")).select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        F.col("text").alias("content"), F.col("lang").alias("ext"), "doc_id")


def lines(files_df: DataFrame, content: str = "content") -> DataFrame:
    """One row per line; line_no counts from 1."""
    others = [c for c in files_df.columns if c != content]
    return files_df.select(*others, F.posexplode(F.split(content, "\n")).alias("pos", "line")).withColumn(
        "line_no", (F.col("pos") + 1).cast("bigint")).drop("pos")


def links(spark: SparkSession, root: str) -> DataFrame:
    """page_id, href: one row per link"""
    return table(spark, root, "pages").select(
        "page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="(/[^"]*)"'), F.lit(1))).alias("href"))


def prompts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "conversations").filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))


def session_log(spark: SparkSession, root: str, spread_out: bool = False) -> DataFrame:
    """Events with the integer k of their JSON props."""
    e = table(spark, root, "events")
    return (spread(e) if spread_out else e).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


# -- source trees whose text comes from the rows ---------------------------

def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """A TypeScript tree: one module per part and one per successor pair.

    Every file's text is built from columns of one row, so a hot part adds rows,
    never one huge text. The narrow part columns are spread before the text is
    made, as a small table may sit in one row group. Columns: path, content.
    """
    part = spread(table(spark, root, "part").select("p_partkey", "p_brand", "p_name", "p_type")).select(
        F.col("p_partkey").cast("string").alias("k"),
        F.regexp_replace("p_brand", "#", "").alias("dir"),
        F.regexp_replace("p_name", " ", "-").alias("pkg"),
        F.upper(F.regexp_replace("p_type", " ", "_")).alias("env"))
    modules = part.select(
        F.concat(F.lit("src/"), F.col("dir"), F.lit("/p"), F.col("k"), F.lit(".ts")).alias("path"),
        F.format_string(
            "// import { ghost } from './ghost%s';\n"
            "/* export { b } from './phantom';\n   two lines */\n"
            "import axios from '%s/sub';\n"
            "import {\n  readFile,\n} from 'node:fs/promises';\n"
            "const sample = \"import { c } from './fixture'\";\n"
            "export async function load%s(x) {\n  const v = process.env.%s;\n  return keep%s(v, axios);\n}\n"
            "const keep%s = (v, a) => {\n  return a.pick(v);\n}\n"
            "export class Box%s {\n  open%s(x) {\n    return load%s(x);\n  }\n}\n",
            "k", "pkg", "k", "env", "k", "k", "k", "k", "k").alias("content"))
    a = part.select(F.col("k").alias("sk"), F.col("dir").alias("sdir"))
    b = part.select(F.col("k").alias("dk"), F.col("dir").alias("ddir"))
    e = successor_edges(spark, root).select(F.col("src").cast("string").alias("sk"), F.col("dst").cast("string").alias("dk"))
    pairs = e.join(a, "sk").join(b, "dk").select(
        F.concat(F.lit("src/"), F.col("sdir"), F.lit("/links/p"), F.col("sk"), F.lit("_p"), F.col("dk"), F.lit(".ts")).alias("path"),
        F.format_string(
            "import { load%s } from '../p%s.js';\n"
            "import type { Box%s } from '../../%s/p%s';\n"
            "import { load%s as other } from '../../%s/p%s.js';\n"
            "import { gone } from './gone%s';\n"
            "export function link(x) {\n  load%s(x);\n  open%s(x);\n  return other(x);\n}\n",
            "sk", "sk", "dk", "ddir", "dk", "dk", "ddir", "dk", "sk", "sk", "dk").alias("content"))
    return modules.unionByName(pairs)
