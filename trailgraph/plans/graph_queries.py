"""Graph queries over the foreign-key graph and the successor graph."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailgraph.functions.ranking import number_rows
from trailgraph.operators import build as B
from trailgraph.operators import graph as G
from trailgraph.operators import history as H
from trailgraph.plans.registry import query
from trailgraph.runtime import shared_dir
from trailgraph.sources import tables as T
from trailgraph.sources.graph_table import GraphTable

NODES = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'region' AS kind, r_name AS label, 'region/' || r_regionkey AS path, CAST(NULL AS BIGINT) AS churn, CAST(r_regionkey AS BIGINT) AS ord FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, 'nation/' || n_nationkey, NULL, 1000000000000 + n_nationkey FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 'supplier/' || s_suppkey, NULL, 2000000000000 + s_suppkey FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, 'customer/' || c_custkey, NULL, 3000000000000 + c_custkey FROM customer
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, 'part/' || p_partkey, p_size, 4000000000000 + p_partkey FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'order', o_orderpriority, 'orders/' || o_orderkey, NULL, 5000000000000 + o_orderkey FROM orders)"""
EDGES = """edges AS (
  SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'belongs_to' AS relation FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in' FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located_in' FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'placed_by' FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'contains' FROM lineitem
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'ships_from' FROM lineitem)"""
SUCC = """succ AS (SELECT src, dst, count(*) AS n FROM (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem)
  WHERE dst IS NOT NULL GROUP BY ALL)"""

#: Least distance to the parts that the condition names; each level adds only nodes not seen before.
LEVELS = """r(id, depth) USING KEY (id) AS (
  SELECT p_partkey, CAST(0 AS BIGINT) FROM part WHERE {}
  UNION SELECT src, CAST(min(r.depth) + 1 AS BIGINT) FROM r JOIN succ ON dst = r.id LEFT JOIN recurring.r AS seen ON seen.id = src WHERE seen.id IS NULL GROUP BY src)"""


def succ(spark, root):
    """Successor graph with ordinals; frequent pairs count as verified."""
    return T.successor_edges(spark, root).select(
        "src", "dst", (F.col("src") * 10**9 + F.col("dst")).alias("ord"), "n",
        F.when(F.col("n") >= 3, "verified").otherwise("inferred").alias("confidence"))


def part_nodes(spark, root):
    """Parts as symbols labelled Class.method style."""
    return T.table(spark, root, "part").select(
        F.col("p_partkey").alias("id"), F.lit("symbol").alias("kind"), F.regexp_replace("p_name", " ", ".").alias("label"),
        F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("path"),
        F.col("p_size").cast("bigint").alias("churn"), F.col("p_partkey").alias("ord"))


@query("impact_closure", f"""WITH RECURSIVE {EDGES}, r AS (
  SELECT 'region:' || r_regionkey AS id FROM region UNION SELECT src FROM edges JOIN r ON edges.dst = r.id)
SELECT id FROM r WHERE id NOT LIKE 'region:%'""")
def impact_closure(spark, root):
    seeds = T.table(spark, root, "region").select(T.node_id("region", "r_regionkey").alias("node"))
    return G.reach(T.fk_edges(spark, root), seeds).filter(F.col("depth") > 0).select(F.col("node").alias("id"))


@query("impact_depths", f"""WITH RECURSIVE {SUCC}, {LEVELS.format("p_size >= 45")}
SELECT id, depth FROM r WHERE depth > 0""")
def impact_depths(spark, root):
    seeds = T.table(spark, root, "part").filter("p_size >= 45").select(F.col("p_partkey").alias("node"))
    return G.reach(succ(spark, root), seeds).filter(F.col("depth") > 0).select(F.col("node").alias("id"), "depth")


@query("impact_direct_indirect", f"""WITH RECURSIVE {SUCC}, {LEVELS.format("p_size >= 45")},
d AS (SELECT id, depth FROM r WHERE depth > 0),
x AS (SELECT d.id, replace(p_name, ' ', '.') AS label, CASE WHEN depth = 1 THEN 'direct' ELSE 'indirect' END AS hop, CAST(p_size AS BIGINT) AS churn, p_size >= 8 AS high_churn
  FROM d JOIN part ON p_partkey = id)
SELECT * FROM x""")
def impact_direct_indirect(spark, root):
    seeds = T.table(spark, root, "part").filter("p_size >= 45").select(F.col("p_partkey").alias("node"))
    found = G.impact(part_nodes(spark, root), succ(spark, root), seeds, evidence=False)
    return found.select("id", "label", "hop", "churn", "high_churn")


@query("test_impact_reasons", f"""WITH RECURSIVE {NODES}, {EDGES}, r AS (
  SELECT path AS origin, id FROM nodes WHERE kind IN ('region', 'nation') UNION SELECT origin, src FROM edges JOIN r ON edges.dst = r.id)
SELECT path AS test, string_agg(origin, ',' ORDER BY origin) AS reasons, count(*) AS n_reasons
FROM r JOIN nodes USING (id) WHERE regexp_matches(path, '^customer/.*7$') GROUP BY path""")
def test_impact_reasons(spark, root):
    nodes = T.fk_nodes(spark, root)
    changed = nodes.filter(F.col("kind").isin("region", "nation")).select("path")
    hit = G.test_impact(nodes, T.fk_edges(spark, root), changed, pattern=r"^customer/.*7$")
    return hit.groupBy("test").agg(F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("reasons"), F.count("*").alias("n_reasons"))


@query("callers_direct", f"""WITH {SUCC}, t AS (SELECT p_partkey AS id FROM part WHERE p_name LIKE '% ring'),
c AS (SELECT src AS id, arg_min(CASE WHEN n >= 3 THEN 'verified' ELSE 'inferred' END, dst) AS confidence, min(dst) AS first_dst FROM succ SEMI JOIN t ON succ.dst = t.id
  WHERE src NOT IN (SELECT id FROM t) GROUP BY src)
SELECT id, confidence, first_dst * 0 + id * 1000000000 + first_dst AS ord FROM c ORDER BY confidence = 'inferred', first_dst, id LIMIT 50""")
def callers_direct(spark, root):
    names = spark.createDataFrame([("ring",)], "name string")
    targets = G.find_symbols(part_nodes(spark, root), names).select(F.col("id").alias("node"), F.col("id").alias("ord"))
    return G.rank_callers(G.callers(succ(spark, root), targets)).select("id", "confidence", "ord")


@query("callers_transitive", f"""WITH RECURSIVE {SUCC}, {LEVELS.format("p_name LIKE '% ring'")}
SELECT id, depth FROM r WHERE depth > 0""")
def callers_transitive(spark, root):
    names = spark.createDataFrame([("ring",)], "name string")
    targets = G.find_symbols(part_nodes(spark, root), names).select(F.col("id").alias("node"), F.col("id").alias("ord"))
    return G.callers(succ(spark, root), targets, transitive=True).select("id", "depth")


# Breadth-first search in reading order: each level is numbered by (number of the parent, place of the edge).
SURFACED = """e AS (SELECT src, dst, count(*) AS n, min(o * 1000000 + line) AS ord FROM (SELECT l_orderkey AS o, l_linenumber AS line, l_partkey AS src,
    lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL GROUP BY ALL),
  r(id, depth, place, ord, through, n) USING KEY (id) AS (
  SELECT p_partkey, 0::BIGINT, row_number() OVER (ORDER BY p_partkey), NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM part WHERE {seeds}
  UNION SELECT id, depth, row_number() OVER (ORDER BY m, id), m[2], m[3], m[4] FROM (
    SELECT e.src AS id, max(r.depth) + 1 AS depth, min([r.place, e.ord, e.dst, e.n]) AS m FROM r JOIN e ON e.dst = r.id LEFT JOIN recurring.r AS seen ON seen.id = e.src WHERE seen.id IS NULL {stop} GROUP BY e.src)),
  found AS (SELECT id, depth, through, CASE WHEN n >= 3 THEN 'verified' ELSE 'inferred' END AS confidence, printf('orders/%012d:%d', ord // 1000000, ord % 1000000) AS evidence,
    row_number() OVER (ORDER BY depth, place) AS arrival FROM r WHERE depth > 0)"""


def _in_order(found):
    """Dense order of arrival over all depths, for the comparison."""
    dense = number_rows(found.withColumn("_all", F.lit(1)), ["_all", "depth"], "arrival", "_n", width=1 << 33)
    sizes = found.groupBy("depth").agg(F.count("*").alias("_size"))
    before = sizes.select("depth", (F.sum("_size").over(W.orderBy("depth")) - F.col("_size")).alias("_before"))  # one row per depth
    return dense.join(before, "depth").withColumn("arrival", F.col("_n") + F.col("_before"))


@query("impact_details", f"""WITH RECURSIVE {SURFACED.format(seeds="p_size >= 50", stop="")}
SELECT id, replace(p_name, ' ', '.') AS label, CASE WHEN depth = 1 THEN 'direct' ELSE 'indirect' END AS hop, depth, p_size::BIGINT AS churn, through, evidence FROM found JOIN part ON p_partkey = id""")
def impact_details(spark, root):
    seeds = T.table(spark, root, "part").filter("p_size >= 50").select(F.col("p_partkey").alias("node"), F.col("p_partkey").alias("ord"))
    edges = T.located_successors(spark, root).withColumn("ord", G.read_place("evidence"))
    return G.impact(part_nodes(spark, root), edges, seeds).select("id", "label", "hop", "depth", "churn", "through", "evidence")


@query("callers_in_order", f"""WITH RECURSIVE {SURFACED.format(seeds="p_name LIKE '% ring'", stop="")}
SELECT * FROM found""")
def callers_in_order(spark, root):
    names = spark.createDataFrame([("ring",)], "name string")
    targets = G.find_symbols(part_nodes(spark, root), names).select(F.col("id").alias("node"), F.col("id").alias("ord"))
    found = G.callers(T.located_successors(spark, root).withColumn("ord", G.read_place("evidence")), targets, transitive=True)
    return _in_order(found).select("id", "depth", "through", "confidence", "evidence", "arrival")


@query("symbol_lookup_tiered", """WITH names AS (SELECT DISTINCT CASE WHEN p_size > 25 THEN upper(split_part(p_name, ' ', 2)) ELSE split_part(p_name, ' ', 2) END AS name FROM part
  UNION SELECT DISTINCT replace(p_name, ' ', '.') FROM part),
s AS (SELECT p_partkey AS id, replace(p_name, ' ', '.') AS label, split_part(p_name, ' ', 2) AS bare FROM part),
t1 AS (SELECT name, CAST(1 AS BIGINT) AS tier, id, label FROM names JOIN s ON name = label UNION SELECT name, 1, id, label FROM names JOIN s ON name = bare),
t2 AS (SELECT name, CAST(2 AS BIGINT) AS tier, id, label FROM names JOIN s ON lower(name) = lower(bare) OR lower(name) = lower(label) WHERE name NOT IN (SELECT name FROM t1))
SELECT name, tier, label, count(*) AS matches, min(id) AS first_id FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2) GROUP BY ALL""")
def symbol_lookup_tiered(spark, root):
    p = T.table(spark, root, "part")
    bare = F.element_at(F.split("p_name", " "), 2)
    names = p.select(F.when(F.col("p_size") > 25, F.upper(bare)).otherwise(bare).alias("name")).unionByName(p.select(F.regexp_replace("p_name", " ", ".").alias("name")))
    found = G.find_symbols(T.spread(part_nodes(spark, root)), names)
    return found.groupBy("name", "tier", "label").agg(F.count("*").alias("matches"), F.min("id").alias("first_id"))


@query("simple_paths", f"""WITH RECURSIVE {SUCC}, often AS (SELECT * FROM succ WHERE n >= 2), p AS (
  SELECT src AS s, dst AS t, src AS cur, [src] AS path, CAST([] AS BIGINT[]) AS ords FROM often WHERE src <> dst
  UNION ALL SELECT s, t, succ.dst, list_append(path, succ.dst), list_append(ords, succ.src * 1000000000 + succ.dst)
  FROM p JOIN succ ON succ.src = p.cur WHERE p.cur <> p.t AND len(path) <= 3 AND NOT list_contains(path, succ.dst)),
d AS (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY len(ords), ords) AS r FROM p WHERE cur = t)
SELECT CAST(s AS VARCHAR) AS s, CAST(t AS VARCHAR) AS t, CAST(len(ords) AS BIGINT) AS hops, array_to_string(path, '>') AS path FROM d WHERE r <= 10""")
def simple_paths(spark, root):
    e = T.successor_edges(spark, root).select(
        F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), (F.col("src") * 10**9 + F.col("dst")).alias("ord"), "n")
    pairs = e.filter("n >= 2 and src <> dst").select(F.col("src").alias("s"), F.col("dst").alias("t"))
    return G.simple_paths(e, pairs, max_depth=3).select("s", "t", "hops", F.array_join("path", ">").alias("path"))


@query("in_degree_topk", f"""WITH {EDGES} SELECT dst AS id, count(*) AS in_degree FROM edges WHERE relation = 'contains' AND dst LIKE 'part:%' GROUP BY dst ORDER BY in_degree DESC, id LIMIT 10""")
def in_degree_topk(spark, root):
    return G.in_degree(T.fk_edges(spark, root), "contains", "part:").orderBy(F.desc("in_degree"), "id").limit(10)


@query("degree_undirected", f"""WITH {EDGES} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id""")
def degree_undirected(spark, root):
    return G.degree(T.fk_edges(spark, root))


@query("seeds_by_relevance", f"""WITH {NODES}, s AS (SELECT id, CAST(contains(lower(id || ' ' || label || ' ' || path), 'red') AS BIGINT) + CAST(contains(lower(id || ' ' || label || ' ' || path), 'ring') AS BIGINT)
  + CAST(contains(lower(id || ' ' || label || ' ' || path), 'part') AS BIGINT) AS score FROM nodes)
SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 8""")
def seeds_by_relevance(spark, root):
    return G.seeds_by_relevance(T.fk_nodes(spark, root), ["red", "ring", "part"])


NEAR = f"""{SUCC}, s AS (SELECT p_partkey AS id FROM part WHERE p_name = 'red ring'),
sel AS (SELECT id FROM s UNION SELECT dst FROM succ SEMI JOIN s ON succ.src = s.id UNION SELECT src FROM succ SEMI JOIN s ON succ.dst = s.id)"""


def _near(spark, root):
    seeds = T.table(spark, root, "part").filter("p_name = 'red ring'").select(F.col("p_partkey").alias("id"))
    return G.neighbourhood(part_nodes(spark, root), succ(spark, root), seeds)


@query("neighborhood_1hop", f"WITH {NEAR} SELECT id, replace(p_name, ' ', '.') AS label FROM sel JOIN part ON id = p_partkey")
def neighborhood_1hop(spark, root):
    return _near(spark, root)[0].select("id", "label")


@query("neighborhood_edges", f"WITH {NEAR} SELECT src, dst, n FROM succ WHERE src IN (SELECT id FROM sel) AND dst IN (SELECT id FROM sel)")
def neighborhood_edges(spark, root):
    return _near(spark, root)[1].select("src", "dst", "n")


@query("coverage_gap", """SELECT 'part:' || p_partkey AS symbol, p_brand AS file FROM part WHERE p_partkey NOT IN (
  SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')""")
def coverage_gap(spark, root):
    c = T.table(spark, root, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat_ws("/", "c_mktsegment", F.col("c_custkey").cast("string")).alias("seg"))
    o = T.table(spark, root, "orders").join(c, "o_custkey").select(T.node_id("order", "o_orderkey").alias("id"), F.col("seg").alias("path"))
    symbols = T.table(spark, root, "part").select(T.node_id("part", "p_partkey").alias("id"), F.col("p_brand").alias("file"))
    return G.coverage_gaps(o, T.item_edges(spark, root), symbols, pattern=r"^BUILDING/").select(F.col("id").alias("symbol"), "file")


@query("candidate_scores", f"""WITH {SUCC}, f AS (SELECT dst AS id, count(*) AS f FROM succ GROUP BY dst),
c AS (SELECT l_partkey AS id, count(*) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE epoch_us((SELECT max(o_orderdate) FROM orders)) - epoch_us(o_orderdate) BETWEEN 0 AND 90 * 86400000000 GROUP BY l_partkey),
x AS (SELECT p_partkey AS id, p_brand || '/' || p_partkey AS path, replace(p_name, ' ', '.') AS label, coalesce(f, 0) AS f, coalesce(c, 0) AS c FROM part LEFT JOIN f ON f.id = p_partkey LEFT JOIN c ON c.id = p_partkey),
y AS (SELECT *, CASE WHEN c >= 5 AND f >= 2 THEN 'hotspot' WHEN f >= 3 THEN 'fan_in' WHEN c >= 8 THEN 'hotspot' WHEN regexp_matches(label, '(?i)(db|repo|query|fetch|api|client|service|cache)') THEN 'caller_chain' END AS category,
  CAST(CASE WHEN c >= 5 AND f >= 2 THEN least(95, 50 + c * 3 + f * 5) WHEN f >= 3 THEN least(90, 40 + f * 8) WHEN c >= 8 THEN least(85, 30 + c * 4) ELSE 65 END AS BIGINT) AS score FROM x)
SELECT id, path, category, score, f AS direct_dependents, c AS churn FROM y WHERE category IS NOT NULL ORDER BY score DESC, id LIMIT 10""")
def candidate_scores(spark, root):
    newest = T.commits(spark, root).agg(F.max("ts")).scalar()
    churn = H.churn_window(T.touches(spark, root), newest).select(F.col("file").alias("path"), "churn")
    return G.candidates(part_nodes(spark, root), succ(spark, root), churn).select("id", "path", "category", "score", "direct_dependents", "churn")


@query("dangling_edges", f"""WITH {NODES}, {EDGES}, n AS (SELECT id FROM nodes WHERE NOT (kind = 'customer' AND id IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')))
SELECT relation, count(*) AS kept, count(*) FILTER (dst NOT IN (SELECT id FROM n)) AS dangling FROM edges WHERE src IN (SELECT id FROM n) GROUP BY relation""")
def dangling_edges(spark, root):
    nodes = _without_building(spark, root)
    return B.count_dangling(B.drop_unknown_sources(T.fk_edges(spark, root), nodes), nodes)


def _without_building(spark, root):
    drop = T.table(spark, root, "customer").filter("c_mktsegment = 'BUILDING'").select(T.node_id("customer", "c_custkey").alias("id"))
    return T.fk_nodes(spark, root).join(drop, "id", "left_anti")


@query("unknown_targets", f"""WITH {EDGES} SELECT src, dst, 'unresolved target "' || dst || '" referenced from "' || src || '"' AS note
FROM edges WHERE dst IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def unknown_targets(spark, root):
    return B.unknown_targets(T.fk_edges(spark, root), _without_building(spark, root))


# Two copies of the part nodes with different reading order and metadata.
DUP_NODES = """d AS (
  SELECT 'part:' || p_partkey AS id, p_name AS label, CAST(NULL AS BIGINT) AS churn, p_type AS owner, p_partkey * 2 AS ord, 'a' || p_size AS ev FROM part
  UNION ALL SELECT 'part:' || l_partkey, l_returnflag, CAST(l_quantity AS BIGINT), CASE WHEN l_linestatus = 'O' THEN 'late' END, 100000000000 + l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10, 'b' || l_suppkey FROM lineitem)"""


def dup_nodes(spark, root):
    a = T.table(spark, root, "part").select(
        T.node_id("part", "p_partkey").alias("id"), F.col("p_name").alias("label"), F.lit(None).cast("bigint").alias("churn"), F.col("p_type").alias("owner"),
        (F.col("p_partkey") * 2).alias("ord"), F.concat(F.lit("a"), F.col("p_size").cast("string")).alias("evidence"))
    b = T.table(spark, root, "lineitem").select(
        T.node_id("part", "l_partkey").alias("id"), F.col("l_returnflag").alias("label"), F.col("l_quantity").cast("bigint").alias("churn"),
        F.when(F.col("l_linestatus") == "O", "late").alias("owner"),
        (F.lit(10**11) + F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10).cast("bigint").alias("ord"),
        F.concat(F.lit("b"), F.col("l_suppkey").cast("string")).alias("evidence"))
    return a.unionByName(b)


@query("node_dedup_merge", f"""WITH {DUP_NODES}, e AS (SELECT id, ev, min(ord) AS ord FROM d GROUP BY ALL)
SELECT id, arg_min(label, ord) AS label, (SELECT min([x.ord, x.churn]) FROM d x WHERE x.id = d.id AND x.churn IS NOT NULL)[2] AS churn, arg_min(owner, ord) FILTER (owner IS NOT NULL) AS owner,
  (SELECT count(*) FROM e WHERE e.id = d.id) AS evidence_count, (SELECT arg_min(ev, ord) FROM e WHERE e.id = d.id) AS first_evidence FROM d GROUP BY id""")
def node_dedup_merge(spark, root):
    d = dup_nodes(spark, root)
    churn = d.filter("churn is not null").groupBy("id").agg(F.min(F.struct("ord", "churn")).getField("churn").alias("churn"))
    ev = B.first_evidence(B.merged_evidence(d, ["id"]), ["id"])
    return B.dedup_nodes(d, ["label"], ["owner"]).drop("ord").join(churn, "id", "left").join(ev, "id")


DUP_EDGES = """d AS (SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, 'contains' AS relation,
  CASE WHEN l_returnflag = 'A' THEN 'verified' ELSE 'inferred' END AS confidence, 'line:' || l_linenumber AS ev, l_linenumber * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS ord FROM lineitem)"""


def dup_edges(spark, root):
    return T.table(spark, root, "lineitem").select(
        T.node_id("order", "l_orderkey").alias("src"), T.node_id("part", "l_partkey").alias("dst"), F.lit("contains").alias("relation"),
        F.when(F.col("l_returnflag") == "A", "verified").otherwise("inferred").alias("confidence"),
        F.concat(F.lit("line:"), F.col("l_linenumber").cast("string")).alias("evidence"),
        (F.col("l_linenumber") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("bigint")).alias("ord"))


@query("edge_dedup_merge", f"""WITH {DUP_EDGES} SELECT src, dst, relation, min([CAST(ord AS VARCHAR).lpad(12, '0'), confidence])[2] AS confidence, count(DISTINCT ev) AS evidence_count FROM d GROUP BY src, dst, relation""")
def edge_dedup_merge(spark, root):
    d = dup_edges(spark, root)
    ev = B.first_evidence(B.merged_evidence(d, B.EDGE_KEY), B.EDGE_KEY).drop("first_evidence")
    return B.dedup_edges(d, ["confidence"]).drop("ord").join(ev, B.EDGE_KEY)


MERGED = f"""{NODES}, {EDGES},
changed AS (SELECT 'nation:' || n_nationkey AS id, n_nationkey FROM nation WHERE n_regionkey = 1),
keep AS (SELECT id, kind, label, path FROM nodes WHERE id NOT IN (SELECT id FROM changed)),
n2 AS (SELECT * FROM keep UNION ALL SELECT id, 'nation', 'updated ' || n_nationkey, 'nation/' || n_nationkey FROM changed WHERE n_nationkey % 2 = 0),
e2 AS (SELECT src, dst, relation FROM edges WHERE src NOT IN (SELECT id FROM changed) UNION SELECT id, 'region:2', 'belongs_to' FROM changed WHERE n_nationkey % 2 = 0),
ok AS (SELECT * FROM e2 WHERE src IN (SELECT id FROM n2) AND dst IN (SELECT id FROM n2))"""


def _change(spark, root):
    """(new nodes, new edges, changed paths): one region's nations change, those with odd keys go."""
    nation = T.table(spark, root, "nation").filter("n_regionkey = 1")
    path = F.concat_ws("/", F.lit("nation"), F.col("n_nationkey").cast("string")).alias("path")
    fresh, ord_ = nation.filter("n_nationkey % 2 = 0"), F.col("n_nationkey").cast("bigint").alias("ord")
    new_nodes = fresh.select(T.node_id("nation", "n_nationkey").alias("id"), F.lit("nation").alias("kind"), F.concat(F.lit("updated "), F.col("n_nationkey").cast("string")).alias("label"),
                             path, F.lit(None).cast("bigint").alias("churn"), ord_)
    new_edges = fresh.select(T.node_id("nation", "n_nationkey").alias("src"), F.lit("region:2").alias("dst"), F.lit("belongs_to").alias("relation"), F.lit("verified").alias("confidence"), ord_)
    return new_nodes, new_edges, nation.select(path)


@query("incremental_merge", f"""WITH {MERGED}
SELECT id, label, (SELECT count(*) FROM ok WHERE ok.src = n2.id) AS out_edges FROM n2 WHERE id LIKE 'nation:%' OR id LIKE 'customer:%'""")
def incremental_merge(spark, root):
    nodes, edges = B.merge_update(T.fk_nodes(spark, root), T.fk_edges(spark, root), *_change(spark, root))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_edges"))
    return nodes.filter("kind in ('nation', 'customer')").join(out, "id", "left").select("id", "label", F.coalesce("out_edges", F.lit(0).cast("bigint")).alias("out_edges"))


def _stored(spark, root):
    """The foreign-key graph as a stored table, before and after the change."""
    folder = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    before = GraphTable.create(folder, T.fk_nodes(spark, root), T.fk_edges(spark, root), buckets=32)
    return before, before.merge(*_change(spark, root))


@query("stored_merge_nodes", f"WITH {MERGED} SELECT id, kind, label, path FROM n2")
def stored_merge_nodes(spark, root):
    return _stored(spark, root)[1].nodes.select("id", "kind", "label", "path")


@query("stored_merge_edges", f"WITH {MERGED} SELECT src, dst, relation FROM ok")
def stored_merge_edges(spark, root):
    return _stored(spark, root)[1].edges.select("src", "dst", "relation")


@query("stored_merge_reverse", f"WITH {MERGED} SELECT dst, relation, count(*) AS n FROM ok GROUP BY ALL")
def stored_merge_reverse(spark, root):
    return _stored(spark, root)[1].read("inbound").groupBy("dst", "relation").agg(F.count("*").alias("n"))


@query("graph_validate", """WITH x AS (SELECT CASE WHEN l_returnflag = 'R' THEN '' ELSE 'order:' || l_orderkey END AS src, 'part:' || l_partkey AS dst, CASE WHEN l_discount = 0.05 THEN NULL ELSE 'contains' END AS relation,
  CASE WHEN l_linestatus = 'O' THEN 'verified' ELSE 'certain' END AS confidence FROM lineitem),
v AS (SELECT 'src is empty' AS violation FROM x WHERE src = '' UNION ALL SELECT 'relation is empty' FROM x WHERE relation IS NULL UNION ALL SELECT 'confidence is not known' FROM x WHERE confidence = 'certain')
SELECT violation, count(*) AS n FROM v GROUP BY violation""")
def graph_validate(spark, root):
    x = T.table(spark, root, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "").otherwise(T.node_id("order", "l_orderkey")).alias("src"), T.node_id("part", "l_partkey").alias("dst"),
        F.when(F.col("l_discount") != 0.05, "contains").alias("relation"), F.when(F.col("l_linestatus") == "O", "verified").otherwise("certain").alias("confidence"))
    return B.validate_edges(x).groupBy("violation").agg(F.count("*").alias("n"))


@query("graph_filter", f"""WITH {NODES} SELECT id, kind, label FROM nodes WHERE kind = 'part' AND (regexp_matches(id, '(?i)RING|99$') OR regexp_matches(label, '(?i)RING|99$')) ORDER BY ord LIMIT 100""")
def graph_filter(spark, root):
    return G.filter_graph(T.fk_nodes(spark, root), "RING|99$", ["id", "label"], {"kind": "part"}).select("id", "kind", "label")


@query("link_graph", f"""WITH {SUCC}, {EDGES},
l AS (SELECT 'part:' || least(src, dst) AS a, 'part:' || greatest(src, dst) AS b FROM succ WHERE src <> dst),
u AS (SELECT least(a, b) AS a, greatest(a, b) AS b, 'follows' AS kind FROM l UNION SELECT least(src, dst), greatest(src, dst), 'belongs_to' FROM edges WHERE relation IN ('belongs_to', 'located_in'))
SELECT kind, count(*) AS links, count(DISTINCT a) AS left_ends FROM u GROUP BY kind""")
def link_graph(spark, root):
    nodes = T.fk_nodes(spark, root).select("id", "label")
    fk = T.fk_edges(spark, root).filter("relation in ('belongs_to', 'located_in')").select("src", "dst", F.lit("belongs_to").alias("kind"))
    s = T.successor_edges(spark, root).select(T.node_id("part", "src").alias("src"), T.node_id("part", "dst").alias("dst"), F.lit("follows").alias("kind"))
    _, links = G.link_layer([(nodes, fk), (nodes.filter(F.col("id").startswith("part:")), s)])
    return links.groupBy("kind").agg(F.count("*").alias("links"), F.countDistinct("a").alias("left_ends"))


@query("unique_name_resolution", f"""WITH pend AS (SELECT DISTINCT l_orderkey AS caller, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
imp AS (SELECT DISTINCT l_orderkey AS caller, l_suppkey AS target FROM lineitem),
sym AS (SELECT DISTINCT l_suppkey AS target, p_name AS name, l_suppkey || '#' || p_name AS id FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT name, count(DISTINCT id) AS n, min(id) AS only FROM sym GROUP BY name),
s AS (SELECT caller, name, count(*) AS n, min(id) AS only FROM pend JOIN imp USING (caller) JOIN sym USING (target, name) GROUP BY ALL)
SELECT pend.caller AS caller, CASE WHEN s.n = 1 THEN s.only ELSE g.only END AS resolved FROM pend LEFT JOIN s ON s.caller = pend.caller AND s.name = pend.name LEFT JOIN g ON g.name = pend.name
WHERE s.n = 1 OR g.n = 1""")
def unique_name_resolution(spark, root):
    li = T.table(spark, root, "lineitem").join(T.table(spark, root, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    # Modules are numbers: orders even, suppliers odd. The operator makes rows distinct.
    order, supplier = F.col("l_orderkey") * 2, F.col("l_suppkey") * 2 + 1
    caller = F.concat(F.lit("symbol:o"), F.col("l_orderkey").cast("string"), F.lit("#main"))
    pending = li.select(caller.alias("caller"), order.alias("module"), F.col("p_name").alias("callee_name"), F.lit(0).cast("bigint").alias("ord"), F.lit("x").alias("evidence"))
    imports = li.select(order.alias("src"), supplier.alias("dst"))
    symbols = li.select(F.concat(F.lit("symbol:s"), F.col("l_suppkey").cast("string"), F.lit("#"), F.col("p_name")).alias("id"), supplier.alias("module"), F.col("p_name").alias("label"))
    hit = B.resolve_calls(pending, symbols, imports)
    return hit.select(F.regexp_extract("src", r"symbol:o(\d+)#", 1).cast("bigint").alias("caller"), F.regexp_replace("dst", "^symbol:s", "").alias("resolved"))
