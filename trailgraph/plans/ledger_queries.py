"""Telemetry, experiments, flights, records, memory and phase queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailgraph.functions import scalar as S
from trailgraph.functions.ranking import exact_median
from trailgraph.operators import clarity as CL
from trailgraph.operators import graph as G
from trailgraph.operators import ledger as L
from trailgraph.plans.registry import query
from trailgraph.runtime import tasks_for
from trailgraph.sources import tables as T

# One transcript line per event: usage and tool use follow the event type;
# errors are unreadable lines, views carry no usage, sign-ups are not nested.
TRANSCRIPT = """e AS (SELECT user_id AS session_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v FROM events),
tt AS (SELECT session_id, count(*) FILTER (event_type IN ('purchase', 'click', 'signup')) AS turns, CAST(coalesce(sum(k) FILTER (event_type IN ('purchase', 'click', 'signup')), 0) AS BIGINT) AS input_tokens,
  CAST(coalesce(sum(v) FILTER (event_type IN ('purchase', 'click', 'signup')), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(k * 2) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS cache_read_tokens, bool_or(event_type = 'purchase' AND k > 90) AS context_used
  FROM e WHERE event_type <> 'error' GROUP BY session_id)"""


def transcript(spark, root):
    e = T.session_log(spark, root, spread_out=True)
    kind, k, v = F.col("event_type"), F.col("k"), F.floor("value").cast("bigint")
    tool = F.when(k > 90, "mcp__get_context").otherwise("Bash")
    line = (F.when(kind == "purchase", F.format_string('{"type":"assistant","message":{"role":"assistant","usage":{"input_tokens":%d,"output_tokens":%d,"cache_read_input_tokens":%d},"content":[{"type":"text"},{"type":"tool_use","name":"%s"}]}}', k, v, k * 2, tool))
            .when(kind == "click", F.format_string('{"type":"assistant","message":{"role":"assistant","usage":{"input_tokens":%d,"output_tokens":%d},"content":"get_context"}}', k, v))
            .when(kind == "signup", F.format_string('{"usage":{"input_tokens":%d,"output_tokens":%d},"content":[]}', k, v))
            .when(kind == "view", F.lit('{"type":"user","message":{"role":"user","content":"hi"}}')).otherwise("{broken"))
    return e.select(F.col("user_id").alias("session_id"), line.alias("line"))


@query("transcript_totals", f"WITH {TRANSCRIPT} SELECT * FROM tt")
def transcript_totals(spark, root):
    return L.transcript_totals(transcript(spark, root))


@query("telemetry_cohorts", f"""WITH {TRANSCRIPT}, a AS (SELECT context_used, count(*) AS n, sum(turns) AS t, sum(input_tokens) AS i, sum(output_tokens) AS o FROM tt GROUP BY context_used)
SELECT v.c AS context_used, coalesce(n, 0) AS sessions, CAST(coalesce(floor(i / t + 0.5), 0) AS BIGINT) AS avg_input_per_turn, CAST(coalesce(floor(o / n + 0.5), 0) AS BIGINT) AS avg_output_per_session, coalesce(floor(t / n * 10 + 0.5) / 10, 0) AS avg_turns
FROM (VALUES (true), (false)) v(c) LEFT JOIN a ON a.context_used = v.c""")
def telemetry_cohorts(spark, root):
    return L.cohorts(L.transcript_totals(transcript(spark, root)))


@query("metric_compare", """WITH e AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS c, ts < TIMESTAMP '2024-01-16' AS early FROM events),
m AS (SELECT event_type, sum(c) FILTER (early) / count(*) FILTER (early) AS b, sum(c) FILTER (NOT early) / count(*) FILTER (NOT early) AS m FROM e GROUP BY event_type)
SELECT event_type, floor((m - b) / CASE WHEN abs(b) = 0 THEN 1 ELSE abs(b) END * 100 * 100 + 0.5) / 100 AS delta_percent,
  CASE WHEN event_type IN ('click', 'view') THEN m <= b * 0.99 AND m < b WHEN event_type IN ('error', 'purchase') THEN m >= b * 1.01 AND m > b ELSE abs(m - 5000) <= abs(b - 5000) * 0.99 AND abs(m - 5000) < abs(b - 5000) END AS improved FROM m""")
def metric_compare(spark, root):
    e = T.table(spark, root, "events").select("event_type", F.round(F.col("value") * 100).cast("bigint").alias("c"), (F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("early"))
    early = F.col("early")
    m = e.groupBy("event_type").agg((F.sum(F.when(early, F.col("c"))) / F.count_if(early)).alias("baseline"), (F.sum(F.when(~early, F.col("c"))) / F.count_if(~early)).alias("measured"))
    goal = F.when(F.col("event_type").isin("click", "view"), "minimize").when(F.col("event_type").isin("error", "purchase"), "maximize").otherwise("target")
    return L.compare_metric(m, goal, tolerance=1.0, target=5000.0).select("event_type", "delta_percent", "improved")


@query("metric_median", "SELECT event_type, median(value) AS median FROM events GROUP BY event_type")
def metric_median(spark, root):
    return exact_median(T.table(spark, root, "events"), ["event_type"], "value").drop("n")


@query("rounded_median", """SELECT CAST(floor(median(n) + 0.5) AS BIGINT) AS median, CAST(max(n) AS BIGINT) AS maximum FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)""")
def rounded_median(spark, root):
    return L.rounded_median(T.table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")), "n")


@query("metric_extract", """SELECT event_id, CASE event_type WHEN 'click' THEN k WHEN 'view' THEN value WHEN 'error' THEN -k ELSE k + 0.5 END AS metric FROM (SELECT *, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)""")
def metric_extract(spark, root):
    e = T.session_log(spark, root)
    k, kind = F.col("k"), F.col("event_type")
    out = (F.when(kind == "click", F.format_string("run 7\nLatency: %d ms of 900", k)).when(kind == "view", F.concat(F.lit("p95 = "), F.col("value").cast("string"), F.lit(" (12 runs)")))
           .when(kind == "error", F.format_string("1 then 2 then -%d done", k)).otherwise(F.format_string("result=<%d.5> extra 4", k)))
    own = L.numeric_metric(out, r"result=<([^>]*)>")
    return e.select("event_id", own.alias("metric"))


EXP = """x AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'REVERT' WHEN 'O' THEN 'KEEP' ELSE 'ERROR' END AS verdict, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate END AS closed_at, o_custkey, o_orderpriority FROM orders),
now AS (SELECT max(o_orderdate) AS t FROM orders)"""


def experiments(spark, root):
    o = T.table(spark, root, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "F", "REVERT").when(F.col("o_orderstatus") == "O", "KEEP").otherwise("ERROR").alias("verdict"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderdate")).alias("closed_at"), F.concat(F.lit("src/c"), F.col("o_custkey").cast("string"), F.lit(".ts")).alias("target_file"),
        F.concat(F.lit("try "), F.lower("o_orderpriority")).alias("hypothesis"), F.lit("speed up").alias("goal"), F.lit(None).cast("string").alias("target_symbol"), F.col("o_orderkey").alias("ord"))


def _now(spark, root):
    return T.commits(spark, root).agg(F.max("ts")).scalar()


@query("ttl_prune", f"WITH {EXP} SELECT CAST(id AS VARCHAR) AS id, verdict FROM x, now WHERE NOT (verdict = 'REVERT' AND coalesce(epoch_us(closed_at) < epoch_us(t) - 30 * 86400000000, false))")
def ttl_prune(spark, root):
    return L.prune_expired(experiments(spark, root), _now(spark, root)).select("id", "verdict")


@query("experiment_summary", f"WITH {EXP} SELECT count(*) AS total, count(*) FILTER (verdict = 'KEEP') AS kept, count(*) FILTER (verdict = 'REVERT') AS reverted, CAST(floor(100 * count(*) FILTER (verdict = 'KEEP') / count(*) + 0.5) AS BIGINT) AS kept_percent FROM x")
def experiment_summary(spark, root):
    return L.history_summary(experiments(spark, root))


@query("negative_constraints", f"""WITH {EXP} SELECT CAST(id AS VARCHAR) AS id, 'src/c' || o_custkey || '.ts' AS target_file FROM x, now WHERE verdict = 'REVERT' AND (closed_at IS NULL OR epoch_us(closed_at) >= epoch_us(t) - 400 * 86400000000)
  AND (o_custkey = 12 OR contains('src/c' || o_custkey || '.ts', 'c77') OR o_orderpriority = '3-MEDIUM') ORDER BY x.id LIMIT 5""")
def negative_constraints(spark, root):
    return L.negative_constraints(experiments(spark, root), _now(spark, root), ["c77", "medium"], ["src/c12.ts"], ttl_days=400).select("id", "target_file")


@query("step_verdicts", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'out_of_bounds' WHEN o_orderpriority = '5-LOW' THEN 'gate_failed' WHEN o_totalprice < 50000 THEN 'test_failed' WHEN o_totalprice < 200000 THEN 'metric_regressed' END AS revert_reason,
  CASE WHEN o_orderstatus = 'P' OR o_orderpriority = '5-LOW' OR o_totalprice < 200000 THEN 'REVERT' ELSE 'KEEP' END AS verdict FROM orders""")
def step_verdicts(spark, root):
    v = L.step_verdict(F.col("o_orderstatus") != "P", F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") >= 50000, F.col("o_totalprice") >= 200000)
    return T.table(spark, root, "orders").select("o_orderkey", v.alias("v")).select("o_orderkey", "v.verdict", "v.revert_reason")


@query("replay_summary", """WITH s AS (SELECT o_orderkey, o_orderstatus <> 'P' AS touched, count(l_orderkey) FILTER (l_returnflag = 'A') AS added, count(l_orderkey) FILTER (l_returnflag = 'R') AS removed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
t AS (SELECT *, added + removed AS churn FROM s WHERE touched)
SELECT count(*) AS touched, count(*) FILTER (churn > 0) AS detected, floor(count(*) FILTER (churn > 0) / count(*) * 1000 + 0.5) / 1000 AS detection_rate, CAST(floor(median(churn) FILTER (churn > 0) + 0.5) AS BIGINT) AS median_churn, CAST(max(churn) AS BIGINT) AS max_churn FROM t""")
def replay_summary(spark, root):
    li = T.table(spark, root, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    c = T.table(spark, root, "orders").join(li, "o_orderkey", "left")
    return L.replay_summary(c.select((F.col("o_orderstatus") != "P").alias("source_touched"), F.coalesce("a", F.lit(0)).alias("added"), F.coalesce("r", F.lit(0)).alias("removed")))


@query("experiment_attach", f"""WITH {EXP} SELECT 'experiment:' || id AS src, CASE WHEN o_custkey IN (SELECT p_partkey FROM part WHERE p_size > 25) THEN 'module:c' || o_custkey ELSE 'module:src/c' || o_custkey END AS dst, verdict = 'KEEP' AS improved FROM x WHERE id NOT IN (SELECT p_partkey FROM part WHERE p_size = 1)""")
def experiment_attach(spark, root):
    p = T.table(spark, root, "part")
    k = F.col("p_partkey").cast("string")
    nodes = p.filter("p_size > 25").select(F.concat(F.lit("module:c"), k).alias("id"), F.lit("module").alias("kind"), k.alias("label"), F.concat(F.lit("src/c"), k, F.lit(".ts")).alias("path"), F.col("p_partkey").alias("ord")).unionByName(
        p.filter("p_size = 1").select(F.concat(F.lit("experiment:"), k).alias("id"), F.lit("experiment").alias("kind"), k.alias("label"), F.lit(None).cast("string").alias("path"), F.col("p_partkey").alias("ord")))
    edges = nodes.limit(0)
    return G.attach_experiments(nodes, edges, experiments(spark, root))[1].select("src", "dst", "improved")


# -- flights and records -------------------------------------------------------

FLIGHT = """f AS (SELECT o_custkey AS flight, p_brand || '/' || p_partkey AS path, bool_or(o_orderstatus = 'O') AS c, bool_or(o_orderstatus = 'F') AS d, bool_or(o_orderstatus = 'P') AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
a AS (SELECT flight, path, CASE WHEN c THEN CASE WHEN d OR p THEN 'in_bounds' ELSE 'out_of_bounds' END ELSE 'untouched' END AS state FROM f WHERE c OR d)"""


def _audit(spark, root):
    o = T.table(spark, root, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("flight"), "o_orderstatus")
    t = T.touch_keys(spark, root).join(o, "sha").join(T.part_files(spark, root), "partkey").select("flight", F.col("file").alias("path"), "o_orderstatus")
    by = {s: t.filter(F.col("o_orderstatus") == s) for s in "OFP"}
    return L.audit_flight(by["O"], by["F"], by["P"], ["flight"], tasks_for(T.touch_keys(spark, root)))


@query("flight_scope_audit", f"WITH {FLIGHT} SELECT flight, count(*) FILTER (state = 'in_bounds') AS in_bounds, count(*) FILTER (state = 'out_of_bounds') AS out_of_bounds, count(*) FILTER (state = 'untouched') AS untouched, CASE WHEN count(*) FILTER (state = 'out_of_bounds') = 0 THEN 'clean' ELSE 'flagged' END AS verdict FROM a GROUP BY flight")
def flight_scope_audit(spark, root):
    return L.flight_verdict(_audit(spark, root), ["flight"])


@query("flight_files", f"WITH {FLIGHT} SELECT state, count(*) AS files FROM a GROUP BY state")
def flight_files(spark, root):
    return _audit(spark, root).groupBy("state").agg(F.count("*").alias("files"))


@query("latest_open_flight", "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_open_flight(spark, root):
    f = T.table(spark, root, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"), F.col("o_orderdate").alias("created_at"))
    return L.latest_open(f).select("id", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("actual_changes", """SELECT DISTINCT path FROM (SELECT 'src/c' || c_custkey || '.ts' AS path FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING' UNION ALL SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'src/c' || o_custkey || '.ts' END FROM orders) WHERE path IS NOT NULL""")
def actual_changes(spark, root):
    c = T.table(spark, root, "customer").select(F.concat(F.lit("src/c"), F.col("c_custkey").cast("string"), F.lit(".ts")).alias("path"), "c_acctbal", "c_mktsegment").filter("c_acctbal > 5000")
    o = T.table(spark, root, "orders").select(F.concat(F.lit("src/c"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderpriority") == "1-URGENT", ".ts").otherwise(".md")).alias("path"))
    return L.actual_changes(c, c.filter("c_mktsegment = 'BUILDING'"), o)


@query("record_division", """WITH cur AS (SELECT DISTINCT l_orderkey AS change, l_partkey AS path FROM lineitem), need AS (SELECT change, count(*) AS need FROM cur GROUP BY change),
rec AS (SELECT o_orderkey AS record_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'human' ELSE 'agent' END AS provenance, -o_orderkey AS ord FROM orders WHERE o_orderstatus <> 'P'), rf AS (SELECT DISTINCT l_orderkey AS record_id, l_partkey AS path FROM lineitem),
g AS (SELECT change, record_id, count(*) AS got FROM cur JOIN rf USING (path) JOIN rec USING (record_id) GROUP BY ALL), full_ AS (SELECT g.change, g.record_id, provenance, ord FROM g JOIN need USING (change) JOIN rec USING (record_id) WHERE got = need)
SELECT change, arg_min(record_id, ord) AS record_id, count(*) AS records, arg_min(provenance, ord) = 'agent' AND NOT bool_or(provenance = 'human') AS agent_only FROM full_ GROUP BY change""")
def record_division(spark, root):
    li = T.table(spark, root, "lineitem")
    h = F.sha1(F.col("l_partkey").cast("string")).alias("hash")
    cur = li.select(F.col("l_orderkey").alias("change"), F.col("l_partkey").alias("path"), h)
    rec = T.table(spark, root, "orders").select(F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderstatus") == "P", "fail").otherwise("pass").alias("verdict"),
                                                F.when(F.col("o_orderpriority") == "1-URGENT", "human").otherwise("agent").alias("provenance"), (-F.col("o_orderkey")).alias("ord"))
    return L.covering_records(cur, rec, li.select(F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("path"), h), ["change"])


# Changes are orders; every seventh record was made without version control, and a part's file changed the later the larger it is.
_COVER = """li AS (SELECT DISTINCT l_orderkey AS change, l_partkey AS path FROM lineitem), rec AS (SELECT o_orderkey AS record_id, o_orderstatus <> 'P' AS pass, CASE o_orderpriority WHEN '1-URGENT' THEN 'human' ELSE 'agent' END AS provenance, -epoch_us(o_orderdate) * 1000 - o_orderkey % 1000 AS ord, epoch_us(o_orderdate) AS made, o_orderkey % 7 <> 0 AS versioned FROM orders),
cur AS (SELECT change, path, CASE WHEN path % 50 <> 0 THEN path END AS hash, p_size::BIGINT * 5000000000000 + (SELECT min(made) FROM rec) AS mtime FROM li JOIN part ON p_partkey = path),
need AS (SELECT change, count(hash) AS need, max(mtime) AS changed FROM cur GROUP BY change),
h AS (SELECT cur.change, rec.record_id, any_value(rec.ord) AS ord, any_value(provenance) AS provenance, count(*) AS got FROM cur JOIN li ON li.path = cur.hash JOIN rec ON rec.record_id = li.change WHERE pass AND versioned GROUP BY ALL),
hs AS (SELECT h.change, min([ord, record_id])[1] AS ord, min([ord, record_id])[2] AS record_id, arg_min(provenance, [ord, record_id]) = 'agent' AND NOT bool_or(provenance = 'human') AS agent FROM h JOIN need USING (change) WHERE got = need GROUP BY ALL),
t AS (SELECT * FROM rec WHERE pass AND NOT versioned ORDER BY ord, made, record_id LIMIT 1), th AS (SELECT max(made) AS made FROM rec WHERE pass AND NOT versioned AND provenance = 'human'),
v AS (SELECT need.change, need, t.ord AS t_ord, hs.ord AS h_ord, t.record_id AS t_rec, hs.record_id AS h_rec, t.provenance = 'agent' AND NOT coalesce(need.changed <= (SELECT made FROM th), false) AS t_agent, hs.agent AS h_agent FROM need LEFT JOIN t ON need.changed <= t.made LEFT JOIN hs ON hs.change = need.change),
w AS (SELECT *, t_rec IS NOT NULL AND coalesce(t_ord < h_ord, true) AS timed FROM v),
verdicts AS (SELECT change, need = 0 OR t_rec IS NOT NULL OR h_rec IS NOT NULL AS covered, CASE WHEN need > 0 THEN CASE WHEN timed THEN t_rec ELSE h_rec END END AS record_id,
  CASE WHEN need > 0 AND (t_rec IS NOT NULL OR h_rec IS NOT NULL) THEN CASE WHEN timed THEN t_agent ELSE h_agent END END AS agent_only FROM w)"""


def _coverage(spark, root):
    li, o = T.table(spark, root, "lineitem"), T.table(spark, root, "orders")
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    records = o.select(F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderstatus") == "P", "fail").otherwise("pass").alias("verdict"), F.when(F.col("o_orderpriority") == "1-URGENT", "human").otherwise("agent").alias("provenance"),
                       (-at * 1000 - F.col("o_orderkey") % 1000).alias("ord"), at.alias("created_at"), (F.col("o_orderkey") % 7 != 0).alias("versioned"))
    size = T.table(spark, root, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size").cast("bigint") * 5_000_000_000_000 + o.agg(F.min(at)).scalar()).alias("mtime"))
    current = li.select("l_orderkey", "l_partkey").distinct().join(size, "l_partkey").select(F.col("l_orderkey").alias("change"), F.col("l_partkey").alias("path"), F.when(F.col("l_partkey") % 50 != 0, F.col("l_partkey")).alias("hash"), "mtime")
    return L.coverage_for(current, records, li.select(F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("path"), F.col("l_partkey").alias("hash")), ["change"])


@query("coverage_for", f"WITH {_COVER} SELECT change, covered, record_id, agent_only FROM verdicts")
def coverage_for(spark, root):
    return _coverage(spark, root)[0]


@query("uncovered_files", f"""WITH {_COVER}, has AS (SELECT path FROM li WHERE change = (SELECT record_id FROM rec WHERE pass ORDER BY ord, record_id LIMIT 1))
SELECT DISTINCT change, path FROM cur JOIN verdicts USING (change) WHERE NOT covered AND hash IS NOT NULL AND path NOT IN (SELECT path FROM has)""")
def uncovered_files(spark, root):
    return _coverage(spark, root)[1]


@query("ring_buffer_latest", "SELECT user_id, event_id, position FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS position FROM events) WHERE position <= 20")
def ring_buffer_latest(spark, root):
    return L.newest_records(T.table(spark, root, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "position")


# -- memory and phases -----------------------------------------------------------

@query("memory_bullets", """SELECT p_partkey, '**' || p_name || ':** use ' || p_brand || ' (' || p_type || ')' || CASE WHEN p_size > 25 THEN ' (evidence: a.ts, b.ts)' ELSE '' END || CASE WHEN p_size <= 10 THEN ' [provenance: me]' ELSE '' END AS item FROM part WHERE contains(lower('**' || p_name || ':** use ' || p_brand || ' (' || p_type || ')'), 'ring') OR contains(lower(p_brand), '#12')""")
def memory_bullets(spark, root):
    p = T.table(spark, root, "part")
    entry = L.pattern_entry(F.col("p_name"), F.concat(F.lit("use "), "p_brand"), F.col("p_type"), F.when(F.col("p_size") > 25, F.array(F.lit("a.ts"), F.lit("b.ts"))).otherwise(F.array().cast("array<string>")), F.when(F.col("p_size") <= 10, "me"))
    notes = p.select("p_partkey", F.concat(F.lit("# Notes\n\ntext ring\n"), entry, F.lit("\n* \n")).alias("content"))
    return L.query_memory(L.parse_bullets(notes).filter("item <> ''"), L.memory_terms(topic="ring #12 of"))


@query("graph_clarity", """WITH fan AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY ALL), ch AS (SELECT DISTINCT l_suppkey AS change, l_partkey AS k FROM lineitem),
f AS (SELECT change, p_brand || '/' || p_partkey AS path, n FROM ch JOIN part ON p_partkey = k LEFT JOIN fan USING (k))
SELECT change, 'downstream-consumers' AS rule, 'File ' || path || ' has ' || n || ' downstream consumers, exceeding max of 30' AS detail FROM f WHERE n > 30
UNION ALL SELECT change, 'boundary-crossing', 'Changes span ' || count(DISTINCT split_part(path, '/', 1)) || ' top-level directories' FROM f GROUP BY change HAVING count(DISTINCT split_part(path, '/', 1)) > 1
UNION ALL SELECT change, 'negative-constraint', 'File ' || path || ' matches negative constraint: do not touch ' || path || '!' FROM f JOIN part ON path = p_brand || '/' || p_partkey WHERE p_size > 40""")
def graph_clarity(spark, root):
    files = T.part_files(spark, root)
    ch = T.table(spark, root, "lineitem").select(F.col("l_suppkey").alias("change"), F.col("l_partkey").alias("partkey")).join(files, "partkey").select("change", F.col("file").alias("path"))
    nodes = files.select(T.node_id("part", "partkey").alias("id"), F.col("file").alias("path"))
    edges = T.table(spark, root, "lineitem").select(T.node_id("part", "l_partkey").alias("dst"))
    constraints = T.table(spark, root, "part").filter("p_size > 40").select(F.concat(F.lit("do not touch "), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit("!")).alias("item"))
    return CL.graph_clarity(ch, nodes, edges, constraints, ["change"], 30)


@query("phase_gates", """WITH p AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'discovery' WHEN 'F' THEN 'inception' ELSE CASE WHEN o_totalprice > 200000 THEN 'construction' ELSE 'operations' END END AS phase, count(l_orderkey) FILTER (l_returnflag = 'A') AS missing, count(l_orderkey) FILTER (l_returnflag = 'R') AS blocking FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
b AS (SELECT *, missing > 0 OR (blocking > 0 AND phase IN ('discovery', 'inception')) AS blocked FROM p)
SELECT phase, CASE WHEN blocked THEN 'blocked' ELSE 'pass' END AS status, CAST(CASE WHEN NOT blocked THEN 100 WHEN phase = 'operations' THEN 50 ELSE greatest(0, 100 - CASE phase WHEN 'discovery' THEN 35 * missing + 20 * blocking WHEN 'inception' THEN 40 * missing + 25 * blocking ELSE 30 * missing END) END AS BIGINT) AS score, count(*) AS n FROM b GROUP BY ALL""")
def phase_gates(spark, root):
    li = T.table(spark, root, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "A").alias("m"), F.count_if(F.col("l_returnflag") == "R").alias("b"))
    phase = F.when(F.col("o_orderstatus") == "O", "discovery").when(F.col("o_orderstatus") == "F", "inception").when(F.col("o_totalprice") > 200000, "construction").otherwise("operations")
    p = T.table(spark, root, "orders").join(li, "o_orderkey", "left").select(phase.alias("phase"), F.coalesce("m", F.lit(0)).alias("missing"), F.coalesce("b", F.lit(0)).alias("blocking"))
    return CL.phase_gate(p).groupBy("phase", "status", "score").agg(F.count("*").alias("n"))


@query("context_confidence", """WITH x AS (SELECT doc_id, n_chars, length(text) AS n, lang, (doc_id % 3) AS r FROM documents), y AS (SELECT *, CASE lang WHEN 'en' THEN 'healthy' WHEN 'fr' THEN 'empty' WHEN 'de' THEN 'degraded' ELSE 'unverifiable' END AS trust FROM x)
SELECT doc_id, trust, floor(least(1, CASE WHEN n > 200 THEN 0.25 ELSE 0 END + CASE WHEN n > 300 THEN 0.30 ELSE 0 END + CASE WHEN n > 400 THEN 0.15 ELSE 0 END + CASE WHEN n > 500 THEN 0.15 ELSE 0 END + CASE trust WHEN 'healthy' THEN 0.15 WHEN 'empty' THEN 0.05 ELSE 0 END) * 100 + 0.5) / 100 AS confidence FROM y""")
def context_confidence(spark, root):
    n = F.length("text")
    lang = F.col("lang")
    trust = CL.knowledge_trust(F.when(lang == "fr", 0).otherwise(1), F.when(lang == "de", 1).otherwise(0), F.when(lang.isin("fr", "de", "en"), 1).otherwise(0), F.lit(0))
    return T.table(spark, root, "documents").select("doc_id", trust.alias("trust"), CL.confidence(n > 200, n > 300, n > 400, n > 500, trust).alias("confidence"))


@query("ticket_files", """SELECT DISTINCT path FROM (SELECT 'part/' || o_custkey AS path FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'x' FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'part/' || o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'new' FROM orders WHERE o_orderstatus = 'F')""")
def ticket_files(spark, root):
    from trailgraph.plans.code_queries import tickets
    from trailgraph.sources import logs

    return CL.files_of_ids(logs.ticket_targets(tickets(spark, root)))


@query("email_slugs", """SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name || '.x@Mail-' || c_mktsegment || '.io!'), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug FROM customer""")
def email_slugs(spark, root):
    return T.table(spark, root, "customer").select("c_custkey", S.email_slug(F.concat("c_name", F.lit(".x@Mail-"), "c_mktsegment", F.lit(".io!"))).alias("slug"))


@query("markdown_squeeze", """SELECT doc_id, regexp_replace(regexp_replace('---' || chr(10) || 'name: a' || chr(10) || '---' || chr(10) || replace(text, chr(13) || chr(10), chr(10)) || chr(10) || 'ensure x.' || repeat(chr(10), 4) || 'Must y.', '(?m)[ \\t]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') || chr(10) AS text FROM documents""")
def markdown_squeeze(spark, root):
    d = T.table(spark, root, "documents")
    return d.select("doc_id", S.squeeze_markdown(F.concat(F.lit("---\nname: a\nversion: 2\n---\n<!-- c\n -->"), "text", F.lit("\nPlease note that make sure to x.\n\n\n\nIt is important to y.  \n"))).alias("text"))
