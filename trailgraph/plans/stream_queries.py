"""Streaming queries over the events and orders tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailgraph.plans.registry import query
from trailgraph.streaming import streams as ST

STAMP = "yyyy-MM-dd HH:mm:ss"


@query("stream_session_state", """SELECT DISTINCT user_id AS session_id, CASE WHEN event_type = 'click' THEN 'changed' ELSE 'validated' END AS kind, CASE WHEN event_type = 'click' THEN 'src/f' || k || '.ts' ELSE 'npm test -- ' || k END AS value
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type = 'view' OR (event_type = 'click' AND k < 80)""")
def stream_session_state(spark, root):
    e = ST.stream_table(spark, root, "events")
    k = F.get_json_object("props", "$.k")
    tool = F.when(F.col("event_type") == "click", "Edit").when(F.col("event_type") == "view", "Bash").otherwise("Read")
    path = F.concat(F.lit("./src/f"), k, F.when(k.cast("int") < 80, ".ts").otherwise(".md"))
    hooks = e.select(F.col("user_id").alias("session_id"), "ts", tool.alias("tool_name"), path.alias("file_path"), F.concat(F.lit("npm test -- "), k).alias("command"))
    return ST.drain(ST.session_changes(hooks)).select("session_id", "kind", "value")


@query("stream_session_totals", """WITH e AS (SELECT user_id, epoch_us(ts) AS t, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS d FROM e),
s AS (SELECT *, sum(CASE WHEN d IS NULL OR d >= 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM g), a AS (SELECT user_id, n, max(t) + 7200000000 AS stop, count(*) AS turns, CAST(sum(k) AS BIGINT) AS k FROM s GROUP BY ALL)
SELECT user_id, turns, k FROM a WHERE stop <= (SELECT max(t) // 1000 * 1000 FROM e) - 3600000000""")
def stream_session_totals(spark, root):
    e = ST.stream_table(spark, root, "events").select("user_id", "ts", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return ST.drain(ST.session_totals(e, "user_id", "2 hours", "1 hour", ["k"])).select("user_id", "turns", "k")


@query("stream_weekly_touches", """WITH o AS (SELECT o_orderpriority AS module, epoch_us(o_orderdate) // 604800000000 AS w FROM orders) SELECT module, strftime(make_timestamp(w * 604800000000), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS touches FROM o
WHERE (w + 1) * 604800000000 <= (SELECT epoch_us(max(o_orderdate)) FROM orders) - 86400000000 GROUP BY ALL""")
def stream_weekly_touches(spark, root):
    o = ST.stream_table(spark, root, "orders").select(F.col("o_orderpriority").alias("module"), F.col("o_orderdate").alias("ts"))
    return ST.drain(ST.weekly_touches(o, "module")).select("module", F.date_format("start", STAMP).alias("start"), "touches")


@query("stream_merge", """SELECT o_custkey AS id, o_orderkey AS version, o_orderstatus AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1 AND o_orderstatus <> 'P'""")
def stream_merge(spark, root):
    o = ST.stream_table(spark, root, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("version"), (F.col("o_orderstatus") == "P").alias("deleted"), F.col("o_orderstatus").alias("status"))
    return ST.latest_rows(ST.drain(o), ["id"], ["ts", "version"]).select("id", "version", "status")
