"""Change-history queries over orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailgraph.operators import history as H
from trailgraph.plans.registry import query
from trailgraph.runtime import cut_lineage
from trailgraph.sources import tables as T

STAMP = "yyyy-MM-dd HH:mm:ss"
TOUCHES = """touches AS (
  SELECT l.l_orderkey AS sha, o.o_custkey AS author, o.o_orderdate AS ts, p.p_brand AS module,
         p.p_brand || '/' || p.p_partkey AS file
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey)"""


def newest(spark, root):
    return T.commits(spark, root).agg(F.max("ts")).scalar()


@query("hotspots_topn", f"""WITH {TOUCHES}, c AS (SELECT file, count(*) AS change_freq FROM touches GROUP BY file),
r AS (SELECT *, row_number() OVER (ORDER BY change_freq DESC, file) - 1 AS i FROM c)
SELECT file, change_freq, CAST(floor(100 * (1 - i / 20.0) + 0.5) AS BIGINT) AS score FROM r WHERE i < 20""")
def hotspots_topn(spark, root):
    return H.hotspots(T.touch_keys(spark, root), key="partkey", names=T.part_files(spark, root))


@query("ownership", f"""WITH {TOUCHES},
ma AS (SELECT module, author, count(*) AS n, max(ts) AS last FROM touches GROUP BY ALL),
m AS (SELECT module, CAST(sum(n) AS BIGINT) AS total, max(last) AS last_active FROM ma GROUP BY module),
o AS (SELECT module, author, row_number() OVER (PARTITION BY module ORDER BY n DESC, last DESC, author) AS r FROM ma)
SELECT m.module, CAST(o.author AS BIGINT) AS primary_owner, m.total,
  (SELECT count(*) FROM ma WHERE ma.module = m.module AND ma.n / m.total > 0.01) AS bus_factor,
  epoch_us((SELECT max(o_orderdate) FROM orders)) - epoch_us(m.last_active) > 90 * 86400000000 AS is_orphaned,
  strftime(m.last_active, '%Y-%m-%d %H:%M:%S') AS last_active
FROM m JOIN o ON m.module = o.module AND o.r = 1""")
def ownership(spark, root):
    out = H.ownership(T.touches(spark, root), newest(spark, root), share=0.01)
    return out.withColumn("last_active", F.date_format("last_active", STAMP))


def _coupling_sql(grain: str, min_co: int, strength: float) -> str:
    limit = "ORDER BY strength DESC, file_a, file_b LIMIT 30"
    return f"""WITH {TOUCHES}, t AS (SELECT DISTINCT sha, {grain} AS file FROM touches),
tot AS (SELECT file, count(*) AS total FROM t GROUP BY file),
p AS (SELECT a.file AS file_a, b.file AS file_b, count(*) AS co FROM t a JOIN t b ON a.sha = b.sha AND a.file < b.file GROUP BY ALL)
SELECT file_a, file_b, co AS co_changes, floor(co / greatest(x.total, y.total) * 100 + 0.5) / 100 AS strength,
  split_part(file_a, '/', 1) <> split_part(file_b, '/', 1) AS cross_module
FROM p JOIN tot x ON x.file = file_a JOIN tot y ON y.file = file_b
WHERE co >= {min_co} AND co / greatest(x.total, y.total) >= {strength} {limit}"""


@query("change_coupling", _coupling_sql("module", 3, 0.12))
def change_coupling(spark, root):
    keys = T.touch_keys(spark, root).join(T.part_files(spark, root), "partkey")
    return H.coupling(keys.select("sha", F.col("module").alias("file")), min_strength=0.12)


@query("file_coupling", _coupling_sql("file", 2, 0.05))
def file_coupling(spark, root):
    # Files are numbers until the pairs are found; a part key that repeats with another brand is another file.
    files = T.part_files(spark, root).select("partkey", F.col("file").alias("name")).distinct()
    names = cut_lineage(files.withColumn("file", F.monotonically_increasing_id()))
    keys = T.touch_keys(spark, root).join(names, "partkey")
    return H.coupling(keys.select("sha", "file"), min_co=2, min_strength=0.05, names=names)


@query("velocity_trend", f"""WITH {TOUCHES}, n AS (SELECT max(o_orderdate) AS t FROM orders),
w AS (SELECT module, ts, (epoch_us(n.t) - epoch_us(ts)) // 604800000000 AS week FROM touches, n),
g AS (SELECT module, count(*) FILTER (week < 4) / 4 AS r, count(*) FILTER (week >= 4) / 9 AS o, max(ts) AS last FROM w WHERE week BETWEEN 0 AND 12 GROUP BY module)
SELECT module, floor(r * 10 + 0.5) / 10 AS touches_per_week,
  CASE WHEN r = 0 THEN 'stale' WHEN r > o * 1.3 THEN 'accelerating' WHEN r < o * 0.7 THEN 'declining' ELSE 'stable' END AS trend,
  strftime(last, '%Y-%m-%d %H:%M:%S') AS last_commit FROM g""")
def velocity_trend(spark, root):
    return H.velocity(T.touches(spark, root), newest(spark, root)).withColumn("last_commit", F.date_format("last_commit", STAMP))


@query("churn_window", f"""WITH {TOUCHES}, n AS (SELECT max(o_orderdate) AS t FROM orders)
SELECT file, count(*) AS churn FROM touches, n WHERE epoch_us(n.t) - epoch_us(ts) BETWEEN 0 AND 90 * 86400000000 GROUP BY file""")
def churn_window(spark, root):
    return H.churn_window(T.touches(spark, root), newest(spark, root))


@query("churn_last_n", f"""WITH {TOUCHES}, c AS (SELECT o_orderkey AS sha FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200)
SELECT file, count(*) AS churn FROM touches SEMI JOIN c USING (sha) GROUP BY file""")
def churn_last_n(spark, root):
    keys = T.touch_keys(spark, root)
    return H.churn_last_n(T.commits(spark, root), keys.join(T.part_files(spark, root), "partkey"))


@query("author_signals", """WITH t AS (
  SELECT o_custkey AS author, l_orderkey AS sha, lower(regexp_extract(o_orderpriority, '-(\\w+)', 1)) || ': ' || o_orderstatus AS subject,
    p_brand || '/' || p_partkey || '.' || ['ts', 'py', 'go', 'zig'][1 + p_partkey % 4] AS file, l_quantity, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
c AS (SELECT author, sha, bool_or(regexp_matches(file, '[05]\\.ts$')) AS is_test, bool_or(regexp_matches(subject, '^(urgent|high|low)(\\(.+\\))?(!)?:')) AS conv FROM t GROUP BY ALL),
b AS (SELECT author, count(*) AS total_commits, count(*) FILTER (is_test) / count(*) AS test_commit_ratio, count(*) FILTER (conv) / count(*) > 0.6 AS conventional FROM c GROUP BY author),
d AS (SELECT author, split_part(file, '/', 1) AS dir, count(*) AS n FROM t GROUP BY ALL),
d3 AS (SELECT author, string_agg(dir, ',' ORDER BY r) AS primary_dirs FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY n DESC, dir) AS r FROM d) WHERE r <= 3 GROUP BY author),
e AS (SELECT author, regexp_extract(file, '\\.(\\w+)$', 1) AS ext, count(*) AS n FROM t GROUP BY ALL),
l AS (SELECT author, ext FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY n DESC, ext) AS r FROM e) WHERE r = 1),
s AS (SELECT author, CAST(floor(sum(CAST(l_quantity AS BIGINT) * 4 + l_linenumber) / count(*) + 0.5) AS BIGINT) AS avg_lines FROM t GROUP BY author)
SELECT b.*, primary_dirs, CASE ext WHEN 'ts' THEN 'TypeScript' WHEN 'py' THEN 'Python' WHEN 'go' THEN 'Go' ELSE upper(ext) END AS primary_language, avg_lines,
  CASE WHEN test_commit_ratio > 0.6 THEN 'always' WHEN test_commit_ratio > 0.2 THEN 'on-request' ELSE 'inferred-rarely' END AS tests,
  CASE WHEN avg_lines > 300 THEN 'production-hardened' WHEN avg_lines > 80 THEN 'standard' ELSE 'spike' END AS depth
FROM b JOIN d3 USING (author) JOIN l USING (author) JOIN s USING (author)""")
def author_signals(spark, root):
    part = T.table(spark, root, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit("."),
                 F.element_at(F.array(*map(F.lit, ["ts", "py", "go", "zig"])), (1 + F.col("p_partkey") % 4).cast("int"))).alias("file"))
    li = T.table(spark, root, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber")
    t = li.join(T.commits(spark, root), F.col("l_orderkey") == F.col("sha")).join(part, "l_partkey")
    stats = t.select("author", (F.col("l_quantity").cast("bigint") * 4).alias("adds"), F.col("l_linenumber").cast("bigint").alias("dels"))
    return H.author_signals(t, stats, test_pattern=r"[05]\.ts$", conventional=r"^(urgent|high|low)(\(.+\))?(!)?:")
