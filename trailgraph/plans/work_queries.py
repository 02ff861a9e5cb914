"""Gates, retrieval, budgets, ledgers and clarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailgraph.functions import scalar as S
from trailgraph.operators import budget as BU
from trailgraph.operators import clarity as CL
from trailgraph.operators import gates as GA
from trailgraph.operators import retrieval as R
from trailgraph.plans.registry import query
from trailgraph.plans.trust_queries import LINES
from trailgraph.sources import tables as T

# -- gates -------------------------------------------------------------------


def declared_env(spark, root):
    """Example-file lines: part types that start early plus every region."""
    p = T.table(spark, root, "part").filter("p_type < 'M'").select(F.concat(F.upper("p_type"), F.lit("=1")).alias("line"))
    r = T.table(spark, root, "region").select(F.concat(F.lit("export "), F.regexp_replace(F.upper("r_name"), "[^A-Z]", "_"), F.lit(" = x # y")).alias("line"))
    return p.unionByName(r).unionByName(r.select(F.concat(F.lit("# "), "line").alias("line")))


ENV = """used AS (SELECT upper(replace(p_type, ' ', '_')) AS name, min('src/' || replace(p_brand, '#', '') || '/p' || p_partkey || '.ts') AS file FROM part GROUP BY ALL),
decl AS (SELECT DISTINCT upper(p_type) AS name FROM part WHERE p_type < 'M' UNION SELECT regexp_replace(upper(r_name), '[^A-Z]', '_', 'g') FROM region),
env AS (SELECT 'env-vars' AS gate, CASE WHEN decl.name IS NULL THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN decl.name IS NULL THEN 'Environment variable ' || used.name || ' is used in code but not declared in .env.example.' ELSE 'Environment variable ' || decl.name || ' is declared in .env.example but never referenced in source.' END AS message,
  file, CAST(CASE WHEN file IS NOT NULL THEN 10 END AS BIGINT) AS line FROM used FULL JOIN decl ON used.name = decl.name WHERE used.name IS NULL OR decl.name IS NULL)"""


def _env(spark, root):
    lines = T.lines(T.source_tree(spark, root))
    return GA.env_gate(GA.env_references(lines), GA.env_declared(declared_env(spark, root)))


@query("gate_env_full_outer", f"WITH {ENV} SELECT gate, severity, message, file, line FROM env")
def gate_env_full_outer(spark, root):
    return _env(spark, root)


API = """l AS (SELECT url, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS href FROM pages),
b AS (SELECT 'GET ' || href AS endpoint, min(url) AS file FROM l WHERE url LIKE 'https:%' GROUP BY ALL), h AS (SELECT 'GET ' || href AS endpoint, min(url) AS file FROM l WHERE url NOT LIKE 'https:%' GROUP BY ALL),
api AS (SELECT 'api-diff' AS gate, CASE WHEN h.endpoint IS NULL THEN 'error' ELSE 'info' END AS severity,
  CASE WHEN h.endpoint IS NULL THEN 'Endpoint removed or changed: ' || b.endpoint || ' (was in ' || b.file || '). This is a breaking change — version the API or restore compatibility.' ELSE 'Endpoint added: ' || h.endpoint || ' (in ' || h.file || ').' END AS message,
  coalesce(b.file, h.file) AS file FROM b FULL JOIN h USING (endpoint) WHERE b.endpoint IS NULL OR h.endpoint IS NULL)"""


def _api(spark, root):
    links = T.table(spark, root, "pages").select(F.col("url").alias("file"), F.explode(F.regexp_extract_all("html", F.lit(r'href="(/[^"]*)"'), F.lit(1))).alias("href")).select(
        F.concat(F.lit("GET "), "href").alias("endpoint"), "file")
    secure = F.col("file").startswith("https:")
    return GA.api_gate(links.filter(secure), links.filter(~secure))


@query("gate_api_diff", f"WITH {API} SELECT gate, severity, message, file FROM api")
def gate_api_diff(spark, root):
    return _api(spark, root).drop("line")


LINT = """m AS (SELECT 'migrations/' || o_orderkey || '.sql' AS file, unnest(CASE o_orderstatus WHEN 'O' THEN [1] WHEN 'F' THEN [2, 3] ELSE [4] END) AS rule FROM orders),
lint AS (SELECT 'migration-lint' AS gate, file, CASE WHEN rule IN (1, 3) THEN 'error' ELSE 'warning' END AS severity, CASE rule WHEN 1 THEN 'DROP' WHEN 2 THEN 'CREATE' WHEN 3 THEN 'Mass' ELSE 'ADD' END AS what, CAST(CASE WHEN rule IN (1, 2) THEN 1 WHEN rule = 3 THEN 2 ELSE 1 END AS BIGINT) AS line FROM m)"""


def migrations(spark, root):
    """One migration file per order; its status picks the statements."""
    k = F.col("o_orderkey").cast("string")
    text = (F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("DROP TABLE t"), k, F.lit("; -- truncate later")))
            .when(F.col("o_orderstatus") == "F", F.concat(F.lit("CREATE INDEX i ON t"), k, F.lit("(a);\nDELETE FROM t"), k, F.lit(";\nCREATE INDEX CONCURRENTLY j ON t(b);")))
            .otherwise("ALTER TABLE t ADD COLUMN c INT NOT NULL; -- drop table x\nUPDATE t SET a = 1;\nUPDATE t SET a = 1 WHERE b = 2;"))
    return T.spread(T.table(spark, root, "orders").select("o_orderkey", "o_orderstatus")).select(F.concat(F.lit("migrations/"), k, F.lit(".sql")).alias("path"), text.alias("content"))


LINT = LINT.replace("ELSE [4] END", "ELSE [4, 5] END").replace("WHEN 3 THEN 'Mass' ELSE 'ADD' END", "WHEN 3 THEN 'Mass' WHEN 4 THEN 'ADD' ELSE 'UPDATE' END").replace("WHEN rule = 3 THEN 2 ELSE 1 END", "WHEN rule IN (3, 5) THEN 2 ELSE 1 END")


def _lint(spark, root):
    return GA.migration_gate(T.lines(migrations(spark, root)))


@query("gate_rule_lint", f"WITH {LINT} SELECT severity, what, file, line FROM lint")
def gate_rule_lint(spark, root):
    found = _lint(spark, root)
    what = F.regexp_extract(F.regexp_replace("message", "^Destructive: ", ""), r"^(\w+)", 1)
    return found.select("severity", what.alias("what"), "file", "line")


DEAD = """succ AS (SELECT src, dst, count(*) AS n FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL GROUP BY ALL),
p AS (SELECT p_partkey AS k, 'src/' || replace(p_brand, '#', '') AS dir FROM part),
e AS (SELECT 'load' || k AS name, dir || '/p' || k || '.ts' AS file, 9 AS line FROM p WHERE k NOT IN (SELECT src FROM succ) AND k NOT IN (SELECT dst FROM succ)
  UNION ALL SELECT 'Box' || k, dir || '/p' || k || '.ts', 16 FROM p WHERE k NOT IN (SELECT dst FROM succ)
  UNION ALL SELECT 'link', dir || '/links/p' || src || '_p' || dst || '.ts', 5 FROM succ JOIN p ON k = src),
dead AS (SELECT 'dead-exports' AS gate, 'warning' AS severity, 'Exported ''' || name || ''' in ' || file || ' is never imported anywhere. Remove it or wire it up.' AS message, file, CAST(line AS BIGINT) AS line FROM e)"""


def _dead(spark, root):
    return GA.dead_exports(*GA.exports_and_uses(T.source_tree(spark, root)))


@query("gate_dead_exports", f"WITH {DEAD} SELECT gate, severity, message, file, line FROM dead")
def gate_dead_exports(spark, root):
    return _dead(spark, root)


@query("gate_status", f"""WITH {ENV}, {API}, {LINT}, {DEAD}, f AS (SELECT gate, severity FROM env UNION ALL SELECT gate, severity FROM api UNION ALL SELECT gate, severity FROM lint UNION ALL SELECT gate, severity FROM dead)
SELECT g AS gate, CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 'fail' WHEN count(*) FILTER (severity = 'warning') > 0 THEN 'warn' ELSE 'pass' END AS status,
  count(*) FILTER (severity = 'info') AS infos, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') AS errors
FROM (VALUES ('env-vars'), ('dead-exports'), ('api-diff'), ('migration-lint'), ('secrets-none')) v(g) LEFT JOIN f ON f.gate = g GROUP BY g""")
def gate_status(spark, root):
    found = _env(spark, root).unionByName(_api(spark, root)).unionByName(_lint(spark, root)).unionByName(_dead(spark, root))
    return GA.gate_status(found, ["env-vars", "dead-exports", "api-diff", "migration-lint", "secrets-none"])


ROUTES = """r AS (SELECT 'POST /part/' || p_partkey AS endpoint, 'server/p' || p_partkey || '.js' AS file FROM part UNION ALL SELECT 'GET /open/' || p_partkey, 'server/p' || p_partkey || '.js' FROM part
  UNION ALL SELECT m || ' /s/' || s_suppkey || '/{id}', 'openapi-' || s_suppkey || '.yaml' FROM supplier, (VALUES ('GET'), ('DELETE')) v(m)
  UNION ALL SELECT 'PUT /n/' || n_nationkey, 'spec/openapi-' || n_nationkey || '.json' FROM nation)"""


def route_tree(spark, root):
    """Server code per part, OpenAPI YAML per supplier, JSON per nation."""
    k = F.col("p_partkey").cast("string")
    code = T.table(spark, root, "part").select(F.concat(F.lit("server/p"), k, F.lit(".js")).alias("path"), F.format_string(
        "import express from 'express';\nconst app = express();\n// app.get('/ghost', h);\n/* router.put('/x') */\napp.post('/part/%s', h);\napi.get('/client');\nclass A {\n  @Get('/open/%s')\n  m() {}\n}\n", k, k).alias("content"))
    client = T.table(spark, root, "part").select(F.concat(F.lit("client/p"), k, F.lit(".ts")).alias("path"), F.format_string("const server = make();\nserver.get('/never/%s');\n", k).alias("content"))
    s = F.col("s_suppkey").cast("string")
    yaml = T.table(spark, root, "supplier").select(F.concat(F.lit("openapi-"), s, F.lit(".yaml")).alias("path"), F.format_string(
        "openapi: 3.0.0\npaths:\n  /s/%s/{id}:\n    get:\n      summary: x\n    delete:\n      summary: y\n", s).alias("content"))
    n = F.col("n_nationkey").cast("string")
    js = T.table(spark, root, "nation").select(F.concat(F.lit("spec/openapi-"), n, F.lit(".json")).alias("path"), F.format_string(
        '{"paths": {"/n/%s": {"put": {"summary": "z"}, "parameters": []}}}', n).alias("content"))
    return code.unionByName(client).unionByName(yaml).unionByName(js)


@query("api_surface", f"WITH {ROUTES} SELECT endpoint, file FROM r")
def api_surface(spark, root):
    return GA.api_surface(route_tree(spark, root)).select("endpoint", "file")


@query("secrets_scan", f"""WITH {LINES}, r(re, sev, name) AS (VALUES ('-----BEGIN [A-Z ]*PRIVATE KEY-----', 'error', 'private key'), ('\\bAKIA[0-9A-Z]{{16}}\\b', 'error', 'cloud access key id'), ('\\bgh[pousr]_[A-Za-z0-9]{{36}}\\b', 'error', 'code host token'),
  ('(?i)\\b(api[_-]?key|secret|password|passwd|token)\\b\\s*[:=]\\s*[''"]?[A-Za-z0-9_\\-/+]{{8,}}', 'error', 'assigned credential'), ('\\bsk[-_](live|test|proj)?[-_]?[A-Za-z0-9]{{16,}}\\b', 'error', 'service secret key'),
  ('\\beyJ[A-Za-z0-9_-]{{8,}}\\.[A-Za-z0-9_-]{{8,}}\\.[A-Za-z0-9_-]{{4,}}', 'warning', 'signed web token'))
SELECT sev AS severity, name AS message, path AS file, line_no AS line FROM lines JOIN r ON regexp_matches(line, re)""")
def secrets_scan(spark, root):
    return GA.secrets_scan(T.lines(T.files(spark, root))).drop("gate")


# -- retrieval and budgets -----------------------------------------------------

_SCORE = "3 * CAST(contains(lower(path), 'src1') AS INT) + " + " + ".join(f"2 * CAST(contains(lower(line), '{t}') AS INT)" for t in ["tion", "the", "eau"])


@query("retrieval_topk", f"""WITH {LINES}, s AS (SELECT path, line_no - 1 AS i, greatest(1, line_no - 4) AS b, least(max(line_no) OVER (PARTITION BY path), line_no + 4) AS e, {_SCORE} AS score FROM lines),
p1 AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, b, i) = 1),
p2 AS (SELECT s.* FROM s JOIN p1 USING (path) WHERE s.score > 0 AND abs(s.b - p1.b) >= 8 QUALIFY row_number() OVER (PARTITION BY path ORDER BY s.score DESC, s.b, s.i) = 1)
SELECT path, b AS start_line, e AS end_line, CAST(score AS BIGINT) AS score FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) ORDER BY score DESC, path, b LIMIT 50""")
def retrieval_topk(spark, root):
    return R.search_lines(T.files(spark, root), ["src1", "tion", "the", "eau"], k=50)


@query("retrieval_chunks", f"""WITH f AS (SELECT source || '/' || doc_id AS path, string_split(text, chr(10)) AS ls FROM documents), c AS (SELECT path, unnest(range(1, len(ls) + 1, 8)) AS b, ls FROM f), x AS (SELECT path, b, least(b + 7, len(ls)) AS e, ls FROM c)
SELECT path, CAST(b AS BIGINT) AS start_line, CAST(e AS BIGINT) AS end_line, sha256(array_to_string(ls[b:e], chr(10))) AS content_hash FROM x""")
def retrieval_chunks(spark, root):
    f = T.files(spark, root)
    starts = F.sequence(F.lit(1), F.size(F.split("content", "\n")), F.lit(8))
    hits = f.select("path", F.explode(starts).alias("start_line")).select("path", "start_line", (F.col("start_line") + 7).alias("end_line"), F.lit(1).alias("score"))
    return R.drop_duplicate_chunks(R.materialise(hits, f)).select("path", "start_line", "end_line", "content_hash")


@query("scoped_files", """SELECT source || '/' || doc_id AS path FROM documents WHERE source IN ('src1', 'src12')""")
def scoped_files(spark, root):
    return R.in_scope(T.files(spark, root), ["src1/", "./src12"]).select("path")


@query("search_output_parse", """SELECT event_id, CASE WHEN event_type = 'click' THEN 'a/' || user_id || '.ts' WHEN event_type = 'view' THEN 'b.py' ELSE 'c d/' || event_id || '.go' END AS path,
  CASE WHEN event_type = 'click' THEN greatest(1, k) WHEN event_type = 'view' THEN 1 ELSE k END AS start_line, CASE WHEN event_type = 'click' THEN greatest(k, k + 5) WHEN event_type = 'view' THEN 1 WHEN event_type = 'error' THEN k ELSE k + 3 END AS end_line,
  CASE WHEN event_type = 'click' THEN value END AS score FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def search_output_parse(spark, root):
    e = T.session_log(spark, root)
    k, kind = F.col("k"), F.col("event_type")
    out = (F.when(kind == "click", F.format_string('[{"path": "a/%d.ts", "startLine": %d, "end_line": %d, "score": %s}, {"note": 1}]', "user_id", k, k + 5, F.col("value").cast("string")))
           .when(kind == "view", F.lit('{"results": [{"file": "b.py"}]}'))
           .when(kind == "error", F.format_string("Results:\n  1. c d/%d.go:%d  0.93", "event_id", k))
           .otherwise(F.format_string("2) c d/%d.go:%d-%d", "event_id", k, k + 3)))
    return R.parse_search_output(e.select("event_id", out.alias("output"))).drop("rank")


_QD = """q AS (SELECT DISTINCT item_id AS query, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) > 2)) AS token FROM benchmark),
d AS (SELECT DISTINCT doc_id AS path, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) > 2)) AS token FROM documents),
h AS (SELECT query, path, count(*) AS score FROM q JOIN d USING (token) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, path) AS rank FROM h QUALIFY rank <= 10),
n AS (SELECT query, count(*) AS n FROM q GROUP BY query), x AS (SELECT query, path FROM h JOIN n USING (query) WHERE score >= 0.8 * n)"""


def _tokens(spark, root):
    """Words of the benchmark as queries, words of the documents."""
    one = lambda name, key, to: T.table(spark, root, name).select(F.col(key).alias(to), F.explode(S.words("text")).alias("token"))
    return one("benchmark", "item_id", "query"), one("documents", "doc_id", "path")


@query("recall_at_k", f"""WITH {_QD}
SELECT count(*) AS expected, count(r.path) AS recalled, count(r.path) / count(*) AS recall FROM x LEFT JOIN r ON r.query = x.query AND r.path = x.path""")
def recall_at_k(spark, root):
    q, d = _tokens(spark, root)
    return R.recall_at_k(R.overlap_rank(q, d, 10), R.overlap_at_least(q, d, 0.8), 10)


@query("overlap_rank", f"WITH {_QD} SELECT query, path, score, rank FROM r")
def overlap_rank(spark, root):
    return R.overlap_rank(*_tokens(spark, root), 10)


@query("words_in_labels", """WITH w AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) > 2)) AS word FROM conversations)
SELECT word, p_partkey AS id FROM w JOIN part ON contains(lower(p_name || ' ' || p_type || ' ' || p_brand), word)""")
def words_in_labels(spark, root):
    words = T.table(spark, root, "conversations").select(F.explode(S.words("text")).alias("word"))
    return R.holding(words, T.table(spark, root, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text")))


@query("knowledge_rank", """SELECT source || '/' || doc_id AS path, s AS score FROM (SELECT *, CAST(contains(lower(source || '/' || doc_id || chr(10) || text), 'ation') AS BIGINT) + CAST(contains(lower(source || '/' || doc_id || chr(10) || text), 'heed') AS BIGINT)
  + 3 * CAST(contains(lower(source || '/' || doc_id || chr(10) || text), 'src1/77') AS BIGINT) AS s FROM documents) WHERE s > 0 ORDER BY s DESC, path LIMIT 5""")
def knowledge_rank(spark, root):
    return R.knowledge_rank(T.files(spark, root), ["ation", "heed"], ["src1/77"])


@query("token_estimate", "SELECT lang, count(*) AS docs, CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def token_estimate(spark, root):
    return T.table(spark, root, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(S.token_estimate("text")).alias("tokens"))


@query("term_overlap", """SELECT doc_id, CAST(len(list_filter(['ation', 'the', 'que', 'ung'], lambda w: contains(lower(text), w))) AS BIGINT) AS relevance, CAST(len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) > 2))) AS BIGINT) AS words FROM documents""")
def term_overlap(spark, root):
    d = T.table(spark, root, "documents")
    return d.select("doc_id", S.contained("text", ["ation", "the", "que", "ung"]).alias("relevance"), F.size(S.words("text")).cast("bigint").alias("words"))


@query("excerpt_lines", "SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')[1:28], chr(10)) AS excerpt FROM documents")
def excerpt_lines(spark, root):
    return T.table(spark, root, "documents").select("doc_id", S.excerpt("text", 28).alias("excerpt"))


def _items(spark, root):
    return T.table(spark, root, "documents").select("source", "lang", "doc_id", S.token_estimate("text").alias("cost"))


@query("budget_prefix", """WITH i AS (SELECT source, doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS cost FROM documents), u AS (SELECT *, row_number() OVER w AS position, CAST(sum(cost) OVER w AS BIGINT) AS used FROM i WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
SELECT source, doc_id, cost, position, used FROM u WHERE used <= 2000""")
def budget_prefix(spark, root):
    return BU.prefix_budget(_items(spark, root).drop("lang"), ["source"], [F.asc("doc_id")], "cost", 2000)


@query("budget_greedy", """WITH RECURSIVE i AS (SELECT lang, doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS cost FROM documents),
g AS (SELECT lang, CAST(-1 AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS cost, CAST(3000 AS BIGINT) AS free FROM (SELECT DISTINCT lang FROM i)
  UNION ALL SELECT lang, doc_id, cost, free - cost FROM (SELECT g.lang, i.doc_id, i.cost, g.free, row_number() OVER (PARTITION BY g.lang ORDER BY i.doc_id) AS r FROM g JOIN i ON i.lang = g.lang AND i.doc_id > g.doc_id AND i.cost <= g.free) WHERE r = 1)
SELECT lang, doc_id, cost FROM g WHERE doc_id >= 0""")
def budget_greedy(spark, root):
    return BU.greedy_budget(_items(spark, root).drop("source"), ["lang"], [F.asc("doc_id")], "cost", 3000)


@query("pack_rows", """SELECT '[' || p_partkey || ',"' || p_name || '",' || p_size || ',' || CASE WHEN p_size > 25 THEN '"' || p_type || '"' ELSE 'null' END || ']' AS "row" FROM part""")
def pack_rows(spark, root):
    p = T.table(spark, root, "part").withColumn("t", F.when(F.col("p_size") > 25, F.col("p_type")))
    return BU.packed_rows(p, ["p_partkey", "p_name", "p_size", "t"])


# -- prompts -------------------------------------------------------------------

def _settled(topic: dict) -> str:
    return " OR ".join(f"contains(lower(t), '{text[:15].lower()}')" for text, _ in topic["answers"])


_IS_OPEN = [f"(regexp_matches(t, '{x['pattern']}') AND NOT ({_settled(x)}))" for x in CL.OPEN_TOPICS]
_OPEN = " + ".join(f"CAST({x} AS INT)" for x in _IS_OPEN)
# Every prompt as it is, once more behind a task line, and that line alone with the conversation's number.
LEADS = ["fix login bug in api ", "Add a cache with in-memory LRU / Map cache to user.ts ", "rename label typo ", "redesign the payments schema migration "]
_LEAD = f"CASE turn % 4 WHEN 0 THEN '{LEADS[0]}' WHEN 1 THEN '{LEADS[1]}' WHEN 2 THEN '{LEADS[2]}' ELSE '{LEADS[3]}' END"
PROMPTS = f"""prompts AS (SELECT conv_id, turn, text AS t FROM conversations WHERE role = 'user'
  UNION ALL SELECT conv_id, turn + 1000, {_LEAD} || text FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn + 2000, {_LEAD} || conv_id FROM conversations WHERE role = 'user')"""


def all_prompts(spark, root):
    p = T.prompts(spark, root)
    lead = F.element_at(F.array(*map(F.lit, LEADS)), (F.col("turn") % 4 + 1).cast("int"))
    long = p.select("conv_id", (F.col("turn") + 1000).alias("turn"), F.concat(lead, "prompt").alias("prompt"))
    short = p.select("conv_id", (F.col("turn") + 2000).alias("turn"), F.concat(lead, F.col("conv_id").cast("string")).alias("prompt"))
    return p.unionByName(long).unionByName(short)


_SCORED = f"""{PROMPTS}, a AS (SELECT conv_id, turn, trim(t) AS t FROM prompts), b AS (SELECT *, {_OPEN} AS o, length(t) AS n FROM a),
c AS (SELECT *, 100 - CASE WHEN n < 25 THEN 40 WHEN n < 50 THEN 20 ELSE 0 END - 25 * o AS s FROM b),
d AS (SELECT *, NOT regexp_matches(t, '(?i)\\.(ts|js|py|go|rs|json|md)\\b|[A-Z][a-zA-Z0-9]+Service|[a-zA-Z0-9]+Handler') AND s < 80 AS v FROM c)"""


@query("prompt_clarity", f"""WITH {_SCORED},
e AS (SELECT *, CAST(greatest(0, least(100, s - CASE WHEN v THEN 10 ELSE 0 END)) AS BIGINT) AS score, CAST(CAST(n < 25 AS INT) + o + CAST(v AS INT) AS BIGINT) AS ambiguities FROM d)
SELECT conv_id, turn, score, score >= 75 AND ambiguities = 0 AS is_clear, ambiguities FROM e""")
def prompt_clarity(spark, root):
    return all_prompts(spark, root).select("conv_id", "turn", CL.prompt_clarity("prompt").alias("c")).select("conv_id", "turn", "c.*")


_LACKS = [("n < 25", "'scope'", "'Prompt is very brief (' || n || ' characters) without declared boundaries.'", CL.BRIEF["why"])]
_LACKS += [(cond, f"'{x['category']}'", "'" + x["open"] + "'", x["why"]) for cond, x in zip(_IS_OPEN, CL.OPEN_TOPICS)]
_LACKS += [("v", "'scope'", "'" + CL.NO_TARGET["open"] + "'", CL.NO_TARGET["why"])]
_LACKING = " UNION ALL ".join(f"SELECT conv_id, turn, {i} AS place, {kind} AS category, {text} AS description, '{why}' AS why FROM d WHERE {cond}" for i, (cond, kind, text, why) in enumerate(_LACKS))


@query("prompt_ambiguities", f"WITH {_SCORED}, x AS ({_LACKING}) SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY place) AS pos, category, description, why FROM x")
def prompt_ambiguities(spark, root):
    return CL.prompt_ambiguities(all_prompts(spark, root), ["conv_id", "turn"])


_ASKS = [*zip(_IS_OPEN, CL.OPEN_TOPICS), (f"n < 25 AND NOT ({' OR '.join(_IS_OPEN)})", CL.FALLBACK)]
_ASKED = " UNION ALL ".join(f"SELECT conv_id, turn, {i} AS place, '{x['question']}' AS question, '{x['why']}' AS context FROM d WHERE {cond}" for i, (cond, x) in enumerate(_ASKS))
_ANSWERS = ", ".join(f"('{x['question']}', '{'ABC'[i]}', '{text}', '{cost}')" for _, x in _ASKS for i, (text, cost) in enumerate(x["answers"]))


@query("prompt_questions", f"""WITH {_SCORED}, x AS ({_ASKED}), ans(question, answer_id, answer, tradeoff) AS (VALUES {_ANSWERS})
SELECT conv_id, turn, 'Q' || row_number() OVER (PARTITION BY conv_id, turn, answer_id ORDER BY place) AS question_id, question, context, answer_id, answer, tradeoff FROM x JOIN ans USING (question)""")
def prompt_questions(spark, root):
    return CL.prompt_questions(all_prompts(spark, root), ["conv_id", "turn"])


def _has(k):
    return f"regexp_matches(lower(t), '{CL.TASK_PATTERNS[k]}')"


@query("task_classify", f"""WITH {PROMPTS}, a AS (SELECT conv_id, turn, {', '.join(f'{_has(k)} AS {k}' for k in CL.TASK_PATTERNS)} FROM prompts),
b AS (SELECT *, CASE WHEN security THEN 'security-change' WHEN database THEN 'database-change' WHEN api THEN 'api-change' WHEN architecture THEN 'architecture-change' WHEN simple THEN 'simple' WHEN bug THEN 'bug' ELSE 'feature' END AS kind,
  CASE WHEN security THEN 'critical' WHEN database OR api OR architecture THEN 'high' WHEN simple THEN 'low' ELSE 'medium' END AS risk FROM a)
SELECT conv_id, turn, kind, risk, CAST(CASE WHEN risk = 'critical' OR kind = 'architecture-change' THEN 15000 WHEN risk = 'high' THEN 10000 WHEN risk = 'low' THEN 2000 ELSE 6000 END AS BIGINT) AS budget,
  coalesce(nullif(concat_ws(',', CASE WHEN security THEN 'security' END, CASE WHEN database THEN 'database' END, CASE WHEN api THEN 'api' END, CASE WHEN architecture THEN 'architecture' END), ''), 'application') AS domains,
  concat_ws(',', 'standard', CASE WHEN security THEN 'adversarial' END, CASE WHEN architecture THEN 'design-first' END) AS modes,
  concat_ws(',', 'ei-knowledge', 'ei-graph', 'cce', 'native-retrieval', CASE WHEN security THEN 'security-gates' END, CASE WHEN api THEN 'api-gates' END, CASE WHEN database THEN 'migration-gates' END, CASE WHEN architecture THEN 'design-first' END) AS route,
  concat_ws(',', CASE kind WHEN 'security-change' THEN 'security review' WHEN 'api-change' THEN 'api-diff' WHEN 'database-change' THEN 'migration-lint' END, 'type-check', 'targeted tests') AS gates FROM b""")
def task_classify(spark, root):
    return all_prompts(spark, root).select("conv_id", "turn", CL.classify("prompt").alias("c")).select("conv_id", "turn", "c.*")
