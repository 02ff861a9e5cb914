"""Second-source trust, facts, claims, citations and freshness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailgraph.functions import scalar as S
from trailgraph.operators import claims as C
from trailgraph.operators import freshness as FR
from trailgraph.operators import trust as TR
from trailgraph.plans.graph_queries import SUCC
from trailgraph.plans.registry import query
from trailgraph.sources import tables as T

LINES = """lines AS (SELECT source || '/' || doc_id AS path, doc_id, unnest(string_split(text, chr(10))) AS line,
  CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line_no FROM documents)"""

TRUST_NODES = """h AS (
  SELECT 'orders/' || o_orderkey AS path, sha256('orders/' || o_orderkey) AS current, CASE WHEN o_orderstatus = 'P' THEN 'old' ELSE sha256('orders/' || o_orderkey) END AS expected FROM orders
  UNION ALL SELECT 'part/' || p_partkey, sha256('part/' || p_partkey), CASE WHEN p_size NOT BETWEEN 20 AND 25 THEN sha256('part/' || p_partkey) END FROM part),
raw AS (
  SELECT 'order:' || o_orderkey AS raw_id, o_orderpriority AS label, 'orders/' || o_orderkey AS file, 'order:' || o_orderkey AS native FROM orders
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'part/' || p_partkey, CASE WHEN p_size BETWEEN 11 AND 40 THEN 'part:' || p_partkey END FROM part
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, NULL, NULL FROM supplier),
n AS (SELECT raw_id, file, native, CASE WHEN file IS NULL THEN 'unverifiable' WHEN current = expected THEN 'fresh' ELSE 'stale' END AS trust_state,
  coalesce(native, 'second:' || raw_id) AS id FROM raw LEFT JOIN h ON h.path = raw.file),
ns AS (SELECT *, CASE WHEN native IS NOT NULL THEN 'matched' WHEN trust_state = 'fresh' THEN 'accepted' ELSE 'unaccepted' END AS status FROM n)"""
TRUST_EDGES = TRUST_NODES + """, re AS (
  SELECT 'order:' || l_orderkey AS source, CASE WHEN l_discount = 0 THEN 'nowhere' ELSE 'part:' || l_partkey END AS target,
    CASE l_returnflag WHEN 'A' THEN 'defines' WHEN 'N' THEN 'imports' ELSE 'uses' END AS relation,
    ((CAST(l_orderkey AS BIGINT) * 100 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey * 2 AS ord FROM lineitem
  UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'shipped_by', ((CAST(l_orderkey AS BIGINT) * 100 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey * 2 + 1 FROM lineitem),
nat AS (SELECT DISTINCT 'order:' || l_orderkey AS src, CASE WHEN p_size BETWEEN 11 AND 40 THEN '' ELSE 'second:' END || 'part:' || l_partkey AS dst FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'O'),
j AS (SELECT re.*, s.id AS src, t.id AS dst, s.trust_state AS st, t.trust_state AS tt FROM re LEFT JOIN n s ON s.raw_id = source LEFT JOIN n t ON t.raw_id = target),
k AS (SELECT j.*, CASE WHEN j.src IS NULL OR j.dst IS NULL THEN 'rejected' WHEN st <> 'fresh' OR tt = 'stale' THEN 'stale'
  WHEN relation = 'defines' AND nat.src IS NOT NULL THEN 'corroborated' ELSE 'accepted' END AS status, nat.src IS NOT NULL AS native_ends
  FROM j LEFT JOIN nat ON nat.src = j.src AND nat.dst = j.dst),
f AS (SELECT src, dst, relation, min(ord) AS first_ord FROM k WHERE status = 'accepted' GROUP BY ALL),
p AS (SELECT src, dst, min(first_ord) AS pair_ord FROM f GROUP BY ALL),
es AS (SELECT k.src, k.dst, k.relation, k.ord, CASE WHEN status = 'accepted' AND ord <> first_ord THEN 'merged' ELSE status END AS status,
  CASE WHEN status = 'corroborated' THEN 'fresh' WHEN status = 'accepted' AND ord = first_ord THEN CASE WHEN native_ends OR first_ord > pair_ord THEN 'contested' ELSE 'unverifiable' END END AS trust_state
  FROM k LEFT JOIN f USING (src, dst, relation) LEFT JOIN p USING (src, dst))"""


def _trust_nodes(spark, root):
    """(node rows, native nodes, hashes); reads no line items."""
    o, p, s = (T.table(spark, root, t) for t in ("orders", "part", "supplier"))
    oid, pid = T.node_id("order", "o_orderkey"), T.node_id("part", "p_partkey")
    opath = F.concat_ws("/", F.lit("orders"), F.col("o_orderkey").cast("string"))
    ppath = F.concat_ws("/", F.lit("part"), F.col("p_partkey").cast("string"))
    hashes = o.select(opath.alias("path"), F.sha2(opath, 256).alias("current"), F.when(F.col("o_orderstatus") == "P", "old").otherwise(F.sha2(opath, 256)).alias("expected")).unionByName(
        p.select(ppath.alias("path"), F.sha2(ppath, 256).alias("current"), F.when(~F.col("p_size").between(20, 25), F.sha2(ppath, 256)).alias("expected")))
    verified = F.lit("verified").alias("confidence")
    native = o.select(oid.alias("id"), F.lit("module").alias("kind"), F.col("o_orderpriority").alias("label"), opath.alias("path"), verified, F.col("o_orderkey").alias("ord")).unionByName(
        p.filter("p_size between 11 and 40").select(pid.alias("id"), F.lit("symbol").alias("kind"), F.col("p_name").alias("label"), ppath.alias("path"), verified, F.col("p_partkey").alias("ord")))
    false = F.lit(False).alias("excluded")
    raw = (
        o.select(oid.alias("raw_id"), F.col("o_orderpriority").alias("label"), opath.alias("source_file"), false, F.col("o_orderkey").alias("ord"))
        .unionByName(p.select(pid.alias("raw_id"), F.col("p_name").alias("label"), ppath.alias("source_file"), false, F.col("p_partkey").alias("ord")))
        .unionByName(s.select(T.node_id("supplier", "s_suppkey").alias("raw_id"), F.col("s_name").alias("label"), F.lit(None).cast("string").alias("source_file"), false, F.col("s_suppkey").alias("ord"))))
    return TR.reconcile_nodes(native, raw, hashes, "second"), native, hashes


def _trust(spark, root):
    nodes, native, hashes = _trust_nodes(spark, root)
    p, li = T.table(spark, root, "part"), T.table(spark, root, "lineitem")
    pid = T.node_id("part", "p_partkey")
    verified, false = F.lit("verified").alias("confidence"), F.lit(False).alias("excluded")
    ord_ = ((F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey") * 2
    none = F.lit(None).cast("string")
    raw_edges = li.select(
        T.node_id("order", "l_orderkey").alias("source"), F.when(F.col("l_discount") == 0, "nowhere").otherwise(T.node_id("part", "l_partkey")).alias("target"),
        F.when(F.col("l_returnflag") == "A", "contains").when(F.col("l_returnflag") == "N", "depends-on").otherwise("Uses").alias("relation"),
        F.lit("EXTRACTED").alias("confidence"), none.alias("source_file"), false, ord_.alias("ord")).unionByName(
        li.select(T.node_id("part", "l_partkey").alias("source"), T.node_id("supplier", "l_suppkey").alias("target"), F.lit("Shipped by").alias("relation"),
                  F.lit("GUESSED").alias("confidence"), none.alias("source_file"), false, (ord_ + 1).alias("ord")))
    kind = p.select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size").between(11, 40), pid).otherwise(F.concat(F.lit("second:"), pid)).alias("dst"))
    # Distinct as keys, before they become text.
    held = li.filter("l_linestatus = 'O'").select("l_orderkey", "l_partkey").distinct().join(kind.distinct(), "l_partkey")
    native_edges = held.select(T.node_id("order", "l_orderkey").alias("src"), "dst", F.lit("defines").alias("relation"), verified, F.lit(0).alias("ord"))
    return nodes, TR.reconcile_edges(native_edges, nodes, raw_edges, hashes), native, native_edges


@query("trust_nodes", f"WITH {TRUST_NODES} SELECT raw_id, id, trust_state, status FROM ns")
def trust_nodes(spark, root):
    return _trust_nodes(spark, root)[0].select("raw_id", "id", "trust_state", "status")


@query("trust_reconcile", f"WITH {TRUST_EDGES} SELECT src, dst, relation, status, trust_state FROM es")
def trust_reconcile(spark, root):
    return _trust(spark, root)[1].select("src", "dst", "relation", "status", "trust_state")


@query("trust_counters", f"""WITH {TRUST_EDGES} SELECT (SELECT count(*) FROM ns WHERE status = 'accepted') AS accepted_nodes,
  count(*) FILTER (status = 'accepted') AS accepted_edges, count(*) FILTER (status = 'corroborated') AS corroborated_edges, count(*) FILTER (trust_state = 'contested') AS contested_edges,
  count(*) FILTER (status = 'stale') + (SELECT count(*) FROM ns WHERE trust_state = 'stale') AS stale_evidence, count(*) FILTER (status = 'rejected') AS rejected_evidence FROM es""")
def trust_counters(spark, root):
    return TR.counters(*_trust(spark, root)[:2])


@query("provider_graph_nodes", f"""WITH {TRUST_NODES}, own AS (
  SELECT 'order:' || o_orderkey AS id, 'module' AS kind, o_orderpriority AS label, 'orders/' || o_orderkey AS path FROM orders UNION ALL SELECT 'part:' || p_partkey, 'symbol', p_name, 'part/' || p_partkey FROM part WHERE p_size BETWEEN 11 AND 40)
SELECT own.id, kind, label, path, 'verified' AS confidence, CASE WHEN trust_state = 'fresh' THEN 'native,second' ELSE 'native' END AS providers, CASE WHEN trust_state = 'fresh' THEN 'fresh' END AS trust_state, CASE WHEN trust_state = 'fresh' THEN true END AS corroborated FROM own LEFT JOIN ns ON ns.native = own.id
UNION ALL SELECT id, 'provider-symbol', p_name, file, 'unknown', 'second', 'fresh', NULL FROM ns JOIN part ON raw_id = 'part:' || p_partkey WHERE status = 'accepted'""")
def provider_graph_nodes(spark, root):
    rows, native, _ = _trust_nodes(spark, root)
    found = TR.project_nodes(native, rows, "second")
    return found.select("id", "kind", "label", "path", "confidence", F.array_join("providers", ",").alias("providers"), "trust_state", "corroborated")


@query("provider_graph_edges", f"""WITH {TRUST_EDGES}, x AS (SELECT src, dst, relation, count(*) AS n, bool_or(status = 'corroborated') AS native, min(trust_state) FILTER (status = 'accepted') AS trust FROM es WHERE status IN ('corroborated', 'accepted', 'merged') GROUP BY ALL),
c AS (SELECT k.src, k.dst, k.relation, arg_min(CASE WHEN k.relation = 'shipped_by' THEN 'unknown' ELSE 'inferred' END, ord) AS confidence FROM k WHERE status = 'accepted' GROUP BY ALL)
SELECT src, dst, relation, confidence, 'second' AS providers, trust AS trust_state, false AS corroborated, n - 1 AS repeats FROM x JOIN c USING (src, dst, relation) WHERE NOT native
UNION ALL SELECT nat.src, nat.dst, 'defines', 'verified', CASE WHEN n IS NULL THEN 'native' ELSE 'native,second' END, CASE WHEN n IS NOT NULL THEN 'fresh' END, CASE WHEN n IS NOT NULL THEN true END, coalesce(n, 1) - 1 FROM nat LEFT JOIN x ON x.src = nat.src AND x.dst = nat.dst AND relation = 'defines'""")
def provider_graph_edges(spark, root):
    _, rows, _, native_edges = _trust(spark, root)
    found = TR.project_edges(native_edges, rows, "second")
    return found.select("src", "dst", "relation", "confidence", F.array_join("providers", ",").alias("providers"), "trust_state", "corroborated", "repeats")


FACTS = f"""{SUCC}, facts AS (
  SELECT 'source-file|part/' || p_partkey AS fact_key, 'source-file' AS type, 'Source module `part/' || p_partkey || '` is in the approved project scope.' AS statement FROM part WHERE p_size > 5
  UNION SELECT 'module-imports|part/' || src || '|part/' || dst, 'module-imports', 'Module `part/' || src || '` imports `part/' || dst || '`.' FROM succ JOIN part ON p_partkey = dst WHERE p_size > 5 AND n <= 2
  UNION SELECT 'package-dependency|' || s_name, 'package-dependency', '`' || s_name || '` is a declared package dependency.' FROM supplier WHERE s_acctbal > 0 AND s_nationkey >= 5)"""


def _facts(spark, root, min_size=5, only_pairs=True):
    p, s = T.table(spark, root, "part"), T.table(spark, root, "supplier")
    ppath = F.concat_ws("/", F.lit("part"), F.col("p_partkey").cast("string"))
    none = F.lit(None)
    nodes = p.select(T.node_id("part", "p_partkey").alias("id"), F.lit("module").alias("kind"), F.col("p_name").alias("label"), ppath.alias("path"),
                     F.when(F.col("p_size") > min_size, "verified").otherwise("inferred").alias("confidence"), none.cast("boolean").alias("declared"), none.cast("boolean").alias("dev"), ppath.alias("evidence")).unionByName(
        s.select(T.node_id("supplier", "s_suppkey").alias("id"), F.lit("package").alias("kind"), F.col("s_name").alias("label"), none.cast("string").alias("path"), F.lit("verified").alias("confidence"),
                 (F.col("s_acctbal") > 0).alias("declared"), (F.col("s_nationkey") < 5).alias("dev"), F.lit("package.json").alias("evidence")))
    trust = F.when(F.col("n") > 2, "contested") if only_pairs else none.cast("string")
    edges = T.successor_edges(spark, root).select(
        T.node_id("part", "src").alias("src"), T.node_id("part", "dst").alias("dst"), F.lit("imports").alias("relation"), trust.alias("trust_state"),
        none.cast("string").alias("provider"), none.cast("boolean").alias("corroborated"), none.cast("string").alias("evidence"))
    return C.derive_facts(nodes, edges)


@query("derive_facts", f"WITH {FACTS} SELECT fact_key, type, statement FROM facts")
def derive_facts(spark, root):
    return _facts(spark, root).select("fact_key", "type", "statement")


@query("fact_diff", f"""WITH {FACTS}, later AS (SELECT 'source-file|part/' || p_partkey AS fact_key FROM part WHERE p_size > 8
  UNION SELECT 'module-imports|part/' || src || '|part/' || dst FROM succ JOIN part ON p_partkey = dst WHERE p_size > 8
  UNION SELECT 'package-dependency|' || s_name FROM supplier WHERE s_acctbal > 0 AND s_nationkey >= 5)
SELECT fact_key, 'removed' AS change FROM facts WHERE fact_key NOT IN (SELECT fact_key FROM later) UNION ALL SELECT fact_key, 'added' FROM later WHERE fact_key NOT IN (SELECT fact_key FROM facts)""")
def fact_diff(spark, root):
    return C.fact_diff(_facts(spark, root), _facts(spark, root, 8, False))


NORM = "substr(sha256(regexp_replace(regexp_replace({}, '(?m)[ \\t]+$', '', 'g'), '\\n+\\z', '')), 1, 16)"


@query("span_hash", f"""SELECT doc_id, {NORM.format('text')} AS whole, {NORM.format("array_to_string(string_split(text, chr(10))[2:4], chr(10))")} AS lines_2_4 FROM documents WHERE len(string_split(text, chr(10))) >= 2
UNION ALL SELECT doc_id, {NORM.format('text')}, NULL FROM documents WHERE len(string_split(text, chr(10))) < 2""")
def span_hash(spark, root):
    f = T.files(spark, root)
    return f.select("doc_id", S.span_hash("content").alias("whole"), S.span_hash(S.line_span("content", F.lit(2), F.lit(4))).alias("lines_2_4"))


CLAIMS = f"""{FACTS}, st AS (SELECT doc_id, lang, source, len(string_split(text, chr(10))) AS n FROM documents),
v AS (SELECT 'doc' || doc_id AS id, 'asserted' AS kind, CASE WHEN lang = 'de' OR n < 2 THEN 'missing' WHEN lang = 'fr' THEN 'stale' ELSE 'unverified' END AS status,
  CAST(lang = 'fr' AS BIGINT) AS stale, CAST(lang = 'de' AS BIGINT) + CAST(n < 2 AS BIGINT) AS missing FROM st
  UNION ALL SELECT 'part' || p_partkey, 'derived', CASE WHEN 'source-file|part/' || p_partkey IN (SELECT fact_key FROM facts) THEN 'verified' ELSE 'refuted' END, 0, 0 FROM part)"""


def _verified(spark, root):
    """Two pins per document (whole text, lines 2-4); the text of French ones
    changed since, German ones point to a file that is gone."""
    f = T.files(spark, root)
    text = F.when(F.col("ext") == "fr", F.concat("content", F.lit(" edited"))).otherwise(F.col("content"))
    path = F.when(F.col("ext") == "de", F.concat(F.lit("gone/"), "path")).otherwise(F.col("path"))
    cid = F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("claim_id")
    none = F.lit(None).cast("int")
    whole = f.select(cid, path.alias("path"), none.alias("start"), none.alias("end"), S.span_hash(text).alias("hash"))
    part = f.select(cid, F.col("path"), F.lit(2).alias("start"), F.lit(4).alias("end"), S.span_hash(S.line_span("content", F.lit(2), F.lit(4))).alias("hash"))
    none_s = F.lit(None).cast("string")
    claims = f.select(cid.alias("id"), F.lit("asserted").alias("kind"), none_s.alias("fact_key")).unionByName(
        T.table(spark, root, "part").select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("id"), F.lit("derived").alias("kind"), F.concat(F.lit("source-file|part/"), F.col("p_partkey").cast("string")).alias("fact_key")))
    return C.verify_claims(claims, whole.unionByName(part), f, _facts(spark, root))


@query("claim_verify", f"WITH {CLAIMS} SELECT * FROM v")
def claim_verify(spark, root):
    return _verified(spark, root)


@query("claim_status_counts", f"""WITH {CLAIMS} SELECT count(*) AS total, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'refuted') AS refuted,
  count(*) FILTER (status = 'unverified') AS unverified, count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status = 'missing') AS missing FROM v""")
def claim_status_counts(spark, root):
    return C.status_counts(_verified(spark, root))


@query("claims_from_facts", """SELECT 'CLM-D' || substr(sha256('source-file|' || source || '/' || doc_id), 1, 12) AS id, 'source-file|' || source || '/' || doc_id AS fact_key, """ + NORM.format("text") + """ AS hash FROM documents""")
def claims_from_facts(spark, root):
    f = T.files(spark, root)
    none = F.lit(None)
    nodes = f.select(F.concat(F.lit("module:"), "path").alias("id"), F.lit("module").alias("kind"), F.col("path").alias("label"), "path", F.lit("verified").alias("confidence"),
                     none.cast("boolean").alias("declared"), none.cast("boolean").alias("dev"), F.col("path").alias("evidence"))
    edges = nodes.limit(0).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("kind").alias("relation"), F.col("kind").alias("trust_state"), F.col("kind").alias("provider"), F.col("dev").alias("corroborated"), "evidence")
    return C.claims_from_facts(C.derive_facts(nodes, edges), f).select("id", "fact_key", "hash")


@query("relocated_citation", f"""WITH {LINES}, p AS (SELECT path, line_no + line_no % 3 AS line, substr(sha1(line), 1, 16) AS hash FROM lines
  UNION SELECT 'gone/' || path, line_no, substr(sha1(line), 1, 16) FROM lines WHERE line_no = 1),
h AS (SELECT path, line_no, substr(sha1(line), 1, 16) AS hash FROM lines), n AS (SELECT path, max(line_no) AS n FROM lines GROUP BY path),
r AS (SELECT p.path, p.line, p.hash, arg_min(h.line_no, abs(h.line_no - p.line) * 1000000 + h.line_no) AS near FROM p JOIN h ON h.path = p.path AND h.hash = p.hash AND abs(h.line_no - p.line) BETWEEN 1 AND 25 GROUP BY ALL),
x AS (SELECT p.path, p.line, CASE WHEN n.n IS NULL THEN 'missing-file' WHEN h.hash = p.hash THEN 'ok' WHEN r.near IS NOT NULL THEN 'relocated' WHEN h.hash IS NULL THEN 'missing-line' ELSE 'stale' END AS status, r.near AS near
  FROM p LEFT JOIN h ON h.path = p.path AND h.line_no = p.line LEFT JOIN n ON n.path = p.path LEFT JOIN r ON r.path = p.path AND r.line = p.line AND r.hash = p.hash)
SELECT path AS file, line, status, CASE WHEN status = 'relocated' THEN near END AS relocated_line FROM x""")
def relocated_citation(spark, root):
    lines = T.lines(T.files(spark, root)).select("path", "line_no", "line")
    h = F.substring(F.sha1("line"), 1, 16).alias("hash")
    pins = lines.select(h.alias("doc"), F.col("path").alias("file"), (F.col("line_no") + F.col("line_no") % 3).alias("line"), h).unionByName(
        lines.filter("line_no = 1").select(h.alias("doc"), F.concat(F.lit("gone/"), "path").alias("file"), F.col("line_no").alias("line"), h)).distinct()
    return C.check_citations(pins, lines).select("file", "line", "status", "relocated_line")


@query("knowledge_references", """WITH r AS (SELECT 'doc' || doc_id AS file, 'src/' || lang || '/' || source || '.md' AS reference, doc_id AS ord FROM documents
  UNION ALL SELECT 'doc' || doc_id, 'docs/' || doc_id || '.json', doc_id FROM documents),
o AS (SELECT reference, arg_min(file, ord) AS file FROM r GROUP BY reference)
SELECT file, reference, reference IN (SELECT 'src/' || lang || '/' || source || '.md' FROM documents WHERE n_chars > 2000) AS "exists" FROM o""")
def knowledge_references(spark, root):
    f = T.table(spark, root, "documents")
    ref = F.concat(F.lit("src/"), "lang", F.lit("/"), "source", F.lit(".md"))
    docs = f.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("ord"),
                    F.concat("text", F.lit("\nSee `"), ref, F.lit(":12` and `docs/"), F.col("doc_id").cast("string"), F.lit(".json`.")).alias("content"))
    return C.knowledge_references(docs, f.filter("n_chars > 2000").select(ref.alias("path")))


# A document per row: its text, two order citations (one may not exist) and a date.
DOCS = """d AS (SELECT doc_id, source || '/' || doc_id AS path, lang, CASE WHEN lang <> 'fr' THEN TIMESTAMP '1998-01-01' + INTERVAL 1 DAY * (doc_id % 2000) END AS updated FROM documents),
c AS (SELECT doc_id, path, updated, doc_id AS o FROM d WHERE lang <> 'de' UNION SELECT doc_id, path, updated, doc_id * 31 FROM d WHERE lang <> 'de'),
now AS (SELECT max(o_orderdate) AS t FROM orders),
s AS (SELECT c.path, sum(CASE WHEN o_orderkey IS NULL THEN 25 WHEN o_orderdate > updated THEN least(30, floor((epoch_us(o_orderdate) - epoch_us(updated)) / 86400000000 * 3 + 0.5)) ELSE 0 END) AS penalty,
  count(*) FILTER (o_orderkey IS NULL) AS deleted_sources, count(*) FILTER (o_orderdate > updated) AS stale_sources FROM c LEFT JOIN orders ON o_orderkey = o GROUP BY c.path),
x AS (SELECT d.path, CASE WHEN lang = 'de' THEN 0 ELSE CAST(greatest(0, least(100, floor(100 - penalty - coalesce(greatest(0, least(20, (epoch_us(t) - epoch_us(updated)) / 86400000000 * 0.5)), 0) + 0.5))) AS BIGINT) END AS score,
  lang, coalesce(stale_sources, 0) AS stale_sources, coalesce(deleted_sources, 0) AS deleted_sources FROM d LEFT JOIN s USING (path), now),
scores AS (SELECT path, score, CASE WHEN lang = 'de' THEN 'unverifiable' WHEN score >= 80 THEN 'fresh' WHEN score >= 60 THEN 'aging' WHEN score >= 40 THEN 'stale' WHEN score >= 20 THEN 'very-stale' ELSE 'obsolete' END AS status, stale_sources, deleted_sources FROM x)"""


def dated_docs(spark, root):
    d = T.table(spark, root, "documents")
    k = F.col("doc_id").cast("string")
    cites = F.when(F.col("lang") != "de", F.concat(F.lit("\n(evidence: orders/"), k, F.lit(", `orders/"), (F.col("doc_id") * 31).cast("string"), F.lit("`:12-40, prose note)"))).otherwise("")
    stamp = F.date_format(F.date_add(F.lit("1998-01-01").cast("date"), (F.col("doc_id") % 2000).cast("int")), "yyyy-MM-dd")
    date = F.when(F.col("lang") != "fr", F.concat(F.lit("\nLast updated: "), stamp)).otherwise("")
    return d.select(F.concat_ws("/", "source", k).alias("path"), F.concat("text", cites, date).alias("content"))


def _scores(spark, root):
    o = T.table(spark, root, "orders").select(F.concat_ws("/", F.lit("orders"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderdate").alias("modified"))
    return FR.score_documents(dated_docs(spark, root), o, T.commits(spark, root).agg(F.max("ts")).scalar())


@query("evidence_extract", """SELECT source || '/' || doc_id AS path, 'orders/' || doc_id AS cited FROM documents WHERE lang <> 'de' UNION SELECT source || '/' || doc_id, 'orders/' || doc_id * 31 FROM documents WHERE lang <> 'de'""")
def evidence_extract(spark, root):
    return dated_docs(spark, root).select("path", F.explode(FR.cited_paths("content")).alias("cited"))


@query("doc_freshness", f"""WITH {DOCS} SELECT path, score, status, CASE WHEN status IN ('fresh', 'aging') THEN 'none' WHEN status = 'stale' THEN 'incremental-sync' WHEN status = 'very-stale' THEN 'full-regeneration' ELSE 'manual-review' END AS action, stale_sources, deleted_sources FROM scores""")
def doc_freshness(spark, root):
    return _scores(spark, root)


@query("drift_decision", f"""WITH {DOCS}, a AS (SELECT CAST(coalesce(min(score) FILTER (status <> 'unverifiable'), 100) AS BIGINT) AS min_score, count(*) FILTER (status = 'fresh') AS fresh, count(*) FILTER (status = 'aging') AS aging, count(*) FILTER (status = 'stale') AS stale,
  count(*) FILTER (status = 'very-stale') AS very_stale, count(*) FILTER (status = 'obsolete') AS obsolete, count(*) FILTER (status = 'unverifiable') AS unverifiable FROM scores)
SELECT *, CASE WHEN min_score < 50 THEN 'Block implementation' WHEN min_score < 60 THEN 'Sync before implementation' ELSE 'Proceed' END AS decision FROM a""")
def drift_decision(spark, root):
    return FR.drift_decision(_scores(spark, root))


@query("stalest_documents", f"WITH {DOCS} SELECT path, score FROM scores WHERE status <> 'unverifiable' ORDER BY score, path LIMIT 5")
def stalest_documents(spark, root):
    return FR.stalest(_scores(spark, root).filter("status <> 'unverifiable'")).select("path", "score")
