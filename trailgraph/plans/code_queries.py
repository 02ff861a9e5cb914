"""Queries over source trees, manifests and logs built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailgraph.functions import scalar as S
from trailgraph.operators import build as B
from trailgraph.operators import clarity as CL
from trailgraph.plans import build_graph as BG
from trailgraph.plans.graph_queries import SUCC
from trailgraph.plans.registry import query
from trailgraph.sources import code, logs, manifests, policy
from trailgraph.sources import tables as T

P = "p AS (SELECT p_partkey AS k, 'src/' || replace(p_brand, '#', '') AS dir, replace(p_name, ' ', '-') AS pkg FROM part)"
IMPORTS = f"""{SUCC}, {P}, l AS (SELECT a.dir || '/links/p' || src || '_p' || dst AS f, a.dir || '/p' || src AS s, b.dir || '/p' || dst AS d, a.dir || '/links/gone' || src AS g, src, dst FROM succ JOIN p a ON a.k = src JOIN p b ON b.k = dst),
imp AS (SELECT 'module:' || dir || '/p' || k AS src, 'pkg:' || pkg AS dst, 'imports' AS relation, 4 AS line FROM p
  UNION ALL SELECT 'module:' || f, 'module:' || s, 'imports', 1 FROM l UNION ALL SELECT 'module:' || f, 'module:' || d, 'imports', 3 FROM l WHERE d <> s UNION ALL SELECT 'module:' || f, 'module:' || g, 'imports', 4 FROM l)"""


@query("js_imports", f"WITH {IMPORTS} SELECT src, dst, relation, CAST(line AS BIGINT) AS line FROM imp")
def js_imports(spark, root):
    tree = T.source_tree(spark, root)
    return code.imports(code.scan(tree, definitions=False), tree).select(S.module_id("file").alias("src"), F.col("target").alias("dst"), "relation", "line")


@query("import_unknowns", f"WITH {IMPORTS} SELECT 'unresolved import \"./gone' || src || '\" at ' || f || '.ts:4' AS note FROM l")
def import_unknowns(spark, root):
    return BG.unresolved(BG.imports_alone(T.source_tree(spark, root))[0])


SYMS = f"""{IMPORTS}, sym AS (SELECT 'symbol:' || dir || '/p' || k || '#load' || k AS id, 'load' || k AS label, 'function' AS symbol_kind, 9 AS line FROM p UNION ALL SELECT 'symbol:' || dir || '/p' || k || '#keep' || k, 'keep' || k, 'function', 13 FROM p
  UNION ALL SELECT 'symbol:' || dir || '/p' || k || '#Box' || k, 'Box' || k, 'class', 16 FROM p UNION ALL SELECT 'symbol:' || dir || '/p' || k || '#Box' || k || '.open' || k, 'Box' || k || '.open' || k, 'method', 17 FROM p UNION ALL SELECT 'symbol:' || f || '#link', 'link', 'function', 5 FROM l),
calls AS (SELECT 'symbol:' || dir || '/p' || k || '#load' || k AS src, 'symbol:' || dir || '/p' || k || '#keep' || k AS dst, 'verified' AS confidence FROM p
  UNION ALL SELECT 'symbol:' || dir || '/p' || k || '#Box' || k || '.open' || k, 'symbol:' || dir || '/p' || k || '#load' || k, 'verified' FROM p
  UNION ALL SELECT 'symbol:' || dir || '/p' || k || '#Box' || k, 'symbol:' || dir || '/p' || k || '#Box' || k || '.open' || k, 'verified' FROM p
  UNION ALL SELECT 'symbol:' || dir || '/p' || k || '#Box' || k, 'symbol:' || dir || '/p' || k || '#load' || k, 'verified' FROM p
  UNION ALL SELECT 'symbol:' || f || '#link', 'symbol:' || s || '#load' || src, 'inferred' FROM l UNION ALL SELECT 'symbol:' || f || '#link', 'symbol:' || d || '#Box' || dst || '.open' || dst, 'inferred' FROM l)"""


@query("symbols", f"WITH {SYMS} SELECT id, label, symbol_kind, CAST(line AS BIGINT) AS line FROM sym")
def symbols(spark, root):
    return code.symbols(code.scan(T.source_tree(spark, root))).select("id", "label", "symbol_kind", "line")


@query("call_edges", f"WITH {SYMS} SELECT src, dst, confidence FROM calls")
def call_edges(spark, root):
    g = BG.build_graph(T.source_tree(spark, root))
    return g.edges.filter("relation = 'calls'").select("src", "dst", "confidence")


@query("graph_build", f"""WITH {SYMS}, e AS (SELECT relation FROM imp UNION ALL SELECT 'defines' FROM sym UNION ALL SELECT 'calls' FROM calls)
SELECT relation, count(*) AS n FROM e GROUP BY relation""")
def graph_build(spark, root):
    return BG.build_graph(T.source_tree(spark, root)).edges.groupBy("relation").agg(F.count("*").alias("n"))


# A tree of which one list excludes two folders' modules and an ignore file takes one more, but for a part it gives back.
_RULE = """CASE WHEN regexp_matches(path, '^src/Brand2[^/]/p[^/]*$') THEN 'explicit-exclude' WHEN regexp_matches(path, '^src/Brand3[^/]/p[^/]*$') AND NOT regexp_matches(path, '^src/Brand33/p[^/]*$') THEN 'gitignore' END"""


@query("external_targets", f"""WITH {IMPORTS}, t AS (SELECT DISTINCT f, path FROM (SELECT f, s || '.ts' AS path FROM l UNION ALL SELECT f, d || '.ts' FROM l)), x AS (SELECT *, {_RULE} AS rule FROM t)
SELECT 'external:' || path AS id, split_part(path, '/', -1) AS label, path AS excluded_path, rule AS policy_source, CASE rule WHEN 'gitignore' THEN '/src/Brand3?/p*' ELSE 'src/Brand2?/p*.ts' END AS policy_pattern,
  CASE rule WHEN 'gitignore' THEN 'excluded by gitignore' ELSE 'matched exclude' END AS policy_reason, count(*) AS importers FROM x WHERE rule IS NOT NULL GROUP BY ALL""")
def external_targets(spark, root):
    rules = policy.FilePolicy(exclude=["src/Brand2?/p*.ts"], git_ignore=policy.ignore_rules("# modules\n/src/Brand3?/p*\n!/src/Brand33/p*\n"))
    imports, externals = BG.imports_alone(T.source_tree(spark, root), rules)
    edges = BG.import_rows(imports.filter("kind = 'external' and relation = 'imports'")).select("src", "dst").distinct()
    importers = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("importers"))
    return externals.join(importers, "id").select("id", "label", "excluded_path", "policy_source", "policy_pattern", "policy_reason", "importers")


@query("graph_scale", f"""WITH {SYMS}, m AS (SELECT 'module:' || dir || '/p' || k AS id FROM p UNION SELECT 'module:' || f FROM l UNION SELECT 'module:' || g FROM l)
SELECT (SELECT count(*) FROM m) AS modules, (SELECT count(*) FROM sym) AS symbols, (SELECT count(DISTINCT pkg) FROM p) AS packages, (SELECT count(*) FROM imp) + (SELECT count(*) FROM sym) + (SELECT count(*) FROM calls) AS edges""")
def graph_scale(spark, root):
    return BG.scale(BG.build_graph(T.source_tree(spark, root)))


def polyglot_tree(spark, root):
    """One Python, Go, Rust, Ruby and Java file per supplier row."""
    s = T.table(spark, root, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_nationkey").cast("string").alias("n"))
    body = {
        "py": "from .core%s import x\nfrom ..base.util import y\nfrom pkg%s.sub import z\nimport os, json.decoder as j\nprint('import no')\n",
        "go": 'package m\nimport "fmt"\nimport a "github.com/o%s/r/v2/x"\nimport (\n  "os"\n  b "example.org/n%s/q"\n)\nvar s = "gopkg.in/no"\n',
        "rs": "use std::io;\nuse crate::mod%s::Thing;\npub use serde%s::{a, b};\nextern crate rand;\n",
        "rb": "require_relative '../lib/h%s'\nrequire 'rails%s/x'\nputs 'x'\n",
        "java": "import java.util.List;\nimport com.acme%s.deep.Thing;\nimport static org.n%s.Util.go;\n",
        "kt": "import com.acme%s.x\nimport io.k%s.y;\n",
    }
    out = None
    for ext, text in body.items():
        df = s.select(F.format_string(f"app/mod/f%s.{ext}", "k").alias("path"), F.format_string(text, "k", "n").alias("content"))
        out = df if out is None else out.unionByName(df)
    return out


@query("polyglot_imports", """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier), i(ext, a, b, line, key) AS (VALUES ('py', 'module:app/mod/core', '', 1, 'k'), ('py', 'module:app/base/util', '', 2, ''), ('py', 'pkg:pkg', '', 3, 'n'), ('py', 'pkg:os', '', 4, ''), ('py', 'pkg:json', '', 4, ''),
  ('go', 'pkg:github.com/o', '/r', 3, 'k'), ('go', 'pkg:example.org/n', '/q', 6, 'n'), ('rs', 'module:app/mod/mod', '', 2, 'k'), ('rs', 'pkg:serde', '', 3, 'n'), ('rs', 'pkg:rand', '', 4, ''),
  ('rb', 'module:app/lib/h', '', 1, 'k'), ('rb', 'pkg:rails', '', 2, 'n'), ('java', 'pkg:com.acme', '', 2, 'k'), ('java', 'pkg:org.n', '', 3, 'n'), ('kt', 'pkg:io.k', '', 2, 'n'))
SELECT 'app/mod/f' || k || '.' || ext AS file, a || CASE i.key WHEN 'k' THEN k::VARCHAR WHEN 'n' THEN n::VARCHAR ELSE '' END || b AS target, CAST(line AS BIGINT) AS line FROM s, i""")
def polyglot_imports(spark, root):
    return code.imports(code.scan(polyglot_tree(spark, root))).select("file", "target", "line")


@query("python_symbols", """SELECT 'symbol:app/f' || s_suppkey || '#' || n AS id, k AS symbol_kind, CAST(l AS BIGINT) AS line FROM supplier, (VALUES ('total', 'function', 1), ('Store', 'class', 5), ('Store.put', 'method', 6), ('Store.get', 'method', 9), ('after', 'function', 12)) v(n, k, l)""")
def python_symbols(spark, root):
    k = F.col("s_suppkey").cast("string")
    text = F.format_string("def total(xs):\n    return sum(xs) + %s\n\n\nclass Store:\n    def put(self, x):\n        return total(x)\n\n    async def get(self):\n\treturn self.put(1)\n\ndef after():\n    total([])\n", k)
    f = T.table(spark, root, "supplier").select(F.format_string("app/f%s.py", k).alias("path"), text.alias("content"))
    return code.symbols(code.scan(f)).select("id", "symbol_kind", "line")


@query("manifest_packages", """WITH n AS (SELECT n_nationkey AS k FROM nation), v(name, suffix, dev, is_dev) AS (VALUES ('left', 'k', false, false), ('both', '', false, true), ('dev', 'k', true, true), ('peer', '', false, false), ('numpy', '', false, false), ('my-lib', '', false, false), ('flask', 'k', false, false),
  ('requests', '', false, false), ('github.com/a/b', '', false, false), ('golang.org/x/n', 'k', false, false), ('serde', '', false, false), ('tok', 'k', false, false))
SELECT 'r' || k AS root, 'pkg:' || name || CASE suffix WHEN 'k' THEN k::VARCHAR ELSE '' END AS id, dev, is_dev FROM n, v""")
def manifest_packages(spark, root):
    k = F.col("n_nationkey").cast("string")
    text = {
        "package.json": '{"dependencies": {"left%s": "1", "both": "2"}, "devDependencies": {"both": "2", "dev%s": "3"}, "peerDependencies": {"peer": "4", "both": "1"}}',
        "pyproject.toml": '[project]\nname = "x%s"\n[project.dependencies]\n"numpy>=1"\n  \'my-lib\'\nbare\n[tool.z%s]\n"no"\n',
        "requirements.txt": "# c%s\n-r other.txt\nflask%s>=2 ; x\nrequests[a]==1\n\n",
        "go.mod": "module m%s\nrequire github.com/a/b v1.2\nrequire (\n\tgolang.org/x/n%s v0.1 // i\n)\nexclude no v1.1\n",
        "Cargo.toml": '[package]\nname = "n%s"\n[dependencies]\nserde = "1"\ntok%s = { v = 1 }\n[dev-dependencies]\nno = "1"\n',
    }
    out = None
    for name, t in text.items():
        df = T.table(spark, root, "nation").select(F.format_string(f"r%s/{name}", k).alias("path"), F.format_string(t, k, k).alias("content"))
        out = df if out is None else out.unionByName(df)
    return manifests.packages(out, by_root=True).select("root", "id", "dev", "is_dev")


@query("file_policy", """WITH d AS (SELECT source, doc_id, lang, n_chars FROM documents), x AS (SELECT doc_id, CASE lang WHEN 'de' THEN CASE WHEN n_chars > 500 THEN 'node_modules/' ELSE 'lib/' END || source || '/a' || doc_id || '.js' WHEN 'fr' THEN CASE WHEN n_chars > 500 THEN 'logs/keep/x' ELSE 'logs/x' END || doc_id || '.log'
  WHEN 'es' THEN CASE WHEN n_chars > 500 THEN 'cfg/.env.' ELSE 'gen/' END || doc_id ELSE source || '/m' || doc_id || '.ts' END AS path, lang, n_chars, source FROM d)
SELECT path, CASE lang WHEN 'de' THEN n_chars <= 500 WHEN 'fr' THEN n_chars > 500 WHEN 'es' THEN false ELSE source <> 'src3' END AS included,
  CASE lang WHEN 'de' THEN CASE WHEN n_chars > 500 THEN 'safety' ELSE 'explicit-include' END WHEN 'fr' THEN 'gitignore' WHEN 'es' THEN CASE WHEN n_chars > 500 THEN 'safety' ELSE 'explicit-exclude' END ELSE CASE WHEN source = 'src3' THEN 'ownignore' ELSE 'default' END END AS source FROM x""")
def file_policy(spark, root):
    d = T.table(spark, root, "documents")
    k, big = F.col("doc_id").cast("string"), F.col("n_chars") > 500
    path = (F.when(F.col("lang") == "de", F.concat(F.when(big, "node_modules/").otherwise("lib/"), "source", F.lit("/a"), k, F.lit(".js")))
            .when(F.col("lang") == "fr", F.concat(F.when(big, "logs/keep/x").otherwise("logs/x"), k, F.lit(".log")))
            .when(F.col("lang") == "es", F.concat(F.when(big, "cfg/.env.").otherwise("gen/"), k)).otherwise(F.concat("source", F.lit("/m"), k, F.lit(".ts"))))
    rules = policy.FilePolicy(include=["lib/**"], exclude=["gen/", "lib/src1/**"], own_ignore=policy.ignore_rules("# own\n/src3/\n"), git_ignore=policy.ignore_rules("*.log\n!logs/keep/*.log\n"))
    return policy.explain(d.select(path.alias("path")), rules).select("path", "included", "source")


@query("commit_log_parse", """SELECT 'c' || o_orderkey AS sha, 'u' || o_custkey || '@x.io' AS author, CASE WHEN o_orderstatus = 'P' THEN '1970-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, 'fix ' || lower(o_orderpriority) AS subject, CAST(1 + CAST(o_orderstatus = 'F' AS INT) AS BIGINT) AS n_files FROM orders""")
def commit_log_parse(spark, root):
    k = F.col("o_orderkey").cast("string")
    date = F.when(F.col("o_orderstatus") == "P", "not a date").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
    text = F.concat(F.lit("COMMIT:c"), k, F.lit("|u"), F.col("o_custkey").cast("string"), F.lit("@x.io|"), date, F.lit("|fix "), F.lower("o_orderpriority"), F.lit("|cut\n\nsrc/a"), k, F.lit(".ts\n"),
                    F.when(F.col("o_orderstatus") == "F", "  lib/b.ts \n").otherwise("\n"))
    c = logs.parse_commits(T.table(spark, root, "orders").select(text.alias("record")))
    return c.select("sha", "author", F.date_format("ts", "yyyy-MM-dd").alias("day"), "subject", F.size("files").cast("bigint").alias("n_files"))


@query("changed_paths", """SELECT DISTINCT path FROM (SELECT CASE o_orderstatus WHEN 'O' THEN 'src/a' || o_custkey || '.ts' WHEN 'F' THEN 'src/new' || o_custkey || '.py' ELSE NULL END AS path FROM orders) WHERE path IS NOT NULL""")
def changed_paths(spark, root):
    k = F.col("o_custkey").cast("string")
    line = (F.when(F.col("o_orderstatus") == "O", F.concat(F.lit(' M "src/a'), k, F.lit('.ts"'))).when(F.col("o_orderstatus") == "F", F.concat(F.lit("R  src/old"), k, F.lit(".py -> src/new"), k, F.lit(".py")))
            .otherwise(F.concat(F.lit("?? .state/x"), k, F.lit(".ts"))))
    return logs.changed_paths(T.table(spark, root, "orders").select(line.alias("line")), own_folder=".state")


TICKETS = """t AS (SELECT 'T' || o_orderkey AS ticket, unnest(CASE o_orderstatus WHEN 'O' THEN ['module:part/' || o_custkey, 'symbol:x#f' || o_custkey] WHEN 'F' THEN ['module:part/' || o_orderkey, 'proposed:new#y', 'pkg:z'] ELSE [] END) AS node_id FROM orders)"""


def tickets(spark, root):
    o, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = (F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("# T\n- Owner: me\n- Target Graph Nodes: [module:part/"), c, F.lit(", symbol:x#f"), c, F.lit("]\n- Note: module\n")))
            .when(F.col("o_orderstatus") == "F", F.concat(F.lit("# T\n- target nodes:\n  - module:part/"), o, F.lit("\n  * proposed:new#y\n  - pkg:z\n- Estimate: 3\n  - module:not/this\n")))
            .otherwise("# T\n- Nothing: here\n"))
    return T.table(spark, root, "orders").select(F.concat(F.lit("T"), o).alias("ticket"), text.alias("content"))


@query("ticket_targets", f"WITH {TICKETS} SELECT DISTINCT ticket, node_id FROM t")
def ticket_targets(spark, root):
    return logs.ticket_targets(tickets(spark, root))


@query("ticket_gaps", f"WITH {TICKETS} SELECT DISTINCT ticket, node_id FROM t WHERE node_id NOT LIKE 'proposed:%' AND node_id <> 'pkg:z' AND node_id NOT IN (SELECT 'module:part/' || p_partkey FROM part)")
def ticket_gaps(spark, root):
    nodes = T.table(spark, root, "part").select(F.concat(F.lit("module:part/"), F.col("p_partkey").cast("string")).alias("id"))
    known = nodes.unionByName(spark.createDataFrame([("pkg:z",)], "id string"))
    return CL.ticket_gaps(logs.ticket_targets(tickets(spark, root)), known).select("ticket", "node_id")


@query("open_questions", """SELECT 'doc' || o_orderkey AS doc, id, CASE id WHEN '1' THEN 'Is it ' || o_custkey || '?' WHEN '7' THEN 'It must go' WHEN '3' THEN 'Box ' || o_custkey ELSE 'Old?' END AS question, CASE WHEN id IN ('3', '2') THEN 'resolved' ELSE 'open' END AS status,
  CASE WHEN id IN ('1', '7') THEN 'blocking' ELSE 'normal' END AS priority FROM orders, (VALUES ('1'), ('7'), ('3'), ('2')) v(id) WHERE id <> '3' OR o_orderstatus = 'F'""")
def open_questions(spark, root):
    o, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    box = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("- [x] Box "), c, F.lit("\n"))).otherwise("\n")
    text = F.concat(F.lit("# Open\n| 5 | before the table | me | open | p0 |\n| # | Question | Owner | Status | Priority |\n|---|---|---|---|---|\n| 1 | Is it "), c, F.lit("? | me | open | P0 |\n| 7 | It must go | you | In-Review | normal |\n| Q8 | no digits | you | open | p0 |\n"), box,
                    F.lit("## Resolved Questions\n| 4 | outside | you | done | p0 |\n| # | Question | Owner | Status |\n|---|---|---|---|\n| 2 | Old? | yes | Closed today |\n"))
    return logs.open_questions(T.table(spark, root, "orders").select(F.concat(F.lit("doc"), o).alias("doc"), text.alias("content"))).select("doc", "id", "question", "status", "priority")


@query("workspace_hash", """WITH x AS (SELECT lang AS ext, sha256(source || '/' || doc_id || ':' || sha256(text)) AS h FROM documents)
SELECT ext, sha256(count(*) || ':' || CAST(sum(CAST(('0x' || substr(h, 1, 15)) AS BIGINT)) AS VARCHAR) || ':' || CAST(sum(CAST(('0x' || substr(h, 16, 15)) AS BIGINT)) AS VARCHAR) || ':' || CAST(sum(CAST(('0x' || substr(h, 31, 15)) AS BIGINT)) AS VARCHAR) || ':' || CAST(sum(CAST(('0x' || substr(h, 46, 15)) AS BIGINT)) AS VARCHAR)) AS digest, count(*) AS files FROM x GROUP BY ext""")
def workspace_hash(spark, root):
    return logs.workspace_hash(T.files(spark, root).select("path", F.sha2("content", 256).alias("sha256"), "ext"), by=["ext"])


@query("source_snapshot", "SELECT source || '/' || doc_id AS path, sha256(text) AS sha256 FROM documents")
def source_snapshot(spark, root):
    f = T.table(spark, root, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), F.col("n_chars").alias("size"))
    return logs.source_snapshot(f)


@query("churn_attach", f"""WITH t AS (SELECT p_brand || '/' || p_partkey || CASE WHEN p_size > 25 THEN '.py' ELSE '.ts' END AS file, count(*) AS churn FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT 'module:' || p_brand || '/' || p_partkey AS id, churn FROM part LEFT JOIN t ON file = p_brand || '/' || p_partkey || CASE WHEN p_size > 25 THEN '.py' ELSE '.ts' END""")
def churn_attach(spark, root):
    part = T.table(spark, root, "part").select("p_partkey", F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("rel"), F.when(F.col("p_size") > 25, ".py").otherwise(".ts").alias("ext"))
    churn = T.touch_keys(spark, root).groupBy("partkey").agg(F.count("*").alias("churn")).join(part, F.col("partkey") == F.col("p_partkey")).select(F.concat("rel", "ext").alias("file"), "churn")
    modules = part.select(F.concat(F.lit("module:"), "rel").alias("id"), F.col("rel").alias("path"))
    return B.attach_churn(modules, churn).select("id", "churn")
