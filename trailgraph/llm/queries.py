"""One registered query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return wrap


@query("op1_bpe")
def op1(spark, sf_dir):
    import public_tokenizers

    from trailgraph.llm import bpe

    return bpe.encode(table(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


_NORM7 = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"


@query("op7_exact_dedup", sql=f"""
WITH n AS (SELECT doc_id, {_NORM7} AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
""")
def op7(spark, sf_dir):
    from trailgraph.llm import exact

    return exact.groups(table(spark, sf_dir)).drop("key")


_WORDS2 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op2_decontaminate", sql=f"""
WITH d AS (SELECT doc_id, {_WORDS2} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS2} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM wins),
places AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
hits AS (SELECT p.doc_id, p.i, p.m, x.item FROM places p JOIN wins x ON p.win = x.win AND p.m = x.m),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, m)) AS j FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
""")
def op2(spark, sf_dir):
    from trailgraph.llm import decontaminate

    return decontaminate.scan(table(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("key", "starts")


@query("op3_pii")
def op3(spark, sf_dir):
    from trailgraph.llm import pii

    return pii.scan(table(spark, sf_dir)).drop("key", "spans").withColumnRenamed("spans_text", "spans")


@query("op10_licenses")
def op10(spark, sf_dir):
    from trailgraph.llm import licenses

    return licenses.scan(table(spark, sf_dir)).drop("key", "matches")


@query("op9_secrets")
def op9(spark, sf_dir):
    from trailgraph.llm import secrets

    return secrets.scan(table(spark, sf_dir))


@query("op5_quality")
def op5(spark, sf_dir):
    from trailgraph.llm import quality

    docs = table(spark, sf_dir)
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query("op6_toxicity")
def op6(spark, sf_dir):
    from trailgraph.llm import toxicity

    docs = table(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op4_jaccard", sql=r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, c) USING KEY (id) AS (SELECT doc_id, doc_id FROM documents
  UNION SELECT t.a, min(r.c) FROM r JOIN both_ways t ON t.b = r.id JOIN recurring.r AS o ON o.id = t.a GROUP BY t.a, o.c HAVING min(r.c) < o.c)
SELECT r.id AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id
""")
def op4(spark, sf_dir):
    from trailgraph.llm import jaccard

    return jaccard.join(table(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query("op8_passages", sql=r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT win FROM p GROUP BY win HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT doc_id, i, unnest(range(0, 35)) AS j FROM p SEMI JOIN r USING (win))),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d) ANTI JOIN c USING (doc_id, pos) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN g USING (doc_id)
""")
def op8(spark, sf_dir):
    from trailgraph.llm import passages

    return passages.remove(table(spark, sf_dir))


@query("op11_hmm")
def op11(spark, sf_dir):
    from trailgraph.llm import hmm

    return hmm.score(table(spark, sf_dir))


@query("op12_collocations", sql=r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM t),
g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
f AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, count(*) AS a FROM g, range(1, 5) x(m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND a >= 30),
cuts AS (SELECT c.lang, c.phrase, c.m, c.a, k, lf.a AS l, rf.a AS r, ((2000000::HUGEINT * c.a) // (lf.a::HUGEINT + rf.a))::BIGINT AS score FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
  JOIN f lf ON lf.lang = c.lang AND lf.phrase = array_to_string(c.w[1:k], ' ') JOIN f rf ON rf.lang = c.lang AND rf.phrase = array_to_string(c.w[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT DISTINCT s.lang, s.phrase FROM (SELECT lang, a, array_to_string(w[i:i + z - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m)) AS i FROM c), range(2, 4) y(z) WHERE z < m AND i + z - 1 <= m) s
  JOIN c ON c.lang = s.lang AND c.phrase = s.phrase WHERE 100::HUGEINT * s.a >= 80::HUGEINT * c.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best ANTI JOIN held USING (lang, phrase) JOIN n USING (lang)
QUALIFY rank <= 2000
""")
def op12(spark, sf_dir):
    from trailgraph.llm import collocations

    return collocations.collocations(table(spark, sf_dir))


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({s}, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)), 4294967295)"""


@query("op13_repair", sql=f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format(s="concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")} % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) FROM c WHERE k <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, rtrim(text, E' \\t\\n\\x0b\\x0c\\r') AS solid FROM d),
f AS (SELECT conv_id, turn, role, text, i, solid = '' AS blank, solid <> '' AND i > min(i) OVER (PARTITION BY conv_id, role, text) AS seen, NOT regexp_matches(solid, '[.!?]$') AS cut,
  left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two FROM r),
step(p, q, c, role) AS (VALUES (0, 1, 's', NULL), (0, 2, 'u', 'user'), (1, 2, 'u', 'user'), (2, 3, 'a', 'assistant'), (3, 2, 'u', 'user')),
edit(p, q, e, c, role, cost) AS (SELECT p, q, 'K', c, NULL, 0 FROM step UNION ALL SELECT p, q, 'R', NULL, role, 3 FROM step WHERE role IS NOT NULL UNION ALL SELECT p, p, 'D', NULL, NULL, 4 FROM range(4) t(p)),
ins(p, q, cost, audit, lines) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 3, 'I', E'\\nuser:'), (1, 2, 3, 'I', E'\\nuser:'), (3, 2, 3, 'I', E'\\nuser:'), (2, 3, 3, 'I', E'\\nassistant:'),
  (0, 3, 6, 'II', E'\\nuser:\\nassistant:'), (1, 3, 6, 'II', E'\\nuser:\\nassistant:')),
dp(conv_id, i, q, best, lines) AS (SELECT conv_id, 0::BIGINT, q, lpad(ins.cost::VARCHAR, 12, '0') || audit, ins.lines FROM (SELECT DISTINCT conv_id FROM f) JOIN ins ON p = 0
  UNION ALL SELECT conv_id, i, q, min(k), arg_min(o, k) FROM (SELECT f.conv_id, f.i, ins.q,
      lpad((left(dp.best, 12)::BIGINT + edit.cost + CASE WHEN e <> 'D' AND f.cut THEN 3 ELSE 0 END + ins.cost)::VARCHAR, 12, '0') || substr(dp.best, 13) || e || ins.audit AS k,
      dp.lines || CASE e WHEN 'D' THEN '' ELSE chr(10) || coalesce(edit.role, f.role) || ':' || f.text END || ins.lines AS o
    FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN edit ON edit.p = dp.q AND (e = 'D' OR NOT (blank OR seen) AND (edit.c IS NULL OR edit.c = f.c)) JOIN ins ON ins.p = edit.q) GROUP BY ALL),
best AS (SELECT conv_id, min(best) AS b, arg_min(lines, best) AS lines FROM (SELECT *, max(i) OVER (PARTITION BY conv_id) AS n FROM dp) WHERE i = n AND q IN (0, 3) GROUP BY conv_id),
stat AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(seen) AS duplicate, count_if(cut AND NOT blank AND NOT seen) AS truncated, count_if(two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(left(b, 12)::BIGINT, 0) AS cost, coalesce(substr(b, 13), '') AS audit, sha256(coalesce(substr(lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stat ON stat.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
""")
def op13(spark, sf_dir):
    from trailgraph.llm import dialogues

    rows = table(spark, sf_dir, "conversations")
    return dialogues.report(rows, dialogues.damage(rows))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
