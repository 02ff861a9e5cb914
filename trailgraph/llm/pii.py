"""Personal data by information-theoretic sanitisation, in DataFrame expressions only.

Base: four patterns per text. Every match is a mention of a protected entity
(its normalised value). Method: a word t of a text that mentions entity e
discloses it as far as PMI(e; t), counted over the whole corpus, reaches the
information content IC(e). With PMI / IC >= ``remove_at`` the word is removed
from the texts that mention e, with >= ``generalise_at`` it is generalised.
Counts are of different texts: copies of one text are no evidence. PMI is
smoothed: P(e | t) starts at P(e) with the weight of ``smoothing`` texts, so
entities and words of a single text are judged too, with less certainty.

Null text counts as empty. Repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailgraph.llm import text as T
from trailgraph.runtime import cut_lineage

KINDS = ["email", "ip", "card", "phone"]
# The contract's patterns, made linear: a match can only begin where a run begins
# or where the match before it ended; cards already ask for their 16 to 19 digits.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    n = F.length(digits)
    bare = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    parts = F.forall(bare, lambda p: (F.length(p) <= 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))
    return F.when(kind == "ip", parts).when(kind == "card", n.between(16, 19) & _luhn(digits)).when(kind == "phone", n.between(8, 15)).otherwise(F.lit(True))


def _located(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by..., i, before, match) get start and end: ``before`` is the length of text between the match before and this one."""
    w = W.partitionBy(*by).orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.length("match")).over(w)
    return rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("match"))


def _matches(text: Column, pattern: str) -> tuple[Column, Column]:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.transform(F.split(text, pattern, -1), lambda x: F.length(x))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, kind, start, end, match (code points, end exclusive) of every base span."""
    src = docs.select(T.row_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    may = {"email": F.col("t").contains("@"), "phone": F.col("t").contains("+"), "ip": F.col("t").rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), "card": F.col("t").rlike(r"[0-9](?:[\x20-]?[0-9]){15}")}
    any_of = may["email"] | may["phone"] | may["ip"] | may["card"]
    found = src.filter(any_of)
    none = F.array().cast("array<string>")
    for k in KINDS:
        found = found.withColumn(f"m_{k}", F.when(may[k], _matches(F.col("t"), PATTERNS[k])[0]).otherwise(none))
    per_kind = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"m_{k}").alias("m"), F.when(F.size(f"m_{k}") > 0, _matches(F.col("t"), PATTERNS[k])[1]).alias("b")) for k in KINDS])
    each = found.select("key", F.explode(F.filter(per_kind, lambda x: F.size(x["m"]) > 0)).alias("x"))
    rows = each.select("key", "x.kind", F.posexplode(F.arrays_zip(F.col("x.m").alias("m"), F.slice("x.b", 1, F.size("x.m")).alias("b"))).alias("i", "y")).select("key", "kind", "i", F.col("y.b").alias("before"), F.col("y.m").alias("match")).dropDuplicates(["key", "kind", "i"])
    return _located(rows, ["key", "kind"]).filter(_valid(F.col("kind"), F.col("match"))).select("key", "kind", "start", "end", "match")


def _terms(texts: DataFrame) -> DataFrame:
    """th, start, end, term: the words of the different ``texts`` (th, t)."""
    m, b = _matches(F.col("t"), TERM)
    rows = texts.withColumn("m", m).withColumn("b", b).select("th", F.posexplode(F.arrays_zip("m", F.slice("b", 1, F.size("m")).alias("b"))).alias("i", "y")).select("th", "i", F.col("y.b").alias("before"), F.col("y.m").alias("match"))
    return _located(rows, ["th"]).select("th", "start", "end", F.lower("match").alias("term"))


def _outside(terms: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``terms`` that overlap none of ``marks`` (th, start, end)."""
    both = terms.withColumn("m_start", F.lit(None).cast("long")).withColumn("m_end", F.lit(None).cast("long")).unionByName(marks.select("th", "start", "end", F.lit(None).cast("string").alias("term"), F.col("start").alias("m_start"), F.col("end").alias("m_end")))
    # Running frames both ways: a frame that reaches to the end would be summed anew for every row.
    before = W.partitionBy("th").orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy("th").orderBy(F.desc("start"), F.desc("end")).rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("reach", F.max("m_end").over(before)).withColumn("next", F.min("m_start").over(after)).filter("term is not null")
    inside = F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    return seen.filter(~inside).select(*terms.columns)


def disclosing_terms(docs: DataFrame, mentions: DataFrame, id_col: str = "doc_id", text_col: str = "text", smoothing: float = 1.0, generalise_at: float = 0.7, remove_at: float = 0.9) -> DataFrame:
    """key, start, end, action ('generalise' or 'remove') of words that reveal an entity of their text.

    ``mentions``: key, kind, start, end, match.
    """
    value = F.when(F.col("kind").isin("card", "phone"), _digits(F.col("match"))).otherwise(F.lower("match"))
    t = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(T.row_key(id_col, text_col).alias("key"), F.xxhash64(t).alias("th"), t.alias("t"))
    held = cut_lineage(src.join(mentions.select("key").distinct(), "key", "left_semi"))
    keys = held.select("key", "th").distinct()
    named = cut_lineage(mentions.withColumn("entity", F.xxhash64("kind", value)).join(keys, "key").select("th", "entity", "start", "end").distinct())
    words = cut_lineage(_outside(_terms(held.select("th", "t").dropDuplicates(["th"])), named.select("th", "start", "end").distinct()))
    n = float(src.select("th").distinct().count())
    # Entities of the same texts get the same scores: they count as one, told by the digest of those texts.
    ents = named.select("entity", "th").distinct()
    sets = ents.groupBy("entity").agg(F.count("*").alias("n_e"), F.bit_xor("th").alias("set"))
    p = F.col("n_e") / F.lit(n)
    # n_et is at most n_e, so a word in more texts than this stays below generalise_at whatever n_et is.
    most = (F.col("n_e") + smoothing * p) / F.pow(p, F.lit(1 - generalise_at)) - smoothing + 1e-6
    sets = cut_lineage(ents.join(sets.filter(F.col("n_e") < n).withColumn("most", most), "entity").select("th", "set", "n_e", "most").distinct())
    n_t = src.select("th", "t").dropDuplicates(["th"]).select(F.explode(F.array_distinct(F.split(F.lower("t"), GAP))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    top = sets.agg(F.max("most")).first()[0] or 0.0
    rare = words.select("th", "term").distinct().join(n_t.filter(F.col("n_t") <= top), "term")
    pairs = cut_lineage(rare.join(sets, "th").filter(F.col("n_t") <= F.col("most")).select("th", "term", "set", "n_e", "n_t"))
    given = (F.col("n_et") + smoothing * p) / (F.col("n_t") + smoothing)
    scored = pairs.groupBy("set", "n_e", "term", "n_t").agg(F.count("*").alias("n_et")).withColumn("ratio", F.log(given / p) / -F.log(p))
    telling = scored.filter(F.col("ratio") >= generalise_at).select("set", "n_e", "term", "ratio")
    hit = pairs.join(telling, ["set", "n_e", "term"]).groupBy("th", "term").agg(F.max("ratio").alias("ratio"))
    action = F.when(F.col("ratio") >= remove_at, "remove").otherwise("generalise")
    per_text = words.join(hit, ["th", "term"]).groupBy("th").agg(F.collect_list(F.struct("start", "end", action.alias("action"))).alias("x"))
    return keys.join(per_text, "th").select("key", F.explode("x").alias("x")).select("key", "x.*")


def _join(spans: Column, kinds: list[str]) -> Column:
    ranked = F.transform(spans, lambda s: F.struct(F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(ranked), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """Per row: key, doc_id, spans (array of kind, start, end, action) and the contract's columns."""
    mentions = cut_lineage(base_spans(docs, id_col, text_col))
    terms = disclosing_terms(docs, mentions, id_col, text_col, **thresholds)
    every = mentions.select("key", "kind", "start", "end", F.lit("mask").alias("action")).unionByName(terms.select("key", F.lit("term").alias("kind"), "start", "end", "action"))
    per_doc = every.groupBy("key").agg(F.collect_set(F.struct("kind", "start", "end", "action")).alias("spans"))
    rows = docs.select(T.row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id")).join(per_doc, "key", "left")
    rows = rows.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<kind:string,start:bigint,end:bigint,action:string>>")))
    base = F.filter("spans", lambda s: s["kind"] != "term")
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("key", "doc_id", *counts, F.sha2(_join(base, KINDS).cast("binary"), 256).alias("base_sha256"), _join(F.col("spans"), [*KINDS, "term"]).alias("spans_text"), "spans")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """``docs`` with base spans as [KIND], generalised words as [TERM] and removed words left out."""
    found = scan(docs, id_col, text_col, **thresholds).filter(F.size("spans") > 0).select(F.col("key").alias("_pii_key"), F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"], s["action"]))).alias("_s")).dropDuplicates(["_pii_key"])
    t = F.col(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    label = lambda s: F.when(s["action"] == "remove", "").when(s["action"] == "generalise", "[TERM]").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))).otherwise(F.struct(F.concat(a["out"], F.substring(t, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), label(s)).alias("out"), s["end"].alias("at")))
    new = F.aggregate("_s", start, step, lambda a: F.concat(a["out"], F.substring(t, (a["at"] + 1).cast("int"), F.length(t))))
    joined = docs.withColumn("_pii_key", T.row_key(id_col, text_col)).join(found, "_pii_key", "left")
    return joined.withColumn(text_col, F.when(F.col("_s").isNull(), t).otherwise(new)).select(*docs.columns)
