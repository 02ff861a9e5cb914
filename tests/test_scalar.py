import posixpath

from hypothesis import given, settings
from hypothesis import strategies as st

from trailgraph.functions import scalar as S

STEP = st.sampled_from(["a", "bb", "..", ".", "c.ts"])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(["x", "y", "z"]), max_size=3), st.lists(STEP, min_size=1, max_size=5)), min_size=20, max_size=60))
def test_join_path_follows_posix_rules(spark, cases):
    rows = [("/".join(b), "/".join(r)) for b, r in cases]
    got = spark.createDataFrame(rows, "b string, r string").select(S.join_path("b", "r").alias("p")).collect()
    want = [posixpath.normpath(posixpath.join(b, r)) for b, r in rows]
    assert [g["p"] for g in got] == ["" if w == "." else w for w in want]


def test_rounding_and_hashes(spark):
    r = spark.range(1).select(S.half_up(S.F.lit(-2.5)).alias("a"), S.half_up(S.F.lit(0.125), 2).alias("b"), S.span_hash(S.F.lit("x  \ny\t\n\n")).alias("h"), S.span_hash(S.F.lit("x\ny")).alias("i"),
                              S.token_estimate(S.F.lit("12345")).alias("t"), S.line_span(S.F.lit("a\nb\nc"), S.F.lit(2), S.F.lit(9)).alias("s"), S.line_span(S.F.lit("a"), S.F.lit(2), S.F.lit(2)).alias("n")).first()
    assert (r["a"], r["b"], r["t"], r["s"], r["n"]) == (-2.0, 0.13, 2, "b\nc", None) and r["h"] == r["i"]
