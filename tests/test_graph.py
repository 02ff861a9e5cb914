import random
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from trailgraph.operators import build as B
from trailgraph.operators import graph as G
from trailgraph.operators.trust import relation_name
from trailgraph.runtime import dealt, tasks_for


def edges(spark, pairs, relation="imports"):
    return spark.createDataFrame([(a, b, relation, "verified", i) for i, (a, b) in enumerate(pairs)], "src string, dst string, relation string, confidence string, ord long")


def nodes(spark, ids, kind="module"):
    return spark.createDataFrame([(f"{kind}:{i}", kind, i, f"{i}.ts", None, n) for n, i in enumerate(ids)], "id string, kind string, label string, path string, churn long, ord long")


def test_reach_handles_cycles_and_keeps_first_depth(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("d", "a")])
    seeds = spark.createDataFrame([("a", 0)], "node string, ord long")
    got = {r["node"]: r["depth"] for r in G.reach(e, seeds).collect()}
    assert got == {"a": 0, "c": 1, "d": 1, "b": 2}
    assert {r["node"] for r in G.reach(e, seeds, max_depth=1).collect()} == {"a", "c", "d"}


def test_arrival_is_breadth_first_order(spark):
    rng = random.Random(3)
    pairs = sorted({(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(70)}, key=lambda _: rng.random())
    e = edges(spark, pairs)
    seeds = spark.createDataFrame([("n1", 0), ("n2", 1)], "node string, ord long")
    got = G.reach(e, seeds, arrival=True).filter("depth > 0").orderBy("depth", "arrival").select("node", F.element_at("arrival", -1)).collect()
    rev = defaultdict(list)
    for i, (a, b) in enumerate(pairs):
        rev[b].append((a, i))
    seen, queue, want = {"n1", "n2"}, ["n1", "n2"], []
    while queue:
        at = queue.pop(0)
        for a, i in rev[at]:
            if a not in seen:
                seen.add(a)
                queue.append(a)
                want.append((a, i))
    assert [tuple(r) for r in got] == want


def test_impact_details_and_seeds(spark):
    n = spark.createDataFrame(
        [("module:src/a", "module", "a", "src/a.ts", 9, 0), ("symbol:src/a#f", "symbol", "f", "src/a", None, 1), ("module:src/b", "module", "b", "src/b.ts", 12, 2),
         ("module:test/b", "module", "b", "test/b.ts", None, 3)], "id string, kind string, label string, path string, churn long, ord long")
    e = edges(spark, [("module:src/b", "symbol:src/a#f"), ("module:test/b", "module:src/b"), ("module:src/a", "module:src/b")])
    seeds = G.change_seeds(n, spark.createDataFrame([("src/a.ts", 0), ("src/none.go", 1)], "path string, ord long"))
    assert rows(seeds, "node", "known") == [("module:src/a", True), ("module:src/none", False), ("symbol:src/a#f", True)]
    d = {r["id"]: r for r in G.impact(n, e, seeds).collect()}
    assert d["module:src/b"]["hop"] == "direct" and d["module:src/b"]["high_churn"] and d["module:src/b"]["link_ord"] == 0
    assert d["module:test/b"]["hop"] == "indirect" and d["module:test/b"]["is_test"]
    assert "module:src/a" not in d


def test_test_impact_reasons(spark):
    n = spark.createDataFrame([("a", "f", "a", "a.ts", None, 0), ("b", "f", "b", "b.ts", None, 1), ("at", "f", "t", "a.test.ts", None, 2), ("bt", "f", "t", "b.test.ts", None, 3)], "id string, kind string, label string, path string, churn long, ord long")
    e = edges(spark, [("at", "a"), ("bt", "b"), ("b", "a")])
    hit = G.test_impact(n, e, spark.createDataFrame([("a.ts",), ("b.ts",), ("zz.ts",)], "path string"))
    assert rows(hit, "test", "origin") == [("a.test.ts", "a.ts"), ("b.test.ts", "a.ts"), ("b.test.ts", "b.ts")]


def test_callers_rank_and_exclude_targets(spark):
    e = spark.createDataFrame([("x", "t", "inferred", 0), ("y", "t", "verified", 1), ("t", "t", "verified", 2), ("z", "x", "verified", 3)], "src string, dst string, confidence string, ord long")
    targets = spark.createDataFrame([("t", 0)], "node string, ord long")
    assert [r["id"] for r in G.rank_callers(G.callers(e, targets)).collect()] == ["y", "x"]
    assert [r["id"] for r in G.rank_callers(G.callers(e, targets, transitive=True)).collect()] == ["y", "z", "x"]


def naive_arrival(pairs, seeds):
    """(node, depth, through, edge) in breadth-first order over edges in their given order, against their direction."""
    into = defaultdict(list)
    for i, (a, b) in enumerate(pairs):
        into[b].append((a, i))
    seen, queue, out = set(seeds), [(s, 0) for s in seeds], []
    while queue:
        node, depth = queue.pop(0)
        for a, i in into[node]:
            if a not in seen:
                seen.add(a)
                out.append((a, depth + 1, node, i))
                queue.append((a, depth + 1))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_surfacing_edges_match_a_plain_search(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(70)]
    seeds = ["n3", "n1", "n7"]
    e = spark.createDataFrame([(a, b, f"src/f{i // 10:03}.ts:{i % 10 + 1}") for i, (a, b) in enumerate(pairs)], "src string, dst string, evidence string").repartition(5)
    found = G.surfacing(e.withColumn("ord", G.read_place("evidence")), spark.createDataFrame([(n, i) for i, n in enumerate(seeds)], "node string, ord long"))
    got = [(r["node"], r["depth"], r["parent"], r["evidence"]) for r in found.filter("depth > 0").orderBy("depth", "place").collect()]
    assert got == [(n, d, p, f"src/f{i // 10:03}.ts:{i % 10 + 1}") for n, d, p, i in naive_arrival(pairs, seeds)]
    near = G.surfacing(e.withColumn("ord", G.read_place("evidence")), spark.createDataFrame([("n3", 0)], "node string, ord long"), max_depth=1)
    assert near.filter("depth > 1").isEmpty()


def naive_paths(pairs, s, t, depth, cap):
    if s == t:
        return [[s]]
    out = defaultdict(list)
    for i, (a, b) in enumerate(pairs):
        out[a].append((b, i))
    found, queue = [], [([s], [])]
    while queue:
        path, ords = queue.pop(0)
        for b, i in out[path[-1]]:
            if b in path:
                continue
            if b == t:
                found.append(path + [b])
            elif len(path) < depth:
                queue.append((path + [b], ords + [i]))
    return found[:cap]


@pytest.mark.parametrize("seed", [1, 2])
def test_simple_paths_match_a_plain_search(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(8)}", f"n{rng.randrange(8)}") for _ in range(24)]
    wanted = [("n0", "n5"), ("n3", "n1"), ("n2", "n2"), ("n0", "lost")]
    got = defaultdict(list)
    df = G.simple_paths(edges(spark, pairs), spark.createDataFrame(wanted, "s string, t string"), max_depth=4, cap=10)
    for r in df.orderBy("s", "t", "hops", "ords").collect():
        got[r["s"], r["t"]].append(r["path"])
    for s, t in wanted:
        assert got[s, t] == naive_paths(pairs, s, t, 4, 10), (s, t)


def test_resolve_ids_prefers_id_then_label_then_path(spark):
    n = spark.createDataFrame([("a", "m", "b", "src/x/a.ts", 0), ("b", "m", "q", "lib/q.ts", 1), ("c", "m", "z", "src/z.ts", 2)], "id string, kind string, label string, path string, ord long")
    got = {r["name"]: r["id"] for r in G.resolve_ids(n, spark.createDataFrame([("b",), ("z",), ("x/a.ts",), ("none",)], "name string")).collect()}
    assert got == {"b": "b", "z": "c", "x/a.ts": "a"}


def test_neighbourhood_skips_untrusted_edges(spark):
    n = nodes(spark, "abcd")
    e = spark.createDataFrame([("module:a", "module:b", "imports", None), ("module:b", "module:c", "imports", None), ("module:d", "module:a", "imports", "contested")], "src string, dst string, relation string, trust_state string")
    got_n, got_e = G.neighbourhood(n, e, spark.createDataFrame([("module:a",)], "id string"))
    assert rows(got_n, "id") == [("module:a",), ("module:b",)] and got_e.count() == 1


def test_coverage_gap(spark):
    n = spark.createDataFrame([("t", "test/a.ts"), ("m", "src/m.ts")], "id string, path string")
    e = edges(spark, [("t", "foo"), ("m", "bar")])
    assert rows(G.coverage_gaps(n, e, spark.createDataFrame([("foo",), ("bar",)], "id string"))) == [("bar",)]


def test_bad_pattern_filters_nothing(spark):
    assert G.filter_graph(nodes(spark, "abc"), "[", ["id"]).count() == 3


def test_merge_keeps_inbound_edges_and_unchanged_targets(spark):
    n = nodes(spark, ["a", "b", "c"])
    e = edges(spark, [("module:a", "module:b"), ("module:b", "module:c")])
    new_n = nodes(spark, ["b"])
    got_n, got_e = B.merge_update(n, e, new_n, edges(spark, []), spark.createDataFrame([("b.ts",)], "path string"))
    assert rows(got_n, "id") == [("module:a",), ("module:b",), ("module:c",)]
    assert rows(got_e, "src", "dst") == [("module:a", "module:b")]


def test_call_resolution_prefers_imports_and_needs_uniqueness(spark):
    sym = spark.createDataFrame([("symbol:b#save", "save"), ("symbol:c#save", "save"), ("symbol:c#Box.only", "Box.only")], "id string, label string")
    pend = spark.createDataFrame([("symbol:a#f", "save", "a:1", 1), ("symbol:z#g", "save", "z:1", 1), ("symbol:z#g", "only", "z:2", 2)], "caller string, callee_name string, evidence string, ord long")
    imp = spark.createDataFrame([("module:a", "module:b")], "src string, dst string")
    assert rows(B.resolve_calls(pend, sym, imp), "src", "dst", "confidence") == [("symbol:a#f", "symbol:b#save", "inferred"), ("symbol:z#g", "symbol:c#Box.only", "inferred")]


def test_call_resolution_by_given_modules_is_as_by_ids(spark):
    rng = random.Random(3)
    sym = [(m, rng.choice(["", "Box."]) + rng.choice("uvwxy")) for m in range(8) for _ in range(3)]
    pend = [(m, rng.choice("uvwxyz")) for m in range(4, 12) for _ in range(3)]
    imp = [(rng.randrange(4, 12), rng.randrange(8)) for _ in range(14)]
    symbols = spark.createDataFrame([(f"symbol:{m}#{x}", x, m) for m, x in sym + sym[:5]], "id string, label string, module long")
    pending = spark.createDataFrame([(f"symbol:{m}#f{i}", x, f"{m}:{i}", i, m) for i, (m, x) in enumerate(pend)] + [("symbol:4#f0", pend[0][1], "4:0", 0, 4)], "caller string, callee_name string, evidence string, ord long, module long")
    imports = spark.createDataFrame(imp, "src long, dst long")
    want = []
    for i, (m, x) in enumerate(pend):
        all_ = {f"symbol:{t}#{y}" for t, y in sym if x in (y, y.split(".")[-1])}
        near = {d for d in all_ if int(d[7:].split("#")[0]) in {m, *(t for s, t in imp if s == m)}}
        hit = near if len(near) == 1 else all_
        want += [(f"symbol:{m}#f{i}", *hit)] if len(hit) == 1 else []
    assert len(want) > 3 and any(len({t for t, y in sym if y.split(".")[-1] == x}) > 1 for _, x in pend)
    assert rows(B.resolve_calls(pending, symbols, imports), "src", "dst") == sorted(want, key=repr)
    module = lambda df, *cs: df.select(*[F.concat(F.lit("module:"), F.col(c).cast("string")).alias(c) for c in cs])
    assert rows(B.resolve_calls(pending.drop("module"), symbols.drop("module"), module(imports, "src", "dst")), "src", "dst") == sorted(want, key=repr)


def test_relation_aliases(spark):
    df = spark.createDataFrame([(" Imports From ",), ("depends-on",), ("odd rel",), (None,)], "r string").select(relation_name("r").alias("n"))
    assert [r["n"] for r in df.collect()] == ["imports", "imports", "odd_rel", "related_to"]


def test_symbols_found_by_a_popular_name_are_not_deduplicated_again(spark):
    n = spark.createDataFrame([(i % 6, "Box.open" if i % 2 else "open") for i in range(12)], "id long, label string")
    found = G.find_symbols(n, spark.createDataFrame([("open",), ("OPEN",), ("open",)], "name string"))
    assert rows(found) == sorted([(name, tier, i, "Box.open" if i % 2 else "open") for name, tier in (("open", 1), ("OPEN", 2)) for i in range(6)], key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not plan[: plan.index("Join")].count("Aggregate")


def test_grouping_steps_get_tasks_by_rows(spark):
    few = spark.range(10)
    assert tasks_for(few) == 1 and dealt(few, 1, "id") is few
    assert tasks_for(few, rows=1) == 10 and dealt(few, 10, "id").rdd.getNumPartitions() == 10
    assert tasks_for(few, rows=5) == spark.sparkContext.defaultParallelism
