import random
import statistics
from collections import Counter
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from trailgraph.functions.ranking import exact_median, number_rows, top_k
from trailgraph.operators import budget as BU
from trailgraph.operators import history as H

NOW = datetime(2024, 6, 1)


def touches(spark, data):
    return spark.createDataFrame(data, "sha string, author string, ts timestamp, subject string, module string, file string")


def naive_coupling(commits, min_co, strength):
    total, co = Counter(), Counter()
    for files in commits.values():
        total.update(files)
        co.update(combinations(sorted(files), 2))
    return {(a, b): n for (a, b), n in co.items() if n >= min_co and n / max(total[a], total[b]) >= strength}


@pytest.mark.parametrize("seed,min_co,strength", [(1, 3, 0.3), (2, 2, 0.1), (3, 4, 0.5)])
def test_coupling_is_exact_with_huge_commits(spark, seed, min_co, strength):
    rng = random.Random(seed)
    commits = {f"c{i}": {f"f{rng.randrange(30)}" for _ in range(rng.randrange(1, 6))} for i in range(150)}
    commits["huge"] = {f"f{i}" for i in range(30)} | {f"g{i}" for i in range(200)}
    commits["huge2"] = {f"f{i}" for i in range(30)} | {f"g{i}" for i in range(150)}
    df = spark.createDataFrame([(c, f) for c, fs in commits.items() for f in fs], "sha string, file string")
    got = {(r["file_a"], r["file_b"]): r["co_changes"] for r in H.coupling(df, min_co, strength, top_n=None).collect()}
    assert got == naive_coupling(commits, min_co, strength)


def test_coupling_edges_of_both_thresholds(spark):
    data = [(f"s{i}", f) for i in range(3) for f in ("a", "b")] + [(f"t{i}", "a") for i in range(7)] + [("s0", "a")]
    df = spark.createDataFrame(data, "sha string, file string")
    (r,) = H.coupling(df).collect()
    assert (r["co_changes"], r["strength"]) == (3, 0.3)


@pytest.mark.parametrize("seed", range(3))
def test_coupling_of_numbered_files_counts_commits_above_either_cut_off(spark, seed):
    rng = random.Random(seed)
    commits = {i: {f"m{f % 3}/f{f}" for f in (rng.randrange(25) for _ in range(rng.choice([2, 2, 3, 6, 9, 15])))} for i in range(60)}
    number = {f"m{f % 3}/f{f}": (f * 7) % 25 for f in range(25)}
    df = spark.createDataFrame([(c, number[f]) for c, fs in commits.items() for f in fs for _ in range(2)], "sha long, file long")
    names = spark.createDataFrame([(n, f) for f, n in number.items()], "file long, name string")
    for min_co, strength in ((2, 0.05), (3, 0.4)):
        got = H.coupling(df, min_co, strength, top_n=None, names=names).collect()
        assert {(r["file_a"], r["file_b"]): r["co_changes"] for r in got} == naive_coupling(commits, min_co, strength)
        assert all(r["cross_module"] == (r["file_a"][:2] != r["file_b"][:2]) for r in got)


def test_ownership_ties_and_strict_share(spark):
    day = lambda d: NOW - timedelta(days=d)
    data = [(f"s{i}", "big", day(100), "x", "m", "m/a") for i in range(9)] + [("s9", "small", day(95), "x", "m", "m/a")]
    data += [("q1", "old", day(10), "x", "n", "n/a"), ("q2", "new", day(5), "x", "n", "n/a")]
    got = {r["module"]: r for r in H.ownership(touches(spark, data), F.lit(NOW)).collect()}
    assert (got["m"]["primary_owner"], got["m"]["bus_factor"], got["m"]["is_orphaned"]) == ("big", 1, True)
    assert (got["n"]["primary_owner"], got["n"]["bus_factor"], got["n"]["is_orphaned"]) == ("new", 2, False)


def test_velocity_without_older_weeks_and_future_commits(spark):
    data = [("a", "x", NOW - timedelta(days=1), "s", "m", "m/a"), ("b", "x", NOW + timedelta(days=3), "s", "m", "m/a"), ("c", "x", NOW - timedelta(days=80), "s", "n", "n/a")]
    t = touches(spark, data)
    (r,) = H.velocity(t, F.lit(NOW), 20).collect()
    assert (r["module"], r["touches_per_week"], r["trend"]) == ("m", 0.3, "stable")
    assert {r["module"]: r["trend"] for r in H.velocity(t, F.lit(NOW)).collect()} == {"m": "accelerating", "n": "stale"}


def test_hotspot_scores(spark):
    df = spark.createDataFrame([(f,) for f, n in (("a", 3), ("b", 3), ("c", 1)) for _ in range(n)], "file string")
    assert rows(H.hotspots(df), "file", "change_freq", "score") == [("a", 3, 100), ("b", 3, 95), ("c", 1, 90)]


def test_top_k_and_numbering_on_a_hot_group(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v")).unionByName(spark.range(10).select(F.lit(9).cast("long").alias("g"), "id").withColumnRenamed("id", "v"))
    got = top_k(df, ["g"], [F.desc("v")], 1500, rank="r")
    assert rows(got.groupBy("g").agg(F.count("*"), F.min("v"))) == [(0, 1500, 2000), (1, 1500, 2001), (9, 10, 0)]
    n = number_rows(df, ["g"], "v", "n", width=100)
    assert rows(n.filter("g = 0 and v in (0, 2, 4998)"), "v", "n") == [(0, 1), (2, 2), (4998, 2500)]


def test_exact_median_of_hot_and_small_groups(spark):
    rng = random.Random(5)
    data = [("hot", float(rng.randrange(10**6))) for _ in range(6001)] + [("same", 7.0)] * 2000 + [("two", 1.0), ("two", 4.0), ("one", 3.0), ("one", None)]
    got = {r["g"]: r["median"] for r in exact_median(spark.createDataFrame(data, "g string, v double"), ["g"], "v", accuracy=100).collect()}
    want = {g: statistics.median([v for h, v in data if h == g and v is not None]) for g in ("hot", "same", "two", "one")}
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_budgets_match_plain_loops(spark, seed):
    rng = random.Random(seed)
    items = [(g, i, rng.choice([1, 1, 2, 3, 5, 8, 13, 40, 200])) for g in "ab" for i in range(400)]
    df = spark.createDataFrame(items, "g string, i long, cost long")
    budget = rng.choice([17, 60, 100])
    prefix, greedy = [], []
    for g in "ab":
        used, open_ = 0, True
        free = budget
        for _, i, c in [x for x in items if x[0] == g]:
            open_ = open_ and used + c <= budget
            if open_:
                used += c
                prefix.append((g, i))
            if c <= free:
                free -= c
                greedy.append((g, i))
    assert rows(BU.prefix_budget(df, ["g"], [F.asc("i")], "cost", budget), "g", "i") == sorted(prefix, key=repr)
    assert rows(BU.greedy_budget(df, ["g"], [F.asc("i")], "cost", budget), "g", "i") == sorted(greedy, key=repr)


def test_shaping_keeps_answers_and_round_trips(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k long, v string, n string")
    packed = BU.pack(df.orderBy("k"), ["k", "v", "n"])
    assert BU.unpack(packed) == [{"k": 1, "v": "a"}, {"k": 2, "v": "b", "n": "x"}]
    payload = {"answer": ["keep me"] * 3, "noise": ["x" * 20] * 500, "empty": [], "meta": {"a": None}}
    out = BU.fit(payload, 300, priority={"noise": 1}, keep={"answer"})
    assert out["answer"] == payload["answer"] and len(out["noise"]) < 500 and "noise" in out["truncated"] and "empty" not in out
    assert BU.fit(payload, 0)["noise"] == payload["noise"]
    assert BU.fit({"answer": ["y" * 4000]}, 10, keep={"answer"})["budgetNote"] == BU.EXPANDED_NOTE
