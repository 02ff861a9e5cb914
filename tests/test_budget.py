"""Budgets with free items, sections under one budget, log markers and question rules."""

import math

from conftest import rows
from pyspark.sql import functions as F

from trailgraph.operators import budget as BU
from trailgraph.plans.answers import context_sections
from trailgraph.sources import logs


def test_free_items(spark):
    df = spark.createDataFrame([("a", i, 0) for i in range(8)] + [("b", 0, 0), ("b", 1, 5), ("b", 2, 0), ("b", 3, 9), ("b", 4, 0), ("b", 5, 2)], "g string, i int, cost int")
    assert rows(BU.prefix_budget(df, ["g"], [F.asc("i")], "cost", 8), "g", "i") == [("a", i) for i in range(8)] + [("b", 0), ("b", 1), ("b", 2)]
    assert rows(BU.greedy_budget(df, ["g"], [F.asc("i")], "cost", 8), "g", "i") == [("a", i) for i in range(8)] + [("b", 0), ("b", 1), ("b", 2), ("b", 4), ("b", 5)]


def test_sections(spark):
    data = [("long", 100, "x" * 400), ("long", 100, "y" * 8), ("mid", 50, "a" * 16), ("mid", 50, "b" * 16), ("low", 10, "c" * 16)]
    df = spark.createDataFrame([(s, p, t, i) for i, (s, p, t) in enumerate(data)], "section string, priority int, item string, ord int")
    cost = lambda t: math.ceil(len(t) / 4)
    for budget in (10, 20, 40, 60, 150, 1000):
        used, want = cost("# Context for: \n"), []
        for name in ("long", "mid", "low"):
            own, kept = cost(f"## {name}") + 2, []
            for _, _, t in (x for x in data if x[0] == name):
                if used + own + cost(t) + 1 > budget:
                    break
                kept.append((name, t))
                own += cost(t) + 1
            if kept:
                used += own
                want += kept
        assert rows(context_sections(df, budget), "section", "item") == sorted(want), budget


def test_marker_in_subject(spark, tmp_path):
    (tmp_path / "log.txt").write_text("COMMIT:a1|ann|2024-01-01T00:00:00Z|fix COMMIT: marker\nsrc/a.ts\n\nCOMMIT:b2|bob|2024-01-02T00:00:00Z|next\nsrc/b.ts\n")
    got = rows(logs.parse_commits(logs.commit_records(spark, str(tmp_path))), "sha", "subject", "files")
    assert got == [("a1", "fix COMMIT: marker", ["src/a.ts"]), ("b2", "next", ["src/b.ts"])]


def test_questions(spark):
    text = "- [ ] must we?\n| # | Q | O | S | P |\n|---|---|---|---|---|\n| 1 | plain | me | Done | |\n| 2 | plain | me | open | P0 |\n| Q3 | no | me | open | p0 |\n- [x] fine"
    df = spark.createDataFrame([("d", text)], "doc string, content string")
    assert rows(logs.open_questions(df), "id", "status", "priority") == [("1", "open", "blocking"), ("1", "resolved", "normal"), ("2", "open", "blocking"), ("4", "resolved", "normal")]
