"""Conversation repair against exhaustive search, and edge cases."""

import hashlib
import itertools
import random
import re

from pyspark.sql import functions as F

from trailgraph.llm import dialogues as D

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def marks(rows):
    """(blank, seen, cut) of rows in order."""
    out, seen = [], set()
    for role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        first = "blank" if not solid else "seen" if (role, text) in seen else "cut" if solid[-1] not in ".!?" else ""
        out.append(first)
        seen.add((role, text))
    return out


def exhaustive(rows):
    """Least (cost, audit, lines) over every edit of every row with up to two inserts at every place."""
    faults = marks(rows)
    gaps = [x for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    choices = [gaps]
    for (role, text), f in zip(rows, faults):
        own = [("D", None, 4)]
        if f in ("", "cut"):
            extra = 3 * (f == "cut")
            own += [("K", (role, text), extra), ("R", ("user", text), 3 + extra), ("R", ("assistant", text), 3 + extra)]
        choices += [own, gaps]
    for pick in itertools.product(*choices):
        cost, audit, lines = 0, "", []
        for k, x in enumerate(pick):
            if k % 2 == 0:
                cost, audit, lines = cost + 3 * len(x), audit + "I" * len(x), lines + [(r, "") for r in x]
            else:
                cost, audit, lines = cost + x[2], audit + x[0], lines + ([x[1]] if x[1] else [])
        if (best is None or (cost, audit) <= best[:2]) and GOOD.fullmatch("".join(r[:1] for r, _ in lines)):
            best = (cost, audit, lines)
    return best


def every_split(rows):
    """Full interval parse with all split points; longer rows than the search can take."""
    faults = marks(rows)
    n = len(rows)
    cells = {(i, i + 1): D.row_cells(r[:1], f in ("blank", "seen"), f == "cut") for i, ((r, _), f) in enumerate(zip(rows, faults))}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            out = {}
            for m in range(i + 1, i + size):
                for k, v in D.product(cells[i, m], cells[m, i + size]).items():
                    out[k] = min(out.get(k, v), v)
            cells[i, i + size] = out
    return D.cheapest(cells[0, n])


def sample(rng, n):
    return [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool"]), rng.choice(["Hi.", "Yes!", "no", "", " \t", f"So {rng.random():.3f}?"])) for _ in range(n)]


def run(spark, convs):
    data = [(c, t, r, x) for c, rows in convs.items() for t, (r, x) in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    parsed = D.parse(df).cache()
    got = {r["conv_id"]: r for r in parsed.collect()}
    lines = {}
    for r in sorted(D.repair(df, parsed).collect(), key=lambda r: (r["conv_id"], r["pos"])):
        lines.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    digests = {r["conv_id"]: r["repaired_sha256"] for r in D.digests(df, parsed).collect()}
    return got, lines, digests


def test_exhaustive(spark):
    rng = random.Random(4)
    convs = {i: sample(rng, 1 + i % 2) for i in range(24)} | {100 + i: sample(rng, 3)[:3] for i in range(4)}
    got, lines, digests = run(spark, convs)
    for c, rows in convs.items():
        cost, audit, want = exhaustive(rows)
        assert (got[c]["cost"], got[c]["audit"]) == (cost, audit), rows
        assert lines.get(c, []) == want
        assert digests.get(c) == (hashlib.sha256("\n".join(f"{r}:{t}" for r, t in want).encode()).hexdigest() if want else None)


def test_all_split_points_agree(spark):
    rng = random.Random(5)
    convs = {i: sample(rng, 4 + i % 9) for i in range(40)}
    got, lines, _ = run(spark, convs)
    for c, rows in convs.items():
        f = marks(rows)
        assert (got[c]["cost"], got[c]["audit"]) == every_split(rows)
        assert (got[c]["blank"], got[c]["duplicate"], got[c]["truncated"]) == (f.count("blank"), f.count("seen"), f.count("cut"))
        assert got[c]["illegal"] == sum(a[0][:1] + b[0][:1] not in D.LEGAL for a, b in zip(rows, rows[1:]))
        assert GOOD.fullmatch("".join(r[:1] for r, _ in lines.get(c, [])))


def test_long_conversation_in_many_pieces(spark):
    rng = random.Random(6)
    rows = [(r, f"{x}{i % 700}." if rng.random() < 0.7 else x) for i, (r, x) in enumerate(sample(rng, 3000))]
    got, lines, digests = run(spark, {1: rows, 2: sample(rng, 4)})
    f = marks(rows)
    cells = [D.row_cells(r[:1], k in ("blank", "seen"), k == "cut") for (r, _), k in zip(rows, f)]
    total = cells[0]
    for x in cells[1:]:
        total = D.product(total, x)
    assert (got[1]["cost"], got[1]["audit"]) == D.cheapest(total)
    assert got[1]["duplicate"] == f.count("seen") and got[1]["gaps"] == 0
    assert GOOD.fullmatch("".join(r[:1] for r, _ in lines[1]))
    assert len(lines[1]) == sum(x != "D" for x in got[1]["audit"])
    assert digests[1] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines[1]).encode()).hexdigest()


def test_edges(spark):
    data = [
        (None, None, None, None), (None, 4, "user", "One."), (None, 9, "assistant", "Two."),  # null id, turn, role and text
        (1, None, "user", "A."), (1, None, "user", "A."), (1, 3, "assistant", "B."),  # repeated rows of a null turn
        (2, 0, "", "C."), (3, 0, "user", "x" * 300_000), (3, 1, "assistant", " " * 50_000 + "?"),
        (4, 5, "user", "é ."), (4, 5, "assistant", "Z."),  # ties in turn
    ]
    df = spark.createDataFrame(data, SCHEMA).withColumn("_d", F.lit(1)).withColumn("audit", F.lit("x")).withColumn("digest", F.lit(0)).withColumn("n", F.lit(7))
    ids = df.unionByName(spark.createDataFrame([(8, 0, "user", "gone", 1, "x", 0, 7)], df.schema))
    got = {r["conv_id"]: tuple(r)[1:8] for r in D.report(ids, df).collect()}
    assert got[None] == (4, 1, 0, 0, 1, 4, "DKK")
    assert got[1] == (0, 0, 1, 0, 1, 4, "KDK")
    assert got[2] == (0, 0, 0, 0, 0, 4, "D")
    assert got[3] == (0, 0, 0, 1, 0, 3, "KK")
    assert got[4] == (0, 0, 0, 0, 0, 6, "IKKI")
    assert got[8] == (0, 0, 0, 0, 0, 0, "")
    empty = spark.createDataFrame([], SCHEMA)
    assert D.report(empty, D.damage(empty)).collect() == []
    assert D.repair(empty).collect() == []


def test_damage(spark):
    import zlib

    data = [(c, t, "assistant", "Hm. Yes!") for c in range(30) for t in range(6)] + [(None, None, None, None)]
    want = []
    for c, t, r, x in data:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        row = (c, t, "user" if k == 4 else r, "" if k == 1 else x.replace(".", "").replace("!", "") if k == 2 else x)
        want += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    got = [tuple(r) for r in D.damage(spark.createDataFrame(data, SCHEMA)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
