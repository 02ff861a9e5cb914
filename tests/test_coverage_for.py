"""Records vouch for changes by hash, or by time where they were made without version control."""

from trailgraph.operators import ledger as L

RECORD = "record_id string, verdict string, provenance string, ord long, created_at long, versioned boolean"
FILE = "record_id string, path string, hash string"


def verdict(spark, records, held, files):
    now = spark.createDataFrame([("c", *f) for f in files], "change string, path string, hash string, mtime long")
    v, open_ = L.coverage_for(now, spark.createDataFrame(records, RECORD), spark.createDataFrame(held, FILE), ["change"])
    r = v.first()
    return (r["covered"], r["record_id"], r["agent_only"]), sorted(x["path"] for x in open_.collect())


def test_coverage(spark):
    a, b = ("a.ts", "h1", 50), ("b.ts", "h2", 60)
    by_hash = [("r1", "a.ts", "h1"), ("r1", "b.ts", "h2"), ("r2", "a.ts", "h1"), ("r2", "b.ts", "old"), ("r3", "a.ts", "h1"), ("r3", "b.ts", "h2")]
    records = [("r1", "pass", "agent", 3, 10, True), ("r2", "pass", "agent", 1, 30, True), ("r3", "fail", "human", 2, 20, True)]
    # The newest passing record lacks b; an older one covers, a failed one vouches for nothing.
    assert verdict(spark, records, by_hash, [a, b]) == ((True, "r1", True), [])
    assert verdict(spark, records[1:], by_hash, [a, b]) == ((False, None, None), ["b.ts"])
    human = [*records, ("r4", "pass", "human", 9, 1, True)]
    assert verdict(spark, human, [*by_hash, ("r4", "a.ts", "h1"), ("r4", "b.ts", "h2")], [a, b])[0] == (True, "r1", False)
    # Without version control: files that have not changed since.
    timed = [*records[1:], ("t1", "pass", "agent", 0, 60, False)]
    assert verdict(spark, timed, by_hash, [a, b])[0] == (True, "t1", True)
    assert verdict(spark, [*timed, ("t0", "pass", "human", 8, 61, False)], by_hash, [a, b])[0] == (True, "t1", False)
    assert verdict(spark, timed, by_hash, [a, ("b.ts", "h2", 61)]) == ((False, None, None), ["a.ts", "b.ts"])
    assert verdict(spark, timed, by_hash, [a, ("b.ts", "h2", None)])[0] == (False, None, None)
    # No readable file needs no record; no record leaves all.
    assert verdict(spark, records, by_hash, [("a.ts", None, 5)]) == ((True, None, None), [])
    assert verdict(spark, [], [], [a]) == ((False, None, None), ["a.ts"])


def test_masks_never_hide_a_record(spark):
    """Random records against brute force: the largest has more files than a record has bits, files repeat, one hash is null."""
    import random


    rng = random.Random(5)
    held = {f"r{i}": {(f"f{rng.randrange(12)}", f"h{rng.randrange(2)}") for _ in range(rng.randrange(1, 9))} for i in range(60)}
    held["big"] = {(f"f{i}", "h0") for i in range(600)}
    changes = {f"c{i}": set(rng.sample(sorted(held[f"r{i}"]), rng.randrange(1, len(held[f"r{i}"]) + 1))) for i in range(60)} | {"all": set(held["big"]), "none": {("f1", "h0"), ("f1", "new")}}
    now = spark.createDataFrame([(c, *f) for c, fs in changes.items() for f in [*fs, *fs]] + [("lost", "f1", None)], "change string, path string, hash string")
    records = [(r, "pass" if i % 5 else "fail", "human" if i % 3 else "agent", -i) for i, r in enumerate(held)]
    files = spark.createDataFrame([(r, *f) for r, fs in held.items() for f in [*fs, *fs]] + [("r1", "f1", None)], FILE)
    rec = spark.createDataFrame(records, "record_id string, verdict string, provenance string, ord long")
    got = {r["change"]: (r["record_id"], r["records"], r["agent_only"]) for r in L.covering_records(now, rec, files, ["change"]).collect()}
    want = {}
    for c, fs in changes.items():
        full = sorted((o, r, p) for r, v, p, o in records if v == "pass" and fs <= held[r])
        if full:
            want[c] = (full[0][1], len(full), full[0][2] == "agent" and not any(p == "human" for _, _, p in full))
    assert got == want
    # Only records that hold all files are compared one by one: the masks stand in the join itself.
    plan = L.covering_records(now, rec, files, ["change"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_r0" in plan and "_c3" in plan
