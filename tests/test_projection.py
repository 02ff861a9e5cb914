"""A second source's evidence: agreement, staleness, scope, conflicts, manifests."""

import hashlib
import json

import pytest
from conftest import rows

from trailgraph.operators import trust as TR
from trailgraph.plans import catalog
from trailgraph.plans.projection import project
from trailgraph.sources import graph_store as GS
from trailgraph.sources.policy import FilePolicy

ROOT, SPACE = "/w/app", "/w/app/.tool/workspace"
A, B = 'import { answer } from "./b.js";\n', "export const answer = 42;\n"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture()
def run(spark, tmp_path):
    def go(nodes, edges, a=A, b=B, version=1, provider="second"):
        (tmp_path / "run.json").write_text(json.dumps({"schemaVersion": version, "provider": provider, "providerVersion": "1", "sourceHashes": {"src/a.ts": digest(A), "src/b.ts": digest(B)}}))
        (tmp_path / "graph.json").write_text(json.dumps({"nodes": nodes, "edges": edges}))
        native = spark.createDataFrame([("module:src/a", "module", "a", "src/a.ts", "verified", 0), ("module:src/b", "module", "b", "src/b.ts", "verified", 1)], "id string, kind string, label string, path string, confidence string, ord long")
        links = spark.createDataFrame([("module:src/a", "module:src/b", "imports", "verified", 0)], "src string, dst string, relation string, confidence string, ord long")
        current = spark.createDataFrame([("src/a.ts", digest(a)), ("src/b.ts", digest(b)), ("dist/x.js", digest("x"))], "path string, hash string")
        out = project(native, links, GS.read_provider_graph(spark, str(tmp_path / "graph.json")), GS.read_run_manifest(spark, str(tmp_path / "run.json"), "second"), current, FilePolicy(), "second", ROOT, SPACE)
        edge = {(r["src"], r["dst"], r["relation"]): r for r in out["edges"].collect()}
        node = {r["id"]: r for r in out["nodes"].collect()}
        return node, edge, out["counters"].first(), [r["note"] for r in out["notes"].collect()]

    return go


def two(prefix=""):
    return [{"id": x, "label": x, "source_file": f"{prefix}src/{x}.ts", "confidence": "EXTRACTED"} for x in "ab"]


def test_agreement_corroborates(run):
    node, edge, n, notes = run(two(SPACE + "/"), [{"source": "a", "target": "b", "relation": "IMPORTS_FROM", "confidence": "EXTRACTED", "source_file": "src/a.ts"}])
    e = edge["module:src/a", "module:src/b", "imports"]
    assert (e["corroborated"], e["trust_state"], e["providers"], e["confidence"]) == (True, "fresh", ["native", "second"], "verified")
    assert n["corroborated_edges"] == 1 and n["accepted_edges"] == 0 and notes == []
    assert node["module:src/a"]["providers"] == ["native", "second"] and node["module:src/a"]["corroborated"]


def test_stale_evidence_is_left_out(run):
    node, edge, n, notes = run(two(), [{"source": "a", "target": "b", "relation": "imports", "source_file": "src/a.ts"}], b="export const answer = 43;\n")
    e = edge["module:src/a", "module:src/b", "imports"]
    assert e["corroborated"] is None and e["providers"] == ["native"]
    assert n["stale_evidence"] > 0 and notes == [f"Second evidence excluded as stale: {n['stale_evidence']} item(s)."]


def test_out_of_scope_nodes_never_enter(run):
    node, _, n, notes = run([{"id": "g", "label": "g", "source_file": "dist/x.js"}, {"id": "h", "label": "h", "source_file": "/etc/passwd"}, {"id": " ", "label": "i"}], [])
    assert n["accepted_nodes"] == 0 and n["rejected_evidence"] == 3 and set(node) == {"module:src/a", "module:src/b"}
    assert notes == ["Second evidence rejected as malformed or out of scope: 3 item(s)."]


def test_repeats_confirm_nothing(run):
    row = {"source": "a", "target": "b", "relation": "references", "confidence": "EXTRACTED", "source_file": "src/a.ts"}
    _, edge, n, _ = run(two(), [row, row])
    e = edge["module:src/a", "module:src/b", "references"]
    assert (e["trust_state"], e["corroborated"], e["repeats"], e["providers"], e["confidence"]) == ("contested", False, 1, ["second"], "inferred")
    assert n["contested_edges"] == 1 and n["corroborated_edges"] == 0


def test_bad_manifest_is_ignored(run):
    for bad in ({"version": 2}, {"provider": "other"}):
        node, edge, n, notes = run(two(), [{"source": "a", "target": "b", "relation": "imports"}], **bad)
        assert notes == ["Second evidence manifest is invalid and was ignored."] and n["rejected_evidence"] == 1
        assert len(edge) == 1 and edge["module:src/a", "module:src/b", "imports"]["corroborated"] is None


def test_edges_are_judged_by_key_and_rows_of_one_key_by_ordinal(spark):
    nodes = spark.createDataFrame([(x, x.upper(), "stale" if x == "d" else "fresh", None, "matched", 0) for x in "abcd"], "raw_id string, id string, trust_state string, source_file string, status string, ord long")
    native = spark.createDataFrame([("A", "B", "calls")], "src string, dst string, relation string")
    hashes = spark.createDataFrame([("f", "1", "1"), ("g", "1", "2")], "path string, current string, expected string")
    made = [
        ("a", "b", "call", 1, None, "fresh", "corroborated"), ("a", "b", "call", None, None, "fresh", "corroborated"), ("a", "b", "uses", 2, "f", "contested", "accepted"), ("a", "b", "uses", 3, None, None, "merged"),
        ("b", "c", "uses", 5, None, "unverifiable", "accepted"), ("b", "c", "uses", 5, None, "unverifiable", "accepted"), ("b", "c", "uses", 6, None, None, "merged"), ("b", "c", "uses", None, None, None, "accepted"),
        ("b", "c", "odd", 7, None, "contested", "accepted"), ("c", "a", "odd", None, None, None, "accepted"), ("c", "b", "odd", 8, "g", None, "stale"), ("c", "d", "odd", 9, None, None, "stale"), ("c", "x", "odd", 9, None, None, "rejected"),
    ]
    raw = spark.createDataFrame([(s, t, r, "EXTRACTED", f, False, o) for s, t, r, o, f, *_ in made], "source string, target string, relation string, confidence string, source_file string, excluded boolean, ord long")
    found = TR.reconcile_edges(native, nodes, raw, hashes)
    up = lambda x: None if x == "x" else x.upper()
    want = [(up(s), up(t), "calls" if r == "call" else r, o, trust, status, "inferred") for s, t, r, o, _, trust, status in made]
    assert rows(found, "src", "dst", "relation", "ord", "trust_state", "status", "confidence") == sorted(want, key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan  # only rows of repeated keys meet anything again


def test_node_rows_read_no_line_items(spark, tmp_path):
    spark.createDataFrame([(1, "O", "1-URGENT"), (2, "P", "5-LOW")], "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, "red ring", 12), (2, "blue ring", 22), (3, "tin ring", 45)], "p_partkey long, p_name string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, "s1")], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r["raw_id"]: (r["id"], r["trust_state"], r["status"]) for r in catalog.QUERIES["trust_nodes"](spark, str(tmp_path)).collect()}
    assert got == {
        "order:1": ("order:1", "fresh", "matched"), "order:2": ("order:2", "stale", "matched"), "part:1": ("part:1", "fresh", "matched"), "part:2": ("part:2", "stale", "matched"),
        "part:3": ("second:part:3", "fresh", "accepted"), "supplier:1": ("second:supplier:1", "unverifiable", "unaccepted"),
    }
    assert catalog.QUERIES["provider_graph_nodes"](spark, str(tmp_path)).count() == 5
