import json

from conftest import rows

from trailgraph.plans.build_graph import build_graph
from trailgraph.sources import graph_store as GS


def test_graph_round_trip(spark, tree, tmp_path):
    g = build_graph(tree({"a.ts": "import './b.js';\nexport function f() {\n  return 1;\n}\n", "b.ts": ""}))
    GS.save(g, str(tmp_path / "g"))
    back = GS.load(spark, str(tmp_path / "g"))
    assert rows(back.edges, "src", "dst", "relation") == rows(g.edges, "src", "dst", "relation") != []


def test_json_documents(spark, tmp_path):
    doc = {"schemaVersion": 1, "graphType": "dependency", "scope": "x", "nodes": [{"id": "module:a", "kind": "module", "label": "a", "path": "a.ts", "confidence": "verified", "metadata": {"churn": 4, "isTest": True}, "evidence": ["a.ts"]}],
           "edges": [{"from": "module:a", "to": "pkg:b", "relation": "imports", "confidence": "verified", "metadata": {"trustState": "contested"}, "evidence": []}], "unknowns": ["u"]}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    g = GS.read_graph_json(spark, str(tmp_path / "g.json"))
    assert rows(g["nodes"], "id", "churn", "is_test") == [("module:a", 4, True)] and rows(g["edges"], "src", "dst", "trust_state") == [("module:a", "pkg:b", "contested")]
    assert g["unknowns"].count() == 1 and g["meta"].first()["schemaVersion"] == 1
    (tmp_path / "p.json").write_text(json.dumps({"nodes": [{"id": "n1", "type": "fn"}], "links": [{"from": "n1", "to": "n2", "type": "calls"}]}))
    p = GS.read_provider_graph(spark, str(tmp_path / "p.json"))
    assert rows(p["nodes"], "raw_id", "label", "kind") == [("n1", "n1", "fn")] and rows(p["edges"], "source", "target", "relation") == [("n1", "n2", "calls")]
    (tmp_path / "c.json").write_text(json.dumps({"claims": [{"id": "C1", "kind": "derived", "fact": {"type": "module-imports", "from": "a.ts", "to": "b.ts"}, "evidence": [{"path": "a.ts", "contentHash": "h"}]},
                                                             {"id": "C2", "evidence": [{"path": "a.ts", "lines": [2, 3], "contentHash": "k"}]}]}))
    c, ev = GS.read_claims(spark, str(tmp_path / "c.json"))
    assert rows(c) == [("C1", "derived", "module-imports|a.ts|b.ts"), ("C2", "asserted", None)]
    assert rows(ev, "claim_id", "start", "end", "hash") == [("C1", None, None, "h"), ("C2", 2, 3, "k")]
