"""Answers and reports give every row; a limit on request says what it leaves out."""

from trailgraph.plans import answers as A
from trailgraph.plans import reports
from trailgraph.plans.build_graph import build_graph
from trailgraph.sources import logs


def test_answers_have_no_limits_by_default(spark, tree, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/db.ts").write_text("export function connect() {\n  return 1;\n}\n")
    for i in range(60):
        (tmp_path / f"src/m{i}.ts").write_text(f"import {{ connect }} from './db';\nimport {{ x }} from './gone{i}';\nexport function load{i}() {{\n  return connect();\n}}\nexport function same() {{\n  return {i};\n}}\n")
    graph = build_graph(logs.read_text_files(spark, str(tmp_path)))
    assert A.who_calls(graph, "connect").count() == 60
    few = A.who_calls(graph, "connect", limit=7).collect()
    assert len(few) == 7 and {r.dropped for r in few} == {53}
    assert A.find_symbol(graph, "same").count() == 60
    assert {r.dropped for r in A.find_symbol(graph, "same", limit=50).collect()} == {10}
    assert A.get_graph(graph, kind="symbol")["nodes"].count() == 121
    cut = A.get_graph(graph, kind="symbol", limit=100)["nodes"].collect()
    assert len(cut) == 100 and {r.dropped for r in cut} == {21}
    unknown = A.change_impact(graph, ["src/db.ts"])["unknowns"]
    assert unknown.count() == graph.unknowns.count()


def test_report_tables_are_whole(spark):
    df = spark.range(230).orderBy("id")
    assert len(reports.table(df, {"id": "Id"}).splitlines()) == 232
    few = reports.table(df, {"id": "Id"}, 10).splitlines()
    assert few[-1] == "_220 more rows_" and few[2:12] == [f"| {i} |" for i in range(10)]


def test_evidence_in_reading_order(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/db.ts").write_text("export function connect() {\n  return 1;\n}\n")
    for name, lines in (("z", 0), ("b", 3), ("a", 1)):
        (tmp_path / f"src/{name}.ts").write_text("\n" * lines + f"import {{ connect }} from './db';\nexport function use_{name}() {{\n  return connect();\n}}\n")
    (tmp_path / "src/top.ts").write_text("import { use_b } from './b';\nimport { use_a } from './a';\nexport function top() {\n  return use_a() + use_b();\n}\n")
    graph = build_graph(logs.read_text_files(spark, str(tmp_path)))
    assert [r["id"] for r in A.who_calls(graph, "connect").collect()] == ["symbol:src/a#use_a", "symbol:src/b#use_b", "symbol:src/z#use_z"]
    got = {r["id"]: r for r in A.change_impact(graph, ["src/db.ts"])["details"].collect()}
    assert got["module:src/b"]["evidence"] == "src/b.ts:4" and got["module:src/b"]["through"] == "module:src/db"
    # The importer of both surfaces through the one that came first.
    assert got["module:src/top"]["hop"] == "indirect" and got["module:src/top"]["through"] == "module:src/a"
    assert got["module:src/top"]["evidence"] == "src/top.ts:2"
    paths = [r["path"] for r in A.execution_paths(graph, "src/top.ts", "src/db.ts").orderBy("hops", "ords").collect()]
    assert paths == [["module:src/top", "module:src/b", "module:src/db"], ["module:src/top", "module:src/a", "module:src/db"]]
