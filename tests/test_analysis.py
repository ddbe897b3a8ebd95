"""The whole analysis of a small polyglot tree, and its bundle."""

from __future__ import annotations

import json

import pytest

from tests import minirepo
from weftgraph.operators import codec
from weftgraph.plans import analysis
from weftgraph.sources import stores
from weftgraph.sources.settings import Settings


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    stages = []
    a = analysis.analyze(spark, minirepo.write(tmp_path_factory.mktemp("repo")), hook=lambda s, t: stages.append(s))
    assert stages == ["manifest", "facts", "links", "edges", "graph", "zones", "reports"]
    return a


@pytest.fixture(scope="module")
def pairs(result):
    return {(r.lang, r.kind, r.src, r.dst) for r in result.edges.collect()}


def test_python_edges(pairs):
    want = {("pkg/__init__.py", "pkg/core.py"), ("pkg/core.py", "pkg/util.py"), ("pkg/core.py", "pkg/sub/deep.py"), ("pkg/core.py", "pkg/models.py"), ("pkg/models.py", "pkg/core.py"), ("pkg/sub/deep.py", "pkg/util.py"), ("pkg/api.py", "pkg/core.py"), ("pkg/api.py", "pkg/models.py"), ("pkg/__main__.py", "pkg/api.py"), ("pkg/__main__.py", "pkg/util.py"), ("tests/test_core.py", "pkg/core.py")}
    assert {(s, d) for lang, k, s, d in pairs if lang == "python"} == want


def test_web_edges(pairs):
    app, lib = "web/src/app.ts", "web/src/lib/"
    want = {(app, lib + "api.ts"), (app, lib + "format.ts"), (app, lib + "side.ts"), (app, lib + "index.ts"), (app, "web/src/lazy.tsx"), (lib + "api.ts", lib + "types.ts"), (lib + "format.ts", lib + "api.ts"), (lib + "index.ts", lib + "api.ts")}
    assert {(s, d) for lang, k, s, d in pairs if lang == "ts"} == want


def test_other_languages(pairs):
    j = "j/src/main/java/com/acme/"
    assert {(k, s, d) for lang, k, s, d in pairs if lang == "java"} == {("import", j + "App.java", j + x) for x in ("util/Strings.java", "model/User.java", "model/Role.java")} | {("extends", j + "App.java", j + "Base.java")}
    assert {(k, s, d) for lang, k, s, d in pairs if lang == "kotlin"} == {("import", "k/Main.kt", "k/data/Store.kt"), ("import", "k/Main.kt", "k/ui/View.kt"), ("symbol", "k/Main.kt", "k/Helper.kt"), ("symbol", "k/Main.kt", "k/data/Store.kt")}
    assert {(k, s, d) for lang, k, s, d in pairs if lang == "go"} == {("import", "g/main.go", "g/util/doc.go")}
    r = "r/src/"
    assert {(k, s, d) for lang, k, s, d in pairs if lang == "rust"} == {("import", r + "main.rs", r + x) for x in ("net/mod.rs", "net/client.rs", "util.rs")} | {("import", r + "net/mod.rs", r + "net/client.rs"), ("import", r + "net/client.rs", r + "net/mod.rs"), ("impl", r + "net/client.rs", r + "net/mod.rs")}
    b = "rb/lib/shop"
    assert {(k, s, d) for lang, k, s, d in pairs if lang == "ruby"} == {("import", b + ".rb", b + "/cart.rb"), ("import", b + ".rb", b + "/item.rb"), ("call", b + "/cart.rb", b + "/item.rb"), ("rails_association", b + "/cart.rb", b + "/item.rb")}


def test_crosstalk(result):
    assert {(r.src, r.dst, r.join, r.confidence) for r in result.crosstalk.collect()} == {
        ("pkg/core.py", "web/src/app.ts", "env:API_KEY", 1.0),
        ("pkg/api.py", "web/src/app.ts", "http:GET:" + "/api/users/:id", 0.9),
        ("pkg/api.py", "web/src/app.ts", "http:POST:/api/items", 1.0), ("pkg/api.py", "web/src/lib/api.ts", "http:GET:/api/items", 1.0),
    }


def test_nodes(result):
    n = {r.id: r for r in result.nodes.collect()}
    core = n["pkg/core.py"]
    assert (core.loc, core.comment_lines, core.blank_lines, core.sloc) == (21, 3, 7, 11)
    assert (core.scc_id, core.scc_size, core.scc_size_runtime) == ("pkg/core.py", 2, 1) and (core.importers_count, core.dependencies_count) == (4, 4)
    assert n["pkg/broken.py"].parse_status == "error" and n["web/src/lib/side.ts"].comment_lines == 2
    assert core.functions == ["never_called", "run"] and core.globals == ["KEY"] and core.import_style_counts["relative"] == 3
    assert n["pkg/util.py"].imports_external == ["json", "requests"] and n["pkg/lonely.py"].du is None and n["pkg/util.py"].dd == 1


def test_seeds_dead_code_and_clones(result):
    s = {r.id: r for r in result.seeds.collect()}
    assert s["pkg/api.py:app"].kind == "asgi_cmd" and s["pkg/core.py:run"].kind == "console_script" and {"g/main.go:main", "r/src/main.rs:main", "k/Main.kt:main", "j/src/main/java/com/acme/App.java:main"} <= set(s)
    assert {(r.kind, r.file) for r in result.warnings.collect()} == {("dynamic_imports_present", "pkg/api.py"), ("cmd_module_unresolved", "Dockerfile")}
    d = {r.path: r for r in result.dead_code.collect()}
    assert {p for p, r in d.items() if r.is_potentially_dead} == {"dup/a.py", "dup/b.py", "pkg/lonely.py", "pkg/broken.py"}
    names = lambda p, c: [x.name for x in d[p][c]]
    assert names("pkg/core.py", "unused_functions") == ["never_called"] and names("pkg/models.py", "unused_classes") == ["Unused"] and names("pkg/util.py", "unused_imports") == ["json", "requests"]
    assert names("pkg/util.py", "unused_functions") == []  # all of it is imported by a star
    assert {(r.group_id, r.file, r.start, r.stop) for r in result.clone_members.collect()} == {("G0001", "dup/a.py", 1, 5), ("G0001", "dup/b.py", 3, 7), ("G0002", "dup/a.py", 2, 6), ("G0002", "dup/b.py", 4, 8)}


def test_bundle_comes_back_compact(result, tmp_path, spark):
    b = analysis.bundle(result, name="mini")
    packed = json.loads(json.dumps(codec.compress_bundle(b)))
    assert codec.decode_bundle(packed) == b
    imports = {(e["src"], e["dst"]) for e in b["edges"] if e["lang"] == "python"}
    assert ("pkg/core.py", "pkg/__init__.py") in imports  # bundles point from the provider
    assert b["summary"]["counts"][0]["nodes"] == len(b["nodes"]) and b["summary"]["languages"][0]["language"] == "polyglot"
    assert {z["zone_id"] for z in b["zones"]} >= {"pkg", "pkg.sub", "web.src.lib"}


def test_graph_document_reads_back(result, spark, tmp_path):
    doc = analysis.graph_document(result, positions=spark.createDataFrame([("pkg/core.py", 1.0, 2.0)], "id string, x double, y double"))
    assert doc["signature"] == f"n:{len(doc['nodes'])};e:{len({(e['src'], e['dst']) for e in doc['edges']})}"
    assert next(n for n in doc["nodes"] if n["id"] == "pkg/core.py")["pos"] == {"x": 1.0, "y": 2.0}
    stores.write_document(doc, f"{tmp_path}/g.json")
    nodes, edges = stores.read_graph(spark, f"{tmp_path}/g.json")
    assert nodes.count() == len(doc["nodes"]) and {(r.src, r.dst, r.kind) for r in edges.collect()} == {(e["src"], e["dst"], e["kind"]) for e in doc["edges"]}
    analysis.save(result, f"{tmp_path}/out")
    kept = stores.load_tables(spark, f"{tmp_path}/out", [*analysis.OUTPUTS, "summary/hotspots"])
    assert len(kept) == len(analysis.OUTPUTS) + 1 and kept["edges"].count() == len(doc["edges"])
    left = analysis.follow_up(kept["file_index"], kept["nodes"].where("lang = 'python'").select("id"))
    assert left.where("id LIKE '%.py'").count() == 0 and left.where("id LIKE '%.ts'").count() == 6


def test_files_as_a_table_and_nothing(spark):
    files = spark.createDataFrame([("a.py", "import b\nimport os"), ("b.py", None), (None, "x"), ("a.py", "import b\nimport os")], "path string, content string")
    a = analysis.analyze(spark, files, Settings(include_external=True))
    assert {(r.src, r.dst) for r in a.edges.collect()} == {("a.py", "b.py"), ("a.py", "ext::os")}
    assert {r.id: r.parse_status for r in a.nodes.collect()} == {"a.py": "ok", "b.py": "error", "ext::os": "missing"}
    empty = analysis.analyze(spark, files.limit(0))
    assert empty.nodes.count() == 0 and empty.edges.count() == 0 and empty.seeds.count() == 0


def test_events_are_filtered_and_capped():
    e = analysis.Events(silenced=frozenset({"no"}), most=2)
    assert [e("yes"), e("yes"), e("yes"), e("no")] == [True, True, False, False] and e.counts == {"yes": 3}
