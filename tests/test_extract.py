from __future__ import annotations

import pytest

from weftgraph.functions import extract
from weftgraph.functions.source_common import blank_comments

CASES = [  # language, code, key, confidence
    ("python", "@app.get('/v2/clients')\ndef f(): ...", "http:GET:/v2/clients", 1.0),
    ("python", "@app.post('/v2/clients/{cid}')\ndef f(cid: int): ...", "http:POST:/v2/clients/:id", 1.0),
    ("python", "@r.get('/shops/{a}/items/{b}')\ndef f(): ...", "http:GET:/shops/:id/items/:id", 1.0),
    ("python", "@app.route('/orders/<int:cid>')\ndef f(): ...", "http:GET:/orders/:id", 1.0),
    ("python", "@app.route('/blobs/<path:p>')\ndef f(): ...", "http:GET:/blobs/:id", 1.0),
    ("python", "@app.get(f'/v2/clients/{cid}')\ndef f(): ...", "http:GET:/v2/clients/:id", 0.9),
    ("python", "import os\nk = os.getenv('MAIL_KEY')", "env:MAIL_KEY", 1.0),
    ("python", "import os\nb = os.environ['HOST_URL']", "env:HOST_URL", 1.0),
    ("python", "import os\ns = os.environ.get('SECRET_KEY', 'd')", "env:SECRET_KEY", 1.0),
    ("python", "@socketio.on('order.paid')\ndef f(d): ...", "socket:event:order.paid", 1.0),
    ("python", "socketio.emit('notification', d)", "socket:event:notification", 1.0),
    ("python", "app = FastAPI(openapi_url='/spec.json')", "openapi:schema:/spec.json", 1.0),
    ("python", "class S(order_pb2_grpc.OrderServiceServicer):\n    def FindOrder(self, r, c): ...", "rpc:OrderService.FindOrder", 0.9),
    ("python", "producer.send('order.paid', value=d)", "queue:event:order.paid", 1.0),
    ("python", "def resolve_find_order(root, info, i): ...", "graphql:query:FindOrder", 1.0),
    ("ts", "fetch('/v2/clients')", "http:GET:/v2/clients", 1.0),
    ("ts", "axios.post('/v2/clients', d)", "http:POST:/v2/clients", 1.0),
    ("ts", "axios({ url: '/a/1', method: 'put' })", "http:PUT:/a/:id", 0.9),
    ("ts", "axios({ url: '/a' })", "http:GET:/a", 0.75),
    ("ts", "fetch(`/v2/clients/${cid}`)", "http:GET:/v2/clients/:id", 0.9),
    ("ts", "const a = process.env.HOST_URL", "env:HOST_URL", 1.0),
    ("ts", "const a = import.meta.env.VITE_API_URL", "env:VITE_API_URL", 1.0),
    ("ts", "trpc.order.find.useQuery(id)", "rpc:trpc:order.find", 0.95),
    ("ts", "gql`query FindOrder { order { no } }`", "graphql:query:FindOrder", 1.0),
    ("ts", "socket.emit('order.paid', d)", "socket:event:order.paid", 1.0),
    ("ts", "router.push('/orders')", "route:/orders", 1.0),
]


def test_candidate_keys(spark):
    df = spark.createDataFrame([(f"{i}.x", lang, code) for i, (lang, code, _, _) in enumerate(CASES)], "path string, lang string, content string")
    got = {(int(r.node_id[:-2]), r.join, r.confidence) for r in extract.candidates(extract.facts(df)).collect()}
    missing = [c for i, c in enumerate(CASES) if (i, c[2], c[3]) not in got]
    assert missing == [] and len(got) == len(CASES)


def test_flask_methods_are_a_route_each_and_repeats_one():
    f, _, _ = extract.facts_of("@app.route('/x', methods=['GET', 'POST', 'GET'])\ndef f(): ...", "python")
    assert [c["method"] for c in f["candidates"]] == ["GET", "POST"]


def test_python_imports_scopes_and_guards():
    src = (
        "import typing as t\nfrom typing import TYPE_CHECKING as TC\nif t.TYPE_CHECKING:\n    import a\nelse:\n    import b\nif not TC:\n    import c\nelse:\n    import d\n"
        "def f():\n    import e\n    from . import g as h\nclass K:\n    import i\nif TC is True:\n    import j\nimportlib.import_module('k.l')\n__import__('m')\n"
    )
    rows = {(r["module"] or r["names"][0]["name"]): r for r in extract.facts_of(src, "python")[0]["imports"]}
    guarded = {k for k, r in rows.items() if r["type_checking"]}
    assert guarded == {"a", "d", "j"}
    assert {k: r["scope"] for k, r in rows.items() if r["scope"] != "module"} == {"e": "function", "g": "function", "i": "class"}
    assert rows["g"]["level"] == 1 and rows["g"]["names"] == [{"name": "g", "alias": "h"}] and "delegate" in rows["e"]["tags"]
    assert rows["k.l"]["tags"] == ["dynamic", "delegate"] and rows["m"]["kind"] == "dynamic"


def test_python_symbols():
    src = '"""Doc."""\n__all__ = ["f"]\n@d\nasync def f(a, /, b: int = 1, *c, k=2, **r) -> str:\n    """Say."""\n    yield a\nclass C(B, metaclass=M):\n    x: int = 1\n    @property\n    def p(self): return self\ndef __getattr__(n): ...\n'
    f = extract.facts_of(src, "python")[0]
    s = {(x["kind"], x["name"]): x for x in f["symbols"]}
    fn = s["function", "f"]
    assert [p["kind"] for p in fn["params"]] == ["positional_only", "positional_or_keyword", "var_positional", "keyword_only", "var_keyword"]
    assert fn["params"][1] == {"name": "b", "kind": "positional_or_keyword", "type": "int", "default": "1"} and fn["returns"] == "str"
    assert fn["docstring"] == "Say." and fn["flags"] == ["async", "generator"] and fn["decorators"] == ["d"]
    assert s["class", "C"]["bases"] == ["B"] and s["method", "p"]["owner"] == "C" and s["method", "p"]["flags"] == ["property"] and s["attribute", "x"]["returns"] == "int"
    assert f["exports"] == ["f"] and "module_getattr" in f["notes"] and f["docstring_lines"] == 2


@pytest.mark.parametrize("lang", sorted(extract.EXTRACTORS))
@pytest.mark.parametrize("text", [None, "", "\x00", "é" * 10, "{" * 50, "'\"`", "/*", "import", "(" * 3000, "class\n" * 5])
def test_odd_sources_never_raise(lang, text):
    facts, status, error = extract.facts_of(text, lang)
    assert status in ("ok", "error") and (status == "ok") == (error is None) and isinstance(facts["imports"], list)


def test_broken_python_keeps_import_lines():
    f, status, _ = extract.facts_of("import os\nfrom a import b\ndef f(:\n", "python")
    assert status == "error" and f["notes"] == ["import_line:import os", "import_line:from a import b"]


def test_strings_and_comments_are_no_code():
    text = "a /* import x from 'y' */ b // c\n'// no' \"/* no */\""
    out = blank_comments(text)
    assert len(out) == len(text) and "import" not in out and "'// no'" in out and '"/* no */"' in out
    f = extract.facts_of("// import a from 'b'\nconst s = \"import c from 'd'\";\n/* require('e') */\nimport f from 'g';\n", "ts")[0]
    assert [r["module"] for r in f["imports"]] == ["g"]


def test_other_languages():
    go = extract.facts_of('package p\nimport "a/b"\nimport (\n x "c/d"\n _ "e"\n)\nfunc (t *T) M() {}\nfunc F() {}\ntype T struct{}\nvar V = 1\n', "go")[0]
    assert [(r["module"], [n["alias"] for n in r["names"]]) for r in go["imports"]] == [("a/b", []), ("c/d", ["x"]), ("e", ["_"])]
    assert {(s["kind"], s["name"]) for s in go["symbols"]} == {("method", "M"), ("function", "F"), ("struct", "T"), ("global", "V")} and go["exports"] == ["F", "T", "V"]
    java = extract.facts_of("package a.b;\nimport static x.Y.z;\nimport q.*;\n@Ann class A extends B<C> implements D, E { int f; void m() { int local = 1; } }\nenum F { G }", "java")[0]
    assert java["package"] == "a.b" and [(r["module"], r["kind"], r["tags"]) for r in java["imports"]] == [("x.Y.z", "static", []), ("q", "import", ["wildcard"])]
    assert {(r["kind"], r["object"]) for r in java["relations"]} == {("extends", "B"), ("implements", "D"), ("implements", "E"), ("annotation", "Ann")}
    assert {(s["kind"], s["name"]) for s in java["symbols"]} >= {("class", "A"), ("enum", "F")}
    rust = extract.facts_of("use a::{b, c::{self, d as e}, f::*};\npub use g;\nmod h;\npub trait T: S + Z {}\nimpl T for X { fn m(&self) {} }\n#[derive(Debug)]\nstruct X;\n", "rust")[0]
    assert [(r["module"], r["kind"], r["tags"]) for r in rust["imports"]] == [("a::b", "import", []), ("a::c", "import", []), ("a::c::d", "import", []), ("a::f", "import", ["wildcard"]), ("g", "reexport", []), ("h", "mod", [])]
    assert {(r["kind"], r["subject"], r["object"]) for r in rust["relations"]} == {("supertrait", "T", "S"), ("supertrait", "T", "Z"), ("impl", "X", "T"), ("derive", None, "Debug")}
    kt = extract.facts_of("package p\nimport a.b.C as D\nimport x.*\ndata class K(val n: Int) : Base(), I\nfun f() = Other()\nval v = 1\n", "kotlin")[0]
    assert [(r["module"], r["tags"]) for r in kt["imports"]] == [("a.b.C", []), ("x", ["wildcard"])] and {"Other"} <= set(kt["tokens"])
    assert {(s["kind"], s["name"]) for s in kt["symbols"]} >= {("class", "K"), ("function", "f"), ("property", "v")} and [r["object"] for r in kt["relations"]] == ["Base", "I"]
    rb = extract.facts_of("require 'a'\nmodule M\n  class C < D\n    include E\n    belongs_to :user\n    def self.x\n      F.go\n    end\n  end\nend\ndef top; end\n", "ruby")[0]
    assert {(s["kind"], s["name"], s["owner"]) for s in rb["symbols"]} == {("module", "M", None), ("class", "M::C", None), ("method", "x", "M::C"), ("function", "top", None)}
    assert {(r["kind"], r["object"]) for r in rb["relations"]} == {("extends", "D"), ("include", "E"), ("association:belongs_to", "user")} and {"base": "F", "attr": "go"} in rb["method_uses"]


def test_axios_configs_hold_other_objects():
    text = """axios({ headers: { url: "no", a: [1, {b: "}"}] }, url: "/api/x", method: 'post', data: f({method: "GET"}) });
axios({ "url": `/api/y` }); axios({ data: { url: "/inner" } }); // axios({ url: "/not" })"""
    facts, _, _ = extract.facts_of(text, "ts")
    assert [tuple(dict(c["meta"])[k] for k in ("method", "path")) for c in facts["candidates"]] == [("POST", "/api/x"), ("GET", "/api/y")]
