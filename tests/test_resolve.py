"""Resolution rules that the fixture tree doesn't reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import extract
from weftgraph.operators import deadcode, edges, merge, nodes, resolve
from weftgraph.plans import analysis


def tables(spark, files):
    df = spark.createDataFrame([(p, analysis.tree.language(p.rpartition("/")[2]), t) for p, t in files.items()], "path string, lang string, content string")
    found = extract.facts(df.where(F.col("lang").isin(*analysis.tree.CODE)))
    return df, found, extract.import_refs(found), extract.symbols(found)


def hits(links):
    return {(r.path, r.spec, r.target) for r in links.collect() if r.target}


def test_source_roots_are_stripped_and_the_first_file_keeps_an_id(spark):
    df, _, refs, _ = tables(spark, {"src/pkg/a.py": "import pkg.b.c", "src/pkg/b.py": "", "lib/x.py": "", "pkg/b.py": "", "src/__init__.py": ""})
    m = resolve.python_modules(df, ["src"])
    assert {(r.module, r.path) for r in m.collect()} == {("pkg.a", "src/pkg/a.py"), ("pkg.b", "pkg/b.py"), ("lib.x", "lib/x.py")}
    assert hits(resolve.python(refs, m)) == {("src/pkg/a.py", "pkg.b.c", "pkg/b.py")}


def test_relative_imports_that_climb_out_meet_nothing(spark):
    df, _, refs, _ = tables(spark, {"p/a.py": "from ... import b\nfrom .b import c", "p/b.py": "", "b.py": ""})
    assert hits(resolve.python(refs, resolve.python_modules(df, []))) == {("p/a.py", "p.b", "p/b.py"), ("p/a.py", "p.b.c", "p/b.py")}


def test_cascade(spark):
    df, _, _, _ = tables(spark, {"p/a.py": "", "p/q/__init__.py": "", "p/q/b.py": ""})
    t = spark.createDataFrame([("p.a.f:x", "p.q.b"), ("b", "p.q.z"), ("p/a.py", "p.q.b"), ("gone", "p.q.b")], "token string, consumer string")
    m = resolve.python_modules(df, [])
    assert {(r.token, r.target) for r in resolve.python_cascade(t, m, consumer_prefix=True).collect()} == {("p.a.f:x", "p/a.py"), ("b", "p/q/b.py"), ("p/a.py", "p/a.py")}
    assert {(r.token, r.target) for r in resolve.python_cascade(t, m).collect()} == {("p.a.f:x", "p/a.py"), ("p/a.py", "p/a.py")}


def test_facades_give_soft_links(spark):
    df, found, refs, symbols = tables(spark, {"app.py": "from pkg import Thing, mod", "pkg/__init__.py": "def __getattr__(n): ...", "pkg/impl.py": "class Thing: ...", "pkg/mod.py": "", "pkg/export_x.py": ""})
    m = resolve.python_modules(df, [])
    facades = found.where(F.array_contains("notes", "module_getattr")).select("path")
    got = {(r.spec, r.target, r.strength) for r in resolve.hard_and_soft(resolve.python(refs, m), symbols, m, facades, ("export_*.py",)).collect()}
    assert {("pkg.Thing", "pkg/impl.py", "soft"), ("pkg.Thing", "pkg/export_x.py", "soft"), ("pkg.mod", "pkg/mod.py", "hard")} <= got
    off = resolve.hard_and_soft(resolve.python(refs, m), symbols, m, facades, None)
    assert not any(r.target == "pkg/export_x.py" for r in off.collect())


def test_configs_extend_each_other(spark):
    base = '{"compilerOptions": {"baseUrl": "./src", "paths": {"@a/*": ["a/*"], "@b": ["b/index.ts"]}}}'
    child = '{"extends": "../tsconfig.base", "compilerOptions": {"paths": {"@a/*": ["other/*"]}}}'
    files = {"tsconfig.base.json": base, "web/tsconfig.json": child, "web/x.ts": "import '@a/q';\nimport '@b';\nimport 'plain';\nimport 'https://x.y/z.js';\nimport './nope';", "src/other/q.ts": "", "src/a/q.ts": "", "src/b/index.ts": ""}
    df, _, refs, _ = tables(spark, files)
    links = resolve.web(refs, df.select("path"), resolve.effective_configs(resolve.ts_configs(df)))
    assert hits(links) == {("web/x.ts", "@a/q", "src/other/q.ts"), ("web/x.ts", "@b", "src/b/index.ts")}
    assert {(r.spec, r.state, r.reason) for r in links.collect() if not r.target} == {("plain", "external", "bare"), ("https://x.y/z.js", "external", "url"), ("./nope", "unresolved", "relative")}


def test_aliases_are_for_bare_specs_and_the_root_goes_first(spark):
    config = '{"compilerOptions": {"baseUrl": ".", "paths": {"*": ["src/*"], "~/*": ["%s/*"]}}}'
    files = {"tsconfig.json": config % "one", "app/tsconfig.json": config % "two", "app/x.ts": "import './foo';\nimport '/foo';\nimport 'foo';\nimport '~/a';\nimport '~/b';", "src/foo.ts": "", "one/a.ts": "", "app/two/a.ts": "", "app/two/b.ts": ""}
    df, _, refs, _ = tables(spark, files)
    links = resolve.web(refs, df.select("path"), resolve.effective_configs(resolve.ts_configs(df)))
    assert hits(links) == {("app/x.ts", "foo", "src/foo.ts"), ("app/x.ts", "~/a", "one/a.ts"), ("app/x.ts", "~/b", "app/two/b.ts")}


def test_configs_may_extend_in_circles(spark):
    text = '{"extends": "./%s.json", "compilerOptions": {"paths": {"%s": ["x"]}}}'
    files = {"tsconfig.a.json": text % ("tsconfig.b", "a"), "tsconfig.b.json": text % ("tsconfig.a", "b"), "tsconfig.json": text % ("tsconfig.a", "c"), "tsconfig.d.json": text % ("tsconfig.d", "d"), "tsconfig.e.json": text % ("tsconfig.gone", "e")}
    df, _, _, _ = tables(spark, files)
    got = {r.config: sorted(p.pattern for p in r.paths) for r in resolve.effective_configs(resolve.ts_configs(df)).collect()}
    assert got == {"tsconfig.a.json": ["a", "b"], "tsconfig.b.json": ["a", "b"], "tsconfig.json": ["a", "b", "c"], "tsconfig.d.json": ["d"], "tsconfig.e.json": ["e"]}


def test_suffixed_specs_stand_for_themselves(spark):
    df, _, refs, _ = tables(spark, {"a.ts": "import './b.service';\nimport './c.js';\nimport './d';\nimport '/e';", "b.service.ts": "", "c.tsx": "", "d/index.jsx": "", "e.ts": ""})
    assert hits(resolve.web(refs, df.select("path"))) == {("a.ts", "./c.js", "c.tsx"), ("a.ts", "./d", "d/index.jsx"), ("a.ts", "/e", "e.ts")}


def test_the_main_go_module_covers_most(spark):
    df, _, refs, _ = tables(spark, {"go.mod": "module a.b/root\n", "x/go.mod": "module a.b/x\n", "x/p/1.go": "package p", "x/p/doc.go": "package p", "x/q/2.go": 'package q\nimport "a.b/x/p/deep"', "top.go": "package main"})
    assert tuple(resolve.main_go_module(df).first()) == ("", "a.b/root")
    packages = resolve.go_packages(df, resolve.go_modules(df))
    assert {(r.package_id, r.representative) for r in packages.collect()} == {("a.b/x/p", "x/p/doc.go"), ("a.b/x/q", "x/q/2.go"), ("a.b/root", "top.go")}
    assert hits(resolve.go(refs, packages)) == {("x/q/2.go", "a.b/x/p/deep", "x/p/doc.go")}


def test_types_that_two_files_declare(spark):
    _, _, _, symbols = tables(spark, {"a/T.java": "package p; class T {}", "b/T.java": "package p; class T {}", "U.java": "package p; class U {}"})
    assert [(r.fq, r.files) for r in resolve.collisions(symbols, "java").collect()] == [("p.T", ["a/T.java", "b/T.java"])]
    assert {(r.fq, r.path) for r in resolve.declared_types(symbols, "java").collect()} == {("p.T", "a/T.java"), ("p.U", "U.java")}


def test_symbol_links_are_capped_in_order(spark):
    files = {f"f{i:02}.kt": f"package p\nclass Name{i:02}" for i in range(30)} | {"use.kt": "package p\nfun f() { " + "; ".join(f"Name{i:02}()" for i in range(30)) + " }"}
    _, found, _, symbols = tables(spark, files)
    tokens = found.select("path", "package", F.explode("tokens").alias("token"))
    got = resolve.symbol_links(tokens, symbols).where("path = 'use.kt'").collect()
    assert sorted(r.target for r in got) == [f"f{i:02}.kt" for i in range(25)]


def test_ruby_prefers_the_provider_of_its_own_root(spark):
    files = {"one/spec/spec_helper.rb": "", "two/spec/spec_helper.rb": "", "two/spec/deep/a_spec.rb": "require 'spec_helper'\nrequire 'rack'\nrequire 'rack/protection'", "one/lib/rack/protection.rb": "", "two/lib/rack.rb": "", "m.rb": "require 'my_gem/my_class'", "x/other.rb": "class MyGem::MyClass\nend"}
    df, _, refs, symbols = tables(spark, files)
    links = resolve.ruby(refs, resolve.ruby_providers(df), analysis.ruby_types(symbols))
    assert hits(links) == {("two/spec/deep/a_spec.rb", "spec_helper", "two/spec/spec_helper.rb"), ("two/spec/deep/a_spec.rb", "rack/protection", "one/lib/rack/protection.rb"), ("m.rb", "my_gem/my_class", "x/other.rb")}
    assert {(r.spec, r.reason) for r in links.collect() if not r.target} == {("rack", "stdlib_or_gem")}


def test_aliases(spark):
    _, _, refs, _ = tables(spark, {"a.py": "import numpy as np\nfrom x import y as np\nimport json", "b.py": "import numpy as num"})
    assert {r.path: r.aliases for r in nodes.alias_maps(refs).collect()} == {"a.py": {"np": "x.y", "json": "json"}, "b.py": {"num": "numpy"}}
    a, b = nodes.alias_indexes(refs)
    assert {r.alias: r.modules for r in a.collect()} == {"np": ["x.y"], "json": ["json"], "num": ["numpy"]}
    assert {r.module: r.aliases for r in b.collect()}["numpy"] == ["num"]


def test_credits_by_attribute_star_and_class(spark):
    files = {"lib.py": "def used(): ...\ndef attr(): ...\ndef dead(): ...\nclass K:\n    def go(self): ...\n_private = 1\n", "m.py": "import lib as l\nfrom lib import used, K\nk = K()\nk.go()\nl.attr()\n", "pkg/__init__.py": "", "pkg/all.py": "def any(): ...", "s.py": "from pkg.all import *"}
    df, found, refs, symbols = tables(spark, files)
    links = resolve.python(refs, resolve.python_modules(df, []))
    lost = deadcode.unused_names(found, symbols, deadcode.credits(found, links), deadcode.starred(links, refs)).collect()
    assert {(r.path, r.name) for r in lost} == {("lib.py", "dead")}
    assert {(r.path, r.name) for r in deadcode.unused_imports(found).collect()} == {("m.py", "used")}


def test_external_edges_and_provenance(spark):
    df, _, refs, _ = tables(spark, {"a.py": "import os\nimport b\nimport thing.x", "b.py": ""})
    e = edges.from_links(resolve.python(refs, resolve.python_modules(df, [])), "python", external=True)
    from weftgraph.operators.imports import is_standard

    got = {(r.dst, r.provenance) for r in edges.provenance(e, is_standard(F.col("spec"))).collect()}
    assert got == {("ext::os", "stdlib"), ("b.py", "local"), ("ext::thing.x", "third_party")}
    stub = nodes.stubs(df.select(F.col("path").alias("id")), e)
    assert {r.id for r in stub.collect()} == {"ext::os", "ext::thing.x"}
    assert {(r.src, r.dst) for r in edges.bundle_direction(e).where("dst = 'a.py'").collect()} == {("b.py", "a.py"), ("ext::os", "a.py"), ("ext::thing.x", "a.py")}


def test_rows_infer_edges_that_are_missing(spark):
    rows = spark.createDataFrame([("a", "m.x"), ("a", "a"), ("b", "m.x")], "path string, module string")
    aliases = spark.createDataFrame([("m.x", "x2"), ("m.x", "x1"), ("a", "a")], "alias string, id string")
    have = spark.createDataFrame([("b", "x1")], "src string, dst string")
    assert [tuple(r) for r in edges.infer_from_rows(rows, aliases, have).collect()] == [("a", "x1")]


def test_rails_roles_and_schema_tags(spark):
    _, found, _, _ = tables(spark, {"app/models/user.rb": "class User\n  has_many :posts\n  has_many :tags\n  validates :name\nend\n"})
    assert {(r.annotation, r.value) for r in nodes.rails_roles(found).collect()} == {("rails_role", "model"), ("has_has_many", "2"), ("has_validates", "1")}
    tags = spark.createDataFrame([("nodefacts@v1.9",), ("nodefacts@v1.10",), (None,)], "schema string")
    assert merge.latest_schema(tags).first()[0] == "nodefacts@v1.10"


def test_index_back_fill(spark):
    a, b = spark.createDataFrame([("x", 1)], "file string, n int"), spark.createDataFrame([("x", 2), ("y", 3)], "file string, n int")
    assert {(r.file, r.n) for r in merge.larger_index(a, b).collect()} == {("x", 1), ("y", 3)}
    assert {(r.file, r.n) for r in merge.merge_files({"python": a, "ts": b}, last=True).collect()} == {("x", 2), ("y", 3)}
