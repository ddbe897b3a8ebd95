from __future__ import annotations

import random

from pyspark.sql import functions as F

from weftgraph.operators import crosstalk, edges, imports, merge, relational as rel, zones


def test_first_and_last_wins_with_null_keys(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z"), (None, 4, "w")], "k string, n int, v string")
    assert {(r.k, r.v) for r in rel.first_wins(df, ["k"], ["n"]).collect()} == {("a", "y"), (None, "z")}
    assert {(r.k, r.v) for r in rel.first_wins(df, ["k"], [F.desc("n")]).collect()} == {("a", "x"), (None, "w")}
    plan = rel.first_wins(df.repartition(3), ["k"], ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_longest_prefix_equals_brute_force(spark):
    rng = random.Random(3)
    name = lambda: ".".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    known, specs = {name() for _ in range(12)}, [name() for _ in range(40)] + [None, ""]
    got = rel.longest_prefix(spark.createDataFrame([(s,) for s in specs], "spec string"), spark.createDataFrame([(k,) for k in known], "id string"), spec="spec", ident="id")
    for r in got.collect():
        parts = r.spec.split(".")
        want = max((p for p in (".".join(parts[: i + 1]) for i in range(len(parts))) if p in known), key=len, default=None)
        assert r.id == want, r.spec


def test_nearest_ancestor_and_candidates(spark):
    files = spark.createDataFrame([("a/b/c.ts",), ("a/x.ts",), ("top.ts",)], "path string")
    folders = spark.createDataFrame([("a",), ("a/b",), ("",)], "folder string")
    assert {(r.path, r.folder) for r in rel.nearest_ancestor(files, folders, path="path", folder="folder").collect()} == {("a/b/c.ts", "a/b"), ("a/x.ts", "a"), ("top.ts", "")}
    rows = spark.createDataFrame([(1, ["q", "b", "a"]), (2, ["q"]), (3, None)], "k int, c array<string>")
    hit = rel.first_candidate(rows, spark.createDataFrame([("a",), ("b",)], "id string"), key=["k"], candidates=F.col("c"), ident="id")
    assert [(r.k, r.id, r.rank) for r in hit.collect()] == [(1, "b", 1)]


def test_merge_rules(spark):
    schema = "id string, r int, functions array<string>, n_count int, label string, facts map<string,string>, classes_detailed array<string>"
    rows = [("a", 0, ["f", "g"], 5, "x", {"k": "1", "l": "1"}, ["p"]), ("a", 1, ["g", "h"], 3, None, {"k": "2"}, []), ("b", 1, None, None, "y", None, None)]
    df = spark.createDataFrame(rows, schema)
    rules = merge.node_rules(df.withColumnRenamed("r", "lang_rank"))
    assert rules == {"functions": "union", "n_count": "max", "label": "last", "facts": "overlay", "classes_detailed": "last_filled"}
    got = {r.id: r for r in rel.merged(df, ["id"], "r", rules).collect()}
    assert (got["a"].functions, got["a"].n_count, got["a"].label, got["a"].facts, got["a"].classes_detailed) == (["f", "g", "h"], 5, "x", {"l": "1", "k": "2"}, ["p"])
    assert (got["b"].functions, got["b"].label, got["b"].n_count) == ([], "y", None)
    named = spark.createDataFrame([("a", 0, [("x", 1)]), ("a", 1, [("x", 2), ("y", 3)])], "id string, r int, v array<struct<name:string,n:int>>")
    assert [tuple(x) for x in rel.merged(named, ["id"], "r", {"v": "named"}).first().v] == [("x", 1), ("y", 3)]


def test_edges_dedupe_by_language_then_sequence(spark):
    schema = "src string, dst string, kind string, subkind string, join string, candidate_kind string, seq int, spec string"
    py = spark.createDataFrame([("a", "b", None, None, None, None, 2, "second"), ("a", "b", "import", "", None, None, 1, "first"), ("a", "", "import", None, None, None, 0, "no end")], schema)
    ts = spark.createDataFrame([("a", "b", "import", None, None, None, 0, "other"), ("a", "b", "crosstalk", None, "k1", "env", 0, "c1"), ("a", "b", "crosstalk", None, "k2", "env", 0, "c2")], schema)
    got = merge.merge_edges({"ts": ts, "python": py}).collect()
    assert sorted(r.spec for r in got) == ["c1", "c2", "first"]


def test_crosstalk_equals_brute_force(spark):
    rng = random.Random(4)
    make = lambda kinds: [(f"n{rng.randrange(4)}", i, rng.choice(kinds), rng.choice(["k1", "k2", "", None]), rng.choice([None, 0.4, 0.5, 0.9])) for i in range(25)]
    a, b = make(["env", "http"]), make(["call"])
    cols = "node_id string, seq int, kind string, join string, confidence double"
    frame = lambda rows: spark.createDataFrame(rows, cols).withColumns({"line": F.lit(1), "col": F.lit(0), "syntax": F.lit("s")})
    sure = lambda c: 1.0 if c is None else c
    want, pairs, kept = {}, 0, 0
    for x in a:
        for y in b:
            if x[3] and x[3] == y[3]:
                pairs += 1
                if min(sure(x[4]), sure(y[4])) >= 0.5:
                    kept += 1
                    want.setdefault((x[0], y[0], x[3], x[2]), min(sure(x[4]), sure(y[4])))
    got = crosstalk.edges(frame(a), frame(b)).collect()
    assert {(r.src, r.dst, r.join, r.candidate_kind): r.confidence for r in got} == want and len(got) == len(want)
    stats = crosstalk.statistics(frame(a), frame(b)).collect()
    assert (sum(r.pairs for r in stats), sum(r.kept_pairs for r in stats)) == (pairs, kept)


def test_package_edges_collapse(spark):
    rows = [("c", "pkg/__init__.py"), ("c", "pkg/sub/x.py"), ("d", "pkg/__init__.py"), ("c", "__init__.py"), ("d", "other/x.py")]
    got = edges.collapse_package_edges(spark.createDataFrame(rows, "src string, dst string")).collect()
    assert {tuple(r) for r in got} == {("c", "pkg/sub/x.py"), ("d", "pkg/__init__.py"), ("c", "__init__.py"), ("d", "other/x.py")}


def test_strict_and_soft_edges(spark):
    scope = spark.createDataFrame([("app/main.py",), ("lib/core/engine.py",), ("lib/core/deep/more.py",), ("lib/only.py",), ("x/twice.py",), ("y/twice.py",)], "id string")
    imp = spark.createDataFrame([("app/main.py", "lib/only.py"), ("app/main.py", "lib.core"), ("app/main.py", "gone.engine"), ("app/main.py", "gone.twice"), ("gone.py", "lib/only.py"), ("app/main.py", None)], "src string, token string")
    assert {(r.src, r.dst) for r in edges.strict_edges(imp, scope).collect()} == {("app/main.py", "lib/only.py")}
    got = {(r.dst, r.inferred) for r in edges.soft_edges(imp, scope).collect()}
    assert got == {("lib/only.py", False), ("lib/core/engine.py", True)}


def test_rows_meet_their_kth_reference(spark):
    rows = spark.createDataFrame([("f", 1, "import  a"), ("f", 2, "import a"), ("f", 3, "import b")], "path string, pos int, text string")
    refs = spark.createDataFrame([("f", 0, "import a", "a1"), ("f", 5, "import a", "a2")], "path string, seq int, raw string, module string").withColumns({"level": F.lit(0), "type_checking": F.lit(False), "scope": F.lit("module"), "tags": F.array(F.lit("t")), "line": F.lit(1)})
    assert [(r.pos, r.module) for r in edges.annotate_rows(rows, refs).orderBy("pos").collect()] == [(1, "a1"), (2, "a2"), (3, None)]


def test_import_split(spark):
    cols = "id string, file string, imports_all array<string>, imports_internal array<string>, imports_external array<string>"
    f = spark.createDataFrame([("pkg/a.py", "pkg/a.py", ["os.path", "requests", "pkg.gone", "pkg.b"], ["pkg.b"], None), ("pkg/b.py", "pkg/b.py", ["json"], None, ["json", "numpy.x"]), ("c.py", "c.py", None, None, None)], cols)
    got = {r.id: r for r in imports.split_imports(f, imports.own_packages(f)).collect()}
    a, b, c = got["pkg/a.py"], got["pkg/b.py"], got["c.py"]
    assert (sorted(a.internal), a.external, a.stdlib, a.third_party) == (["pkg.b", "pkg.gone"], ["os.path", "requests"], ["os.path"], ["requests"])
    assert (b.stdlib, b.third_party, c.n_external) == (["json"], ["numpy.x"], 0)
    assert imports.totals(imports.split_imports(f, imports.own_packages(f))).first().third_party == 2


def test_zone_of_root_and_packages(spark):
    n = spark.createDataFrame([("a.py",), ("p/__init__.py",), ("p/x.py",), ("p/q/y.py",)], "id string").withColumn("file", F.col("id"))
    z = {r.zone_id: r for r in zones.build(n).collect()}
    assert set(z) == {"<root>", "p", "p.q"} and z["p"].parent_zone_id == "<root>" and z["p.q"].parent_zone_id == "p" and z["<root>"].parent_zone_id is None
    assert z["p"].n == 2 and (z["p"].footprint_columns, z["p"].footprint_lanes) == (2, 1)
    assert zones.build(n, least_files=2).count() == 1


def test_coverage_and_sets(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (9,)], "k int")
    assert tuple(rel.coverage(a, b, "k").first()) == (2, 1, 1, 0.5)
    assert rel.coverage(a.limit(0), b, "k").first().ratio is None
    assert {r.k for r in rel.upsert_covered(a, b, "k").collect()} == {1, 2, 9}
    assert [r.k for r in rel.missing_from(a.where("k = 1"), b, ["k"]).collect()] == [1]
