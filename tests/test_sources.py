from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tests import minirepo
from weftgraph.operators import seeds
from weftgraph.sources import settings, stores, tree


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return minirepo.write(tmp_path_factory.mktemp("tree"))


def test_tree_lists_and_prunes(spark, root):
    df = tree.read_tree(spark, root, maxPartitionBytes="2000")
    rows = {r.path: r for r in df.collect()}
    assert set(rows) == {p for p in minirepo.FILES if not p.startswith("node_modules/")}
    assert all(rows[p].content == minirepo.FILES[p] for p in rows) and rows["pkg/sub/__init__.py"].content == ""
    assert df.rdd.getNumPartitions() > 1


def test_tree_takes_over_filters(spark, root):
    df = tree.read_tree(spark, root)
    py = df.where((F.col("lang") == "python") & (F.col("size") > 0)).select("path")
    assert {r.path for r in py.collect()} == {p for p, t in minirepo.FILES.items() if p.endswith(".py") and t}
    assert tree.read_tree(spark, root, content="false").where("content IS NOT NULL").count() == 0
    assert {r.path for r in tree.read_tree(spark, root, include="pkg/*", exclude="*/sub/*").select("path").collect()} == {p for p in minirepo.FILES if p.startswith("pkg/") and "/sub/" not in p}
    assert tree.read_tree(spark, root, maxBytes="0").where("size > 0").count() == 0


def test_languages_agree_in_both_worlds(spark):
    names = ["a.py", "b/Gemfile", "x.TSX", "go.mod", ".bashrc", "noext", "c.h", "q.kts", "config.ru", "d.tar.gz"]
    df = spark.createDataFrame([(n,) for n in names], "path string").select("path", tree.language_column("path").alias("l"))
    assert {r.path: r.l for r in df.collect()} == {n: tree.language(n.rpartition("/")[2]) for n in names}


def test_buckets(spark):
    df = spark.createDataFrame([("a.py", None), ("b.mjs", None), ("../c.py", None), (None, "python"), ("d", "kotlin"), ("e.md", "markdown"), ("/abs.py", None)], "path string, lang string")
    assert {r.bucket: r.n for r in tree.bucket_counts(df).collect()} == {"python": 1, "ts": 1, "outside_root": 2, "missing_path": 1, "kotlin": 1, "non_code": 1}


def test_package_chain_and_roots(spark):
    df = spark.createDataFrame([("a/__init__.py",), ("a/b/__init__.py",), ("x/y/__init__.py",)], "path string")
    assert {r.folder for r in tree.package_chain(df).collect()} == {"a", "a/b"}
    many = [(f"{top}/{i}.py", "python") for top, n in (("src", 10), ("zeta", 30), ("app", 9)) for i in range(n)]
    df = spark.createDataFrame(many, "path string, lang string")
    assert [r.root for r in tree.source_roots(df).orderBy("rank").collect()] == ["src"]
    assert [r.root for r in tree.source_roots(df.where("path NOT LIKE 'src/%'")).orderBy("rank").collect()] == ["zeta"]


def test_settings(tmp_path, monkeypatch):
    monkeypatch.delenv(settings.VARIABLE, raising=False)
    assert settings.load(tmp_path) == settings.Settings().checked()
    (tmp_path / "pyproject.toml").write_text("[tool.weftgraph]\nmode = 'zones'\nzoom = 99\n")
    assert (settings.load(tmp_path).mode, settings.load(tmp_path).zoom) == ("zones", 8.0)
    (tmp_path / settings.FILE).write_text("edge_policy = 'nonsense'\nmax_file_bytes = -1\nsource_roots = ['lib/']\nunknown = 1\n")
    s = settings.load(tmp_path)
    assert (s.edge_policy, s.max_file_bytes, s.source_roots, s.mode) == ("strict", 2_000_000, ("lib",), "classic")
    other = tmp_path / "o.toml"
    other.write_text("[weftgraph]\nclone_lines = 1\n")
    monkeypatch.setenv(settings.VARIABLE, str(other))
    assert settings.load(tmp_path).clone_lines == 2


def test_stores(spark, tmp_path):
    d = str(tmp_path)
    df = spark.createDataFrame([(1, "a", ["x"]), (2, None, None)], "i int, s string, v array<string>")
    stores.save_tables({"t": df}, d)
    assert set(stores.load_tables(spark, d, ["t", "gone"])) == {"t"} and stores.first_existing(spark, [d], ["gone", "t"]) == f"{d}/t"
    stores.write_ndjson(df, f"{d}/n")
    assert {r.value for r in spark.read.text(f"{d}/n").collect()} == {'{"i":1,"s":"a","v":["x"]}', '{"i":2}'}
    stores.write_csv([df, spark.createDataFrame([(3, 1.5)], "i int, w double")], f"{d}/c")
    assert set(spark.read.csv(f"{d}/c", header=True).columns) == {"i", "s", "v", "w"}
    (tmp_path / "m.json").write_text(json.dumps({"files": [{"path": "a.py", "lang": "python"}, {"rel_posix": "b.ts"}]}))
    (tmp_path / "l.json").write_text(json.dumps([{"file": "c.go", "language": "go"}]))
    assert {tuple(r) for r in stores.read_manifest(spark, f"{d}/m.json").collect()} == {("a.py", "python"), ("b.ts", None)}
    assert [tuple(r) for r in stores.read_manifest(spark, f"{d}/l.json").collect()] == [("c.go", "go")]
    (tmp_path / "bad.json").write_text("{oops")
    good, bad = stores.read_documents(spark, [f"{d}/bad.json"], "a string")
    assert good.count() == 0 and bad.count() == 1
    assert stores.with_columns_of(df, "i long, extra string").dtypes == [("i", "bigint"), ("extra", "string")]
    tagged = df.withColumn("schema", F.lit("v1"))
    assert stores.require_schema(tagged, "schema", "v1").count() == 2
    with pytest.raises(Exception, match="unexpected schema"):
        stores.require_schema(tagged, "schema", "v2").collect()
    stores.write_document({"b": 1}, f"{d}/doc.json")
    assert json.loads((tmp_path / "doc.json").read_text()) == {"b": 1} and stores.unique_path(f"{d}/doc.json") == f"{d}/doc-2.json"
    calls = []
    make = lambda: calls.append(1) or df
    for _ in range(2):
        assert stores.cached(spark, d, "key", make).count() == 2
    assert len(calls) == 1


def test_content_key_ignores_order(spark):
    rows = [("a", 1, None), ("b", 2, None)]
    key = lambda r: stores.content_key(spark.createDataFrame(r, "path string, size long, modified timestamp"), "m")
    assert key(rows) == key(rows[::-1]) != key(rows[:1])


def test_seed_ranking_merges_evidence(spark):
    rows = [("f", "f", None, "weak", 0.5, 9, ["z"], "s"), ("f", "f", None, "strong", 0.9, 3, ["b", "a"], "s"), ("g", None, None, "lost", 1.0, 1, ["x"], "s")]
    df = spark.createDataFrame(rows, "id string, file string, symbol string, kind string, confidence double, priority int, evidence array<string>, source string")
    assert [(r.id, r.kind, r.confidence, r.evidence) for r in seeds.ranked(df).collect()] == [("f", "strong", 0.9, ["a", "b", "z"])]
