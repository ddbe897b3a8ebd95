from __future__ import annotations

import posixpath
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import keys, paths


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


@pytest.mark.parametrize(
    "url,want",
    [("", "/"), ("api/x", "/api/x"), ("https://h.com", "/"), ("https://h.com/a//b/?q#f", "/a/b"), ("/a/", "/a"), ("/", "/"), ("?x", "/"), ("//a//b//", "/a/b")],
)
def test_route_path(spark, url, want):
    assert one(spark, keys.route_path(F.lit(url))) == want


@pytest.mark.parametrize(
    "path,want",
    [("/a/12/b", "/a/:id/b"), ("/u/{x}/<y>/:z", "/u/:id/:id/:id"), ("/h/deadbeefdead", "/h/:id"), ("/h/deadbeef", "/h/deadbeef"), ("/8c2e9a1e-1111-4222-8333-abcdefabcdef", "/:id"), ("/v1/x", "/v1/x"), ("/", "/")],
)
def test_route_template(spark, path, want):
    assert one(spark, keys.route_template(F.lit(path))) == want


def test_keys(spark):
    assert one(spark, keys.http_key(F.lit("get"), F.lit("/a/1"))) == "http:GET:/a/:id" and one(spark, keys.http_key(F.lit("g3t"), F.lit("x"))) == "http:*:/x"
    op = one(spark, keys.graphql_operation(F.lit("mutation  Do { x }")))
    assert (op.op_type, op.name, op.join_part) == ("mutation", "Do", "Do")
    assert one(spark, keys.graphql_operation(F.lit("{ x }"))).join_part.startswith("sha1:")
    assert one(spark, keys.route_path(F.lit("/a/../b"), strict=True)) is None


def test_fold_dots_equals_normpath(spark):
    rng = random.Random(1)
    given = ["/".join(rng.choice(["a", "b", ".", "..", ""]) for _ in range(rng.randrange(1, 7))) for _ in range(200)]
    df = spark.createDataFrame([(g,) for g in given], "p string")
    for r in df.select("p", paths.fold_dots("p").alias("v")).collect():
        want = posixpath.normpath(r.p) if r.p else ""
        want = "/" + want.lstrip("/") if want.startswith("/") else want
        assert r.v == ("" if want == "." else want), r.p


@pytest.mark.parametrize(
    "token,consumer,package,want",
    [("x.y", "a.b", False, "x.y"), (".x", "a.b", False, "a.x"), ("..x", "a.b.c", False, "a.x"), (".", "a.b", False, "a"), (".x", "a.b", True, "a.b.x"), ("...x", "a.b", False, None), (".x", "a", False, "a.x")],
)
def test_absolute_module(spark, token, consumer, package, want):
    assert one(spark, paths.absolute_module(F.lit(token), F.lit(consumer), F.lit(package))) == want


@pytest.mark.parametrize("path,want", [("src/lib.rs", "crate"), ("x/src/main.rs", "crate"), ("src/a/b.rs", "crate::a::b"), ("src/a/mod.rs", "crate::a"), ("other/a.rs", None)])
def test_rust_module(spark, path, want):
    assert one(spark, paths.rust_module_of(F.lit(path))) == want


def test_candidates_of_web_specs(spark):
    assert one(spark, paths.web_candidates(F.lit("a/b.js"))) == ["a/b.js", "a/b.ts", "a/b.tsx", "a/b/index.ts", "a/b/index.tsx"]
    assert len(one(spark, paths.web_candidates(F.lit("a/b")))) == 13 and one(spark, paths.web_candidates(F.lit("a/b.service"))) == ["a/b.service"]
    assert one(spark, paths.join_relative(F.lit("web/src/a.ts"), F.lit("../x/y"))) == "web/x/y"


def test_small_ones(spark):
    assert one(spark, paths.camelize(F.lit("user_admin/post_item"))) == "UserAdmin::PostItem"
    assert [one(spark, paths.association_class(F.lit(x))) for x in ("user", "blog_posts", "categories", "boxes", "glass")] == ["User", "BlogPost", "Category", "Box", "Glass"]
    assert one(spark, paths.star_capture(F.lit("@lib/a/b"), "@lib/*")) == "a/b" and one(spark, paths.star_capture(F.lit("x"), "@lib/*")) is None
    assert one(spark, paths.prefixes(F.lit("a.b.c"))) == ["a.b.c", "a.b", "a"] and one(spark, paths.shortened(F.lit("a.b:c"))) == ["a.b", "a"]
    assert one(spark, paths.common_prefix_length(F.split(F.lit("a/b/c"), "/"), F.split(F.lit("a/b/d/e"), "/"))) == 2
    assert one(spark, paths.matches_glob(F.lit("a/b/export_x.py"), ["*export_*.py"])) and not one(spark, paths.matches_glob(F.lit("a"), []))
    assert one(spark, paths.int_or(F.lit("x"), 7)) == 7 and one(spark, paths.file_id(F.lit("a.b.c"))) == "a/b/c.py" and one(spark, paths.module_id(F.lit("a/b/__init__.py"))) == "a.b"
