"""Node and file-index tables from facts, metrics and links; package roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import paths
from weftgraph.functions.lines import COUNTS

from .graph import degrees
from .relational import first_wins, worst_status

_NAMES = "array<string>"


def import_surfaces(links: DataFrame) -> DataFrame:
    """(path, imports_all, imports_internal, imports_external, imports_runtime, imports_runtime_internal): sorted distinct specs and targets a file."""
    s = lambda c: F.array_sort(F.collect_set(c))
    run = ~F.coalesce("type_checking", F.lit(False))
    return links.groupBy("path").agg(
        s("spec").alias("imports_all"), s("target").alias("imports_internal"), s(F.when(F.col("target").isNull(), F.col("spec"))).alias("imports_external"),
        s(F.when(run, F.col("spec"))).alias("imports_runtime"), s(F.when(run, F.col("target"))).alias("imports_runtime_internal"),
    )


def style_counts(refs: DataFrame) -> DataFrame:
    """(path, import_style_counts): how a file imports: absolute, relative, from, star, dynamic, require, reexport, wildcard, static."""
    star = F.exists("names", lambda n: n["name"] == "*") | F.array_contains("tags", "wildcard")
    kinds = {
        "absolute": (F.col("level") == 0) & ~F.col("is_from") & ~F.array_contains("tags", "dynamic"), "relative": (F.col("level") > 0) | F.col("module").rlike(r"^\.\.?/") | (F.col("kind") == "require_relative"),
        "from": F.col("is_from"), "star": star, "dynamic": F.array_contains("tags", "dynamic"), "require": F.col("kind").isin("require", "require_relative"), "reexport": F.col("kind") == "reexport", "static": F.col("kind") == "static",
    }
    g = refs.groupBy("path").agg(*[F.count_if(F.coalesce(c, F.lit(False))).cast("int").alias(k) for k, c in kinds.items()])
    return g.select("path", F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(k))]).alias("import_style_counts"))


def symbol_lists(found: DataFrame) -> DataFrame:
    """(id, functions, classes, globals, types, interfaces, enums, exports): sorted top-level names a file."""
    of = lambda *k: F.array_sort(F.array_distinct(F.transform(F.filter("symbols", lambda s: s["owner"].isNull() & s["kind"].isin(*k)), lambda s: s["name"])))
    return found.select(
        F.col("path").alias("id"), of("function").alias("functions"), of("class", "struct", "record", "object", "module").alias("classes"), of("global", "property").alias("globals"),
        of("type", "trait", "union").alias("types"), of("interface", "annotation").alias("interfaces"), of("enum").alias("enums"), "exports",
        F.filter("symbols", lambda s: s["kind"].isin("function", "method")).alias("functions_detailed"), F.filter("symbols", lambda s: s["kind"] == "class").alias("classes_detailed"),
    )


def file_index(measured: DataFrame, found: DataFrame, links: DataFrame, refs: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row a file: manifest, metrics, parse state, import surfaces and styles, content hash."""
    none = F.array().cast(_NAMES)
    f = manifest.select("path", "lang", "size", "modified", "hash")
    j = f.join(measured.drop("lang"), "path", "left").join(found.select("path", "parse_status", F.col("error").alias("error_snippet"), "package"), "path", "left")
    j = j.join(import_surfaces(links), "path", "left").join(style_counts(refs), "path", "left")
    lists = ("imports_all", "imports_internal", "imports_external", "imports_runtime", "imports_runtime_internal")
    return j.withColumns({c: F.coalesce(c, none) for c in lists}).withColumns({"file": F.col("path"), "id": F.col("path"), "eligible": F.coalesce("parse_status", F.lit("ok")) != "error"})


def stubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, file, name, parse_status): nodes for ends of edges that no node stands for."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).where("id <> ''").distinct()
    lost = ends.join(nodes.select("id"), "id", "left_anti")
    return lost.select("id", F.col("id").alias("file"), paths.basename("id").alias("name"), F.lit("missing").alias("parse_status"))


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with importers_count and dependencies_count over distinct pairs of ends, 0 for none."""
    d = degrees(edges.select("src", "dst").where("src <> dst").distinct())
    j = nodes.join(d, "id", "left")
    return j.withColumns({"importers_count": F.coalesce("in_degree", F.lit(0)), "dependencies_count": F.coalesce("out_degree", F.lit(0))}).drop("in_degree", "out_degree")


def module_guess(path: str = "id"):
    return paths.module_for_path(path)


def package_rollup(files: DataFrame, by: str = "package") -> DataFrame:
    """One row a package: summed metrics, sorted unions of names and imports, worst parse state, first file.

    ``files`` has ``by``, file, parse_status, loc, sloc, comment_lines, blank_lines, and any of the list columns.
    """
    lists = [f.name for f in files.schema if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "string"]
    sums = [c for c in COUNTS if c in files.columns]
    g = files.groupBy(by).agg(
        F.count(F.lit(1)).alias("files"), F.min("file").alias("file"), worst_status("parse_status").alias("parse_status"), *[F.sum(c).alias(c) for c in sums],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists],
    )
    return g.withColumn("comment_pct", F.round(F.try_divide("comment_lines", "loc"), 4)) if {"loc", "comment_lines"} <= set(sums) else g


def alias_maps(refs: DataFrame) -> DataFrame:
    """(path, aliases): local name to target of each file's imports, the last wins."""
    one = refs.select("path", "seq", "module", F.posexplode("names").alias("k", "n"))
    target = F.when(F.col("module").isNull(), F.col("n.name")).otherwise(F.concat("module", F.lit("."), "n.name"))
    rows = one.select("path", F.coalesce("n.alias", "n.name").alias("alias"), target.alias("target"), (-F.col("seq")).alias("a"), (-F.col("k")).alias("b"))
    last = first_wins(rows, ["path", "alias"], ["a", "b"])
    return last.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("alias", "target")))).alias("aliases"))


def alias_indexes(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alias, modules) and (module, aliases): which modules use an alias, and under which names a module goes."""
    m = alias_maps(refs).select("path", F.explode("aliases").alias("alias", "target"))
    a = m.groupBy("alias").agg(F.array_sort(F.collect_set("target")).alias("modules"))
    b = m.groupBy(F.col("target").alias("module")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return a, b


def rails_roles(found: DataFrame) -> DataFrame:
    """(file, annotation, value): the Rails role of each Ruby file by folder, and how often it uses each part of the DSL."""
    role = F.regexp_extract("path", r"(?:^|/)app/(models|controllers|helpers|jobs|mailers|channels|services)/", 1)
    a = found.where("lang = 'ruby'").select(F.col("path").alias("file"), F.lit("rails_role").alias("annotation"), F.regexp_replace(role, "s$", "").alias("value")).where("value <> ''")
    b = found.where("lang = 'ruby'").select(F.col("path").alias("file"), F.explode("notes").alias("n")).where("n LIKE 'rails:%'")
    b = b.groupBy("file", F.concat(F.lit("has_"), F.substring_index("n", ":", -1)).alias("annotation")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    return a.unionByName(b)


def discovery(manifest: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: files discovered, nodes bundled, and how many files no node stands for, by id and by file, and the smaller of both."""
    m = manifest.select(paths.to_posix("path").alias("path")).distinct()
    by_id = m.join(nodes.select(F.col("id").alias("path")).distinct(), "path", "left_anti").agg(F.count(F.lit(1)).alias("missing_by_node_id"))
    by_file = m.join(nodes.select(F.col("file").alias("path")).distinct(), "path", "left_anti").agg(F.count(F.lit(1)).alias("missing_by_file"))
    n = m.agg(F.count(F.lit(1)).alias("discovered")).crossJoin(nodes.agg(F.countDistinct("id").alias("bundled")))
    return n.crossJoin(by_id).crossJoin(by_file).withColumn("missing", F.least("missing_by_node_id", "missing_by_file"))
