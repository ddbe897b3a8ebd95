"""Dead code: modules that no root reaches, and names that nothing refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import adjacency, reachable


def credits(found: DataFrame, links: DataFrame) -> DataFrame:
    """(provider, name): names that another file takes from a provider, by from-import or as an attribute of an imported module.

    ``links`` (path, seq, spec, target) are the resolved imports; ``found`` are the facts.
    """
    hit = links.where("target IS NOT NULL").select("path", "spec", F.col("target").alias("provider")).distinct()
    # a.b.name that met a.b: name is credited
    by_name = hit.select("provider", F.substring_index("spec", ".", -1).alias("name"))
    local = found.select("path", F.explode("local_imports").alias("i")).select("path", F.col("i.name").alias("base"), F.concat_ws(".", F.col("i.module"), F.col("i.attr")).alias("tail"))
    uses = found.select("path", F.explode("uses").alias("u")).select("path", "u.base", F.col("u.attr").alias("name"))
    tail = hit.select("path", "provider", F.substring_index("spec", ".", -1).alias("leaf"))
    by_attr = uses.join(local, ["path", "base"]).withColumn("leaf", F.substring_index("tail", ".", -1)).join(tail, ["path", "leaf"]).select("provider", "name")
    dotted = uses.withColumn("leaf", F.substring_index("base", ".", -1)).join(tail, ["path", "leaf"]).select("provider", "name")
    methods = found.select("path", F.explode("method_uses").alias("m")).select("path", F.substring_index("m.base", ".", -1).alias("leaf"))
    by_class = methods.join(tail, ["path", "leaf"]).select("provider", F.col("leaf").alias("name"))
    return by_name.union(by_attr).union(dotted).union(by_class).where("name <> '' AND name <> '*'").distinct()


def starred(links: DataFrame, refs: DataFrame) -> DataFrame:
    """(provider): files of which someone imports everything."""
    stars = refs.where("is_from").where(F.exists("names", lambda n: n["name"] == "*")).select("path", "seq")
    return links.where("target IS NOT NULL").join(stars, ["path", "seq"], "left_semi").select(F.col("target").alias("provider")).distinct()


def unused_names(found: DataFrame, symbols: DataFrame, credit: DataFrame, all_of: DataFrame | None = None) -> DataFrame:
    """(path, kind, name, line, col): top-level functions, classes and variables that are neither referred to, exported nor credited.

    Variables that begin with an underscore are left out.
    """
    defs = symbols.where("lang = 'python' AND owner IS NULL AND kind IN ('function', 'class', 'global')").select("path", "kind", "name", "line", "col")
    defs = defs.groupBy("path", "kind", "name").agg(F.max("line").alias("line"), F.max_by("col", "line").alias("col")).where("NOT (kind = 'global' AND name LIKE '\\\\_%')")
    live = found.select("path", F.explode(F.array_distinct(F.concat("refs", "exports", "class_uses"))).alias("name"))
    out = defs.join(live, ["path", "name"], "left_anti").join(credit.select(F.col("provider").alias("path"), "name"), ["path", "name"], "left_anti")
    return out if all_of is None else out.join(all_of.select(F.col("provider").alias("path")), "path", "left_anti")


def unused_imports(found: DataFrame) -> DataFrame:
    """(path, name, line, col): module-level imports whose local name nothing refers to; being exported doesn't save one."""
    py = found.where("lang = 'python' AND parse_status = 'ok'")
    local = py.select("path", F.explode("local_imports").alias("i")).select("path", "i.name", "i.line", "i.col").where("name <> '*'")
    refs = py.select("path", F.explode("refs").alias("name"))
    return local.join(refs, ["path", "name"], "left_anti").groupBy("path", "name").agg(F.max("line").alias("line"), F.max_by("col", "line").alias("col"))


def roots_of(files: DataFrame, seeds: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(id): seeds (id), main files, and ``extra``; all files where there is none of them."""
    mains = files.where(F.col("path").rlike(r"(^|/)(__main__|main)\.py$")).select(F.col("path").alias("id"))
    known = files.select(F.col("path").alias("id"))
    r = seeds.select("id").union(mains)
    if extra:
        r = r.union(known.where(F.col("id").isin(*extra)))
    r = r.distinct().join(known, "id", "left_semi")
    none = r.agg(F.count(F.lit(1)).alias("n"))
    return r.union(known.crossJoin(none).where("n = 0").select("id"))


def dead_modules(files: DataFrame, edges: DataFrame, roots: DataFrame, runtime: DataFrame | None = None) -> DataFrame:
    """(path): files that no root reaches along imports, that none imports, and that ``runtime`` (id) doesn't list."""
    inner = adjacency(edges)
    live = reachable(inner, roots)
    out = files.select("path").distinct().join(live.select(F.col("id").alias("path")), "path", "left_anti").join(inner.select(F.col("dst").alias("path")).distinct(), "path", "left_anti")
    return out if runtime is None else out.join(runtime.select(F.col("id").alias("path")), "path", "left_anti")


def report(files: DataFrame, dead: DataFrame, names: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, is_potentially_dead, unused_functions, unused_classes, unused_vars, unused_imports): one row a file, names sorted."""
    of = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("name", "line", "col"))))
    n = names.groupBy("path").agg(of("function").alias("unused_functions"), of("class").alias("unused_classes"), of("global").alias("unused_vars"))
    i = imports.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("name", "line", "col"))).alias("unused_imports"))
    none = F.array().cast("array<struct<name:string,line:int,col:int>>")
    j = files.select("path").distinct().join(dead.withColumn("d", F.lit(True)), "path", "left").join(n, "path", "left").join(i, "path", "left")
    return j.select("path", F.coalesce("d", F.lit(False)).alias("is_potentially_dead"), *[F.coalesce(c, none).alias(c) for c in ("unused_functions", "unused_classes", "unused_vars", "unused_imports")])
