"""Import surfaces of files: internal, external, standard library and third party, and totals over them."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import top_k


def import_root(spec: Column) -> Column:
    return F.substring_index(spec, ".", 1)


def is_standard(spec: Column) -> Column:
    """Whether a dotted spec belongs to Python's standard library."""
    return import_root(spec).isin(*sorted(sys.stdlib_module_names))


def own_packages(files: DataFrame, path: str = "file", ident: str = "id") -> DataFrame:
    """(package): distinct top folders of paths and first parts of dotted ids."""
    tops = files.where(F.col(path).contains("/")).select(F.substring_index(path, "/", 1).alias("package"))
    ids = files.where(~F.col(ident).contains("/")).select(F.substring_index(ident, ".", 1).alias("package"))
    return tops.union(ids).where("package <> ''").distinct()


def split_imports(files: DataFrame, own: DataFrame) -> DataFrame:
    """``files`` (id, imports_all, imports_internal, imports_external) with internal, external, stdlib and third_party and their counts.

    A given external list is trusted; otherwise external is what isn't internal, less what begins with a
    package of the repository (``own``), which is internal after all.
    """
    e = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    given = F.col("imports_external").isNotNull() & (F.size("imports_external") > 0)
    rest = files.select("id", F.explode(F.array_distinct(F.array_except(e("imports_all"), e("imports_internal")))).alias("spec")).withColumn("package", import_root(F.col("spec")))
    ours = rest.join(own.select("package").distinct(), "package", "left_semi").groupBy("id").agg(F.collect_set("spec").alias("__ours"))
    j = files.join(ours, "id", "left")
    mine = e("__ours")
    external = F.when(given, F.col("imports_external")).otherwise(F.array_except(F.array_except(e("imports_all"), e("imports_internal")), mine))
    internal = F.when(given, e("imports_internal")).otherwise(F.array_distinct(F.concat(e("imports_internal"), F.array_sort(mine))))
    j = j.withColumns({"internal": internal, "external": F.array_distinct(external)}).drop("__ours")
    j = j.withColumns({"stdlib": F.filter("external", is_standard), "third_party": F.filter("external", lambda s: ~is_standard(s))})
    return j.withColumns({f"n_{c}": F.size(c) for c in ("internal", "external", "stdlib", "third_party")})


def totals(split: DataFrame) -> DataFrame:
    names = ("internal", "external", "stdlib", "third_party")
    return split.agg(F.count(F.lit(1)).alias("files"), *[F.coalesce(F.sum(f"n_{c}"), F.lit(0)).alias(c) for c in names])


def usage(tokens: DataFrame, k: int = 20, samples: int = 5, *, file: str = "file", package: str = "package") -> DataFrame:
    """(package, import_count, file_count, sample_files): the ``k`` packages most imported, with the first ``samples`` files by name.

    Files of a package are ranked, not collected: a package that everything imports doesn't fill an array.
    """
    from pyspark.sql import Window

    by_file = tokens.groupBy(package, file).agg(F.count(F.lit(1)).alias("n"))
    sums = by_file.groupBy(package).agg(F.sum("n").alias("import_count"), F.count(F.lit(1)).alias("file_count"))
    best = top_k(sums, "import_count", k, [package])
    w = Window.partitionBy(package).orderBy(file)
    first = by_file.join(best.select(package), package, "left_semi").withColumn("r", F.row_number().over(w)).where(F.col("r") <= samples)
    named = first.groupBy(package).agg(F.array_sort(F.collect_list(file)).alias("sample_files"))
    return best.join(named, package)


def third_party_usage(split: DataFrame, k: int = 20) -> DataFrame:
    tokens = split.select("file", F.explode("third_party").alias("spec")).select("file", import_root(F.col("spec")).alias("package"))
    return usage(tokens, k)
