"""Aggregates of the summary: sizes, hotspots, parse states, API surface, environment, contracts, tests, risk, cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.lines import COUNTS

from .graph import degrees
from .relational import counted, top_k

SECRET = "key|secret|password|token|credential|private"
_TEST_NAME = r"test_|_test\.|\.test\.|spec\.|_spec\."


def counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table, under its keyword."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def size_totals(nodes: DataFrame) -> DataFrame:
    t = nodes.agg(*[F.sum(c).alias(f"total_{c}") for c in COUNTS])
    return t.withColumn("comment_pct", F.round(F.try_divide("total_comment_lines", "total_loc"), 4))


def largest_files(nodes: DataFrame, k: int = 15) -> DataFrame:
    return top_k(nodes.where("loc IS NOT NULL").select("id", "file", "name", "loc"), "loc", k, ["id"])


def edge_kinds(edges: DataFrame) -> DataFrame:
    return counted(edges.select(F.coalesce(F.nullif("kind", F.lit("")), F.lit("import")).alias("kind")), ["kind"])


def hotspots(nodes: DataFrame, edges: DataFrame, k: int = 15) -> DataFrame:
    """(list, rank, id, n, file, name): the nodes most imported and those with the most dependencies, ties by id.

    Edges point from the importer to what it imports.
    """
    d = degrees(edges)
    out = None
    for name, c in (("top_imported", "in_degree"), ("top_dependencies", "out_degree")):
        best = top_k(d.where(F.col(c) > 0).select("id", F.col(c).alias("n")), "n", k, ["id"])
        from pyspark.sql import Window

        best = best.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "id"))).withColumn("list", F.lit(name))
        out = best if out is None else out.union(best)
    return out.join(nodes.select("id", "file", "name"), "id", "left").select("list", "rank", "id", "n", "file", "name")


def parse_states(nodes: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """(parse_status, n): counts over nodes, and over files for states that no node has."""
    a = counted(nodes.where("parse_status <> ''"), ["parse_status"])
    if folders is None:
        return a
    b = counted(folders.where("parse_status <> ''"), ["parse_status"], "m")
    return a.join(b, "parse_status", "full").select("parse_status", F.coalesce("n", "m").alias("n"))


def style_totals(files: DataFrame, column: str = "import_style_counts") -> DataFrame:
    """(style, n): sums of a map column by key."""
    return files.select(F.explode(column).alias("style", "v")).where("v IS NOT NULL").groupBy("style").agg(F.sum("v").alias("n"))


def code_metrics(files: DataFrame, by: str = "lang") -> DataFrame:
    """(by, is_total, files, missing, loc, sloc, comment_lines, blank_lines): per language and, with is_total, over all, in one rollup."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]
    g = files.rollup(by).agg(F.grouping(by).cast("boolean").alias("is_total"), F.count(F.lit(1)).alias("files"), F.count_if(F.col("loc").isNull()).alias("missing"), *sums)
    return g


def crosstalk_totals(candidates: DataFrame) -> DataFrame:
    """(lang, kind, refs, files) with a null kind for each language's total."""
    g = candidates.groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("node_id").alias("files"))
    whole = candidates.groupBy("lang").agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("node_id").alias("files"))
    return g.unionByName(whole.withColumn("kind", F.lit(None).cast("string")))


def api_surface(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """One row over functions (docstring, n_params) and classes: totals, docstring coverage, mean parameters."""
    f = functions.agg(
        F.count(F.lit(1)).alias("total_functions"), F.count_if(F.coalesce("docstring", F.lit("")) != "").alias("functions_with_docstrings"), F.round(F.avg("n_params"), 2).alias("avg_params_per_function")
    )
    both = f.crossJoin(classes.agg(F.count(F.lit(1)).alias("total_classes")))
    return both.withColumn("docstring_coverage", F.round(F.try_divide("functions_with_docstrings", "total_functions"), 3))


def environment(refs: DataFrame, k: int = 15) -> DataFrame:
    """(var, uses, is_secret): the ``k`` variables most referred to, of refs (var, file)."""
    n = counted(refs.where("var <> ''"), ["var"], "uses")
    return top_k(n.withColumn("is_secret", F.lower("var").rlike(SECRET)), "uses", k, ["var"])


def environment_totals(refs: DataFrame) -> DataFrame:
    return refs.where("var <> ''").agg(F.countDistinct("var").alias("total_vars"), F.count(F.lit(1)).alias("total_references"))


def http_contracts(candidates: DataFrame) -> DataFrame:
    g = candidates.agg(F.count_if(F.col("kind") == "http_route").alias("backend_routes"), F.count_if(F.col("kind") == "http_call").alias("frontend_calls"))
    return g.withColumn("coverage_ratio", F.when(F.col("frontend_calls") > 0, F.round(F.try_divide("frontend_calls", "backend_routes"), 3)))


def is_test_file(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1)).rlike(_TEST_NAME)


def testing(files: DataFrame, path: str = "file") -> DataFrame:
    t = is_test_file(F.col(path))
    g = files.where(F.col(path).isNotNull()).agg(F.count_if(t).alias("test_files"), F.count_if(~t).alias("source_files"))
    return g.withColumn("test_to_source_ratio", F.round(F.try_divide("test_files", "source_files"), 3))


def risk_score() -> Column:
    """3 per importer, the code's size, up to 10 for missing comments and 2 per member of a cycle."""
    z = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    size = F.when(z("sloc") > 0, z("sloc") / 80).otherwise(z("loc") / 100)
    comments = F.when(F.col("comment_pct").isNotNull(), (1 - F.col("comment_pct")) * 10).otherwise(0.0)
    return 3 * z("importers_count") + size + comments + F.when(z("scc_size") > 1, 2 * z("scc_size")).otherwise(0)


def risky(nodes: DataFrame, k: int = 10) -> DataFrame:
    """(id, risk_score, blast_radius, loc, sloc, comment_pct, reasons) of the ``k`` riskiest of those above 30 points or 15 importers."""
    n, s, lo, size = F.col("importers_count"), F.col("sloc"), F.col("loc"), F.col("scc_size")
    why = F.array_compact(
        F.array(
            F.when(n > 10, F.concat(n.cast("string"), F.lit(" importers (high blast radius)"))),
            F.when(s > 500, F.concat(s.cast("string"), F.lit(" SLOC (large code module)"))).when((F.coalesce(s, F.lit(0)) <= 0) & (lo > 500), F.concat(lo.cast("string"), F.lit(" LOC (large module)"))),
            F.when((F.col("comment_pct") < 0.05) & (s > 200), F.lit("low comment density")),
            F.when(size > 1, F.concat(F.lit("in "), size.cast("string"), F.when(F.coalesce(F.col("scc_size_runtime"), F.lit(0)) > 1, F.lit("-module cycle (runtime)")).otherwise(F.lit("-module cycle (conceptual/TC)")))),
        )
    )
    scored = nodes.withColumn("score", risk_score()).where((F.col("score") > 30) | (n > 15))
    rows = scored.select("id", F.round("score", 1).alias("risk_score"), n.alias("blast_radius"), "loc", "sloc", "comment_pct", why.alias("reasons"))
    return top_k(rows, "risk_score", k, ["id"])


def languages(nodes: DataFrame) -> DataFrame:
    """One row (languages, language): the sorted names, and the one, or polyglot, or unknown."""
    g = nodes.where("trim(lang) <> ''").agg(F.array_sort(F.collect_set(F.trim("lang"))).alias("languages"))
    return g.withColumn("language", F.when(F.size("languages") > 1, F.lit("polyglot")).otherwise(F.coalesce(F.get("languages", F.lit(0)), F.lit("unknown"))))
