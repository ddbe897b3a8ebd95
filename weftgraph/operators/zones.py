"""Zones: nodes grouped by package, laid out by level and parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import paths

from .relational import first_wins, top_k

MOST = 5000


def package_of(node: Column | str) -> Column:
    """Dotted package of a node: the folders of a path, or all but the last part of a dotted id; an __init__ lies in its own."""
    p = paths.to_posix(node)
    by_path = F.replace(paths.dirname(p), F.lit("/"), F.lit("."))
    dotted = F.regexp_replace(F.regexp_extract(p, r"^(.*)\.[^.]+$", 1), r"\.__init__$", "")
    is_path = p.contains("/") | p.rlike(r"\.[A-Za-z]{1,4}$") & (paths.extension(p).isin(*[f".{e}" for e in "go java js jsx kt py pyi rb rs ts tsx".split()]))
    return F.when(is_path, F.regexp_replace(by_path, r"^\.+", "")).otherwise(dotted)


def parent_of(package: Column) -> Column:
    """The package above; the root's is null, a top package's is the root."""
    return F.when(package == "", F.lit(None)).when(package.contains("."), F.regexp_replace(package, r"\.[^.]+$", "")).otherwise(F.lit(""))


def level_of(package: Column) -> Column:
    return F.when(package == "", F.lit(0)).otherwise(F.size(F.split(package, r"\.")) - 1)


def origins(packages: DataFrame) -> DataFrame:
    """(package, lane, column) of packages (package, n): each (level, parent) takes the next even lane, siblings even columns by size, then name."""
    p = packages.withColumns({"level": level_of(F.col("package")), "parent": parent_of(F.col("package"))})
    lanes = Window.partitionBy().orderBy("level", F.coalesce("parent", F.lit("")))  # one row a package, at most MOST
    columns = Window.partitionBy("level", F.coalesce("parent", F.lit(""))).orderBy(F.desc("n"), "package")
    return p.select("package", ((F.dense_rank().over(lanes) - 1) * 2).alias("lane"), ((F.row_number().over(columns) - 1) * 2).alias("column"))


def build(nodes: DataFrame, *, least_files: int = 1, most: int = MOST) -> DataFrame:
    """One zone a package of ``nodes`` (id, file and, optionally, package): place, near-square footprint, parent, children and members.

    Packages of fewer than ``least_files`` nodes are left out; the first ``most`` by level and name stay.
    """
    named = nodes if "package" in nodes.columns else nodes.withColumn("package", package_of("id"))
    named = named.withColumn("package", F.coalesce("package", F.lit("")))
    g = named.groupBy("package").agg(F.array_sort(F.collect_set("id")).alias("node_ids"), F.array_sort(F.collect_set("file")).alias("member_files"))
    g = g.withColumns({"n": F.size("node_ids"), "level": level_of(F.col("package")), "parent": parent_of(F.col("package"))}).where(F.col("n") >= least_files)
    g = g.orderBy("level", "package").limit(most)
    seq = Window.partitionBy().orderBy("level", "package")
    z = g.withColumn("seq", F.row_number().over(seq))
    z = z.join(origins(z.select("package", "n")), "package")
    kids = z.where("parent IS NOT NULL").groupBy(F.col("parent").alias("package")).agg(F.array_sort(F.collect_list("package")).alias("children"))
    z = z.join(kids, "package", "left")
    side = F.ceil(F.sqrt("n")).cast("int")
    zone_id = lambda c: F.when(c == "", F.lit("<root>")).otherwise(c)
    return z.select(
        zone_id(F.col("package")).alias("zone_id"), "seq", F.element_at("node_ids", 1).alias("seed_id"), "package", "level", zone_id(F.col("parent")).alias("parent_zone_id"),
        F.coalesce("children", F.array().cast("array<string>")).alias("children"), "lane", "column", side.alias("footprint_columns"), F.ceil(F.col("n") / side).cast("int").alias("footprint_lanes"),
        F.lit("by-package").alias("zone_kind"), "n", "node_ids", "member_files",
    )


def zone_of(zones: DataFrame) -> DataFrame:
    """(id, zone_id): the first zone, by seq, that lists a member."""
    spread = zones.select("zone_id", "seq", F.explode("node_ids").alias("id"))
    return first_wins(spread, ["id"], ["seq"]).select("id", "zone_id")


def cross_edges(edges: DataFrame, member_of: DataFrame, k: int = 15) -> DataFrame:
    """(from_zone, to_zone, n): the ``k`` pairs of different zones with the most edges."""
    a = member_of.select(F.col("id").alias("src"), F.col("zone_id").alias("from_zone"))
    b = member_of.select(F.col("id").alias("dst"), F.col("zone_id").alias("to_zone"))
    n = edges.join(a, "src").join(b, "dst").where("from_zone <> to_zone").groupBy("from_zone", "to_zone").agg(F.count(F.lit(1)).alias("n"))
    return top_k(n, "n", k, ["from_zone", "to_zone"])


def largest(zones: DataFrame, k: int = 15) -> DataFrame:
    sized = zones.select("zone_id", "package", "zone_kind", "level", F.size("member_files").alias("members"))
    return top_k(sized, "members", k, ["zone_id"])
