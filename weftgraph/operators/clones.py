"""Duplicate code: equal windows of normalised lines across files.

A file's windows are made inside its own row, so only (signature, file, line) is shuffled, never the
lines. Files with a window that thousands share cost rows, not arrays: groups are counted, and members
are a table of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import lines as ln


def windows(files: DataFrame, k: int, *, idents: bool = True, strip_comments: bool = True) -> DataFrame:
    """(file, start, signature, preview, category) of every window of ``k`` non-blank normalised lines of ``files`` (file, text).

    ``start`` is the physical line of the first, from 1; ``signature`` is the SHA-1 of the lines joined by
    newlines. Null and short texts have none.
    """
    rows = F.transform(ln.lines("text"), lambda s, i: F.struct((i + 1).alias("n"), ln.normal_line(s, strip_comments=strip_comments, idents=idents).alias("s")))
    kept = files.select("file", F.filter(rows, lambda r: r["s"] != "").alias("ls")).where(F.size("ls") >= k)

    def window(i: Column) -> Column:
        part = F.transform(F.slice("ls", i, F.lit(k)), lambda r: r["s"])
        return F.struct(
            F.get("ls", i - 1)["n"].alias("start"), F.get("ls", i + (k - 2))["n"].alias("stop"), F.sha1(F.array_join(part, "\n").cast("binary")).alias("signature"),
            F.element_at(part, 1).alias("preview"), category(part).alias("category"),
        )

    spread = kept.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size("ls") - (k - 1)), window)).alias("w"))
    return spread.select("file", "w.*")


def category(part: Column) -> Column:
    head = F.element_at(part, 1)
    header = F.forall(part, lambda s: s.startswith("import ") | s.startswith("from "))
    return F.when(header, F.lit("header")).when(head.startswith("def ") | head.startswith("class "), F.lit("body")).otherwise(F.lit("block"))


def groups(wins: DataFrame, k: int, *, within_file: bool = False, most: int = 200) -> DataFrame:
    """(group_id, signature, members, files, window_lines, severity, category, preview): windows met twice or more, in two files or more.

    ``within_file`` lets one file be enough. The ``most`` largest by members, ties by signature.
    """
    by_file = wins.groupBy("signature", "file").agg(F.count(F.lit(1)).alias("m"), F.min("preview").alias("preview"), F.min("category").alias("category"))
    g = by_file.groupBy("signature").agg(F.sum("m").alias("members"), F.count(F.lit(1)).alias("files"), F.min("preview").alias("preview"), F.min("category").alias("category"))
    g = g.where((F.col("members") >= 2) & (F.lit(within_file) | (F.col("files") >= 2)))
    best = g.orderBy(F.desc("members"), "signature").limit(most)
    order = Window.partitionBy().orderBy(F.desc("members"), "signature")  # at most ``most`` rows
    return best.withColumn("n", F.row_number().over(order)).select(
        F.format_string("G%04d", "n").alias("group_id"), "signature", "members", "files", F.lit(k).alias("window_lines"), (F.lit(k) * (F.col("files") - 1)).alias("severity"), "category", "preview"
    )


def members(wins: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(group_id, file, start, end_line, stop): the places of each group; ``end_line`` counts ``k`` lines on, ``stop`` is the last physical line."""
    at = wins.join(found.select("group_id", "signature"), "signature")
    return at.select("group_id", "file", "start", (F.col("start") + (k - 1)).alias("end_line"), "stop")


def statistics(wins: DataFrame) -> DataFrame:
    """One row (total_windows, multi_hit_windows, cross_file_windows) over distinct windows, but for the first."""
    by_file = wins.groupBy("signature", "file").agg(F.count(F.lit(1)).alias("m"))
    g = by_file.groupBy("signature").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("f"))
    return g.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("total_windows"), F.count_if(F.col("m") >= 2).alias("multi_hit_windows"), F.count_if(F.col("f") >= 2).alias("cross_file_windows")
    )


def report(files: DataFrame, *, k: int = 5, idents: bool = True, within_file: bool = False, most: int = 200) -> tuple[DataFrame, DataFrame, bool]:
    """(groups, members, whether the fallback was used): strict windows, or, if there is no group, up to 3 lines and single files too."""
    strict = max(2, k)
    wins = windows(files, strict, idents=idents)
    found = groups(wins, strict, within_file=within_file, most=most)
    if not found.isEmpty():
        return found, members(wins, found, strict), False
    loose = max(2, min(3, k))
    wins = windows(files, loose, idents=idents)
    found = groups(wins, loose, within_file=True, most=min(most, 200))
    return found, members(wins, found, loose), True
