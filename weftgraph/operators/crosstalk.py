"""Links between languages: candidates of both sides meet on their join key.

Candidates (node_id, seq, kind, join, meta, line, col, syntax, confidence) are reduced to the first of
each (node, key, kind) before they meet, so a key that one file repeats doesn't multiply pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import first_wins

LEAST = 0.5


def _sure(c: str = "confidence") -> Column:
    return F.coalesce(F.col(c), F.lit(1.0))


def index(candidates: DataFrame) -> DataFrame:
    """(join, entries, files): the inverted index in counts."""
    keyed = candidates.where(F.col("join").isNotNull() & (F.col("join") != ""))
    return keyed.groupBy("join").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("node_id").alias("files"))


def edges(sources: DataFrame, targets: DataFrame, *, source_lang: str = "python", target_lang: str = "typescript") -> DataFrame:
    """One edge per (source node, target node, key, kind of the source) where both ends have a confidence of ``LEAST`` or more (1 if null).

    Null and empty keys meet nothing. The edge's confidence is the lower one.
    """
    def side(df: DataFrame, p: str, keys: list[str]) -> DataFrame:
        good = df.where(F.col("join").isNotNull() & (F.col("join") != "") & (_sure() >= LEAST))
        one = first_wins(good, keys, ["seq"])
        return one.select("join", *[F.col(c).alias(f"{p}_{c}") for c in ("node_id", "kind", "line", "col", "syntax")], _sure().alias(f"{p}_confidence"))

    a, b = side(sources, "src", ["node_id", "join", "kind"]), side(targets, "dst", ["node_id", "join"])
    met = a.join(b, "join")
    return met.select(
        F.col("src_node_id").alias("src"), F.col("dst_node_id").alias("dst"), F.lit("crosstalk").alias("kind"), "join",
        F.coalesce("src_kind", "dst_kind", F.lit("unknown")).alias("candidate_kind"), F.lit(source_lang).alias("src_lang"), F.lit(target_lang).alias("dst_lang"),
        F.least("src_confidence", "dst_confidence").alias("confidence"), "src_syntax", "dst_syntax", "src_line", "dst_line",
    )


def statistics(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(kind, matched_keys, pairs, kept_pairs) by the kind of each key's first source: from counts, no pair is made."""
    def per_key(df: DataFrame) -> DataFrame:
        keyed = df.where(F.col("join").isNotNull() & (F.col("join") != ""))
        return keyed.groupBy("join").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(_sure() >= LEAST).alias("good"), F.min_by(F.coalesce("kind", F.lit("unknown")), F.struct("node_id", "seq")).alias("kind")
        )

    a, b = per_key(sources), per_key(targets).withColumnsRenamed({"n": "m", "good": "fine", "kind": "other"})
    met = a.join(b, "join")
    return met.groupBy("kind").agg(F.count(F.lit(1)).alias("matched_keys"), F.sum(F.col("n") * F.col("m")).alias("pairs"), F.sum(F.col("good") * F.col("fine")).alias("kept_pairs"))
