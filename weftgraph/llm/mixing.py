"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, ``share * total / size`` with sizes in
characters. Expected copies are prefix-summed in document order within the source, one random offset
per source is added, and a document is emitted once for every integer boundary its interval crosses.
All arithmetic is in millionths, as integers, so that the sums are exact at any length.

The prefix sum is distributed: ids are cut at quantiles, and what lies between two of them into as many equal
ranges as its rows need; an id that is itself many rows, the null id too, is a range of its own and cut by
hashes of the texts. (source, range) counts are summed over ranges, and only ranks inside a range need a
sort. A hot source is therefore spread over as many tasks as it has ranges, however its ids lie.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

UNIT = 1_000_000
CUTS = 255  # quantiles


def _offset(source: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\u0000"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % UNIT


def mix(
    docs: DataFrame,
    *,
    targets: Mapping[str | None, float] | None = None,
    alpha_root: bool = True,
    total: float = 1.0,
    seed: int = 17,
    bucket_rows: int = 50_000,
) -> DataFrame:
    """Documents repeated (or left out) so that sources approach their target share of characters.

    ``targets`` maps a source to its weight (sources not named get 0); without it the weight is the
    square root of the source's size (``alpha_root``) or the size itself. ``total`` is the size of the
    mixture relative to the input. The result has the columns of ``docs`` and ``copy_no`` (1, 2, ...).

    Defined cases: a null source is a source of its own; null and empty texts count 0 characters; a
    source without any character keeps each document once; null ids sort first; repeated rows are
    documents of their own, ordered by id, then the MD5 of the text, then a hash of all columns; an input column ``copy_no`` is replaced; an
    empty table gives an empty result.
    """
    docs = common.without(docs, "copy_no")
    cuts = docs.agg(F.percentile_approx("doc_id", [k / (CUTS + 1) for k in range(1, CUTS + 1)], 10 * CUTS)).first()[0] or []
    many = sorted({c for c in cuts if cuts.count(c) > 1})
    known = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<long>")
    span = 2 * F.size(F.filter(known, lambda c: c <= F.col("doc_id"))) + (~F.col("doc_id").isin(many)).cast("int")
    keyed = docs.withColumns({"__mix_span": F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(span), "__mix_source": F.struct(F.col("source").alias("s"))})
    spans = keyed.groupBy("__mix_span").agg(F.min("doc_id").alias("__mix_low"), F.max("doc_id").alias("__mix_high"), F.ceil(F.count(F.lit(1)) / bucket_rows).alias("__mix_parts"))
    digest = F.md5(F.col("text").cast("binary"))
    one = F.coalesce(F.col("__mix_low") == F.col("__mix_high"), F.lit(True))
    by_text = F.coalesce(F.shiftright(F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") * F.col("__mix_parts"), 28), F.lit(0))
    by_id = F.floor((F.col("doc_id") - F.col("__mix_low")) / F.ceil((F.col("__mix_high") - F.col("__mix_low") + 1) / F.col("__mix_parts"))).cast("long")
    part = F.when(F.col("__mix_parts") == 1, F.lit(0)).when(one, by_text).otherwise(by_id).cast("long")
    # at most two spans a quantile
    keyed = keyed.join(F.broadcast(spans), "__mix_span").withColumn("__mix_bucket", F.struct(F.col("__mix_span").alias("span"), part.alias("part"))).drop("__mix_span", "__mix_low", "__mix_high", "__mix_parts")
    counts = keyed.groupBy("__mix_source", "__mix_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).alias("chars")
    )
    by_source = Window.partitionBy("__mix_source")
    sizes = counts.groupBy("__mix_source").agg(F.sum("chars").alias("size"))
    if targets is not None:
        weight = F.lit(0.0)
        for name, w in targets.items():
            weight = F.when(F.col("__mix_source.s").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    else:
        weight = F.sqrt(F.col("size").cast("double")) if alpha_root else F.col("size").cast("double")
    sizes = sizes.withColumn("weight", weight)
    sums = sizes.agg(
        F.sum(F.col("size")).alias("all_size"), F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("all_weight")
    )
    expected = F.when(
        F.col("size") > 0,
        F.coalesce(F.round(UNIT * F.lit(float(total)) * F.col("all_size") * F.try_divide("weight", "all_weight") / F.col("size")), F.lit(0.0)),
    ).otherwise(F.lit(float(UNIT)))
    rates = sizes.crossJoin(sums).select(
        F.col("__mix_source"), expected.cast("long").alias("__mix_e"), _offset(F.col("__mix_source.s"), seed).alias("__mix_u")
    )
    before = counts.select(
        "__mix_source",
        "__mix_bucket",
        (F.sum("n").over(by_source.orderBy("__mix_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("__mix_before"),
    ).join(rates, "__mix_source")
    place = F.row_number().over(Window.partitionBy("__mix_source", "__mix_bucket").orderBy("doc_id", digest, F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() != "map"])))
    ranked = keyed.join(before, ["__mix_source", "__mix_bucket"]).withColumn("__mix_rank", F.col("__mix_before") + place)
    crossed = F.expr(
        f"(__mix_e * __mix_rank + __mix_u) div {UNIT} - (__mix_e * (__mix_rank - 1) + __mix_u) div {UNIT}"
    )
    return (
        ranked.withColumn("__mix_n", crossed)
        .where("__mix_n > 0")
        .select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.expr("sequence(1, cast(__mix_n as int))")).alias("copy_no"))
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))


def sql_over(docs: str, columns: str = "doc_id, text, lang, source, n_chars") -> str:
    """The same in DuckDB SQL, over the table or subquery ``docs``."""
    return f"""
WITH d AS (SELECT {columns}, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, md5(text) NULLS FIRST) AS rn FROM {docs}),
s AS (SELECT source, sum(coalesce(length(text), 0))::BIGINT AS size FROM d GROUP BY source),
a AS (SELECT sum(size)::BIGINT AS all_size, sum(sqrt(size::DOUBLE)) FILTER (size > 0) AS all_weight FROM s),
r AS (SELECT source,
        CASE WHEN size > 0 THEN round({UNIT} * 1.0::DOUBLE * all_size * (sqrt(size::DOUBLE) / all_weight) / size)::BIGINT ELSE {UNIT} END AS e,
        ('0x' || substr(md5('17:' || coalesce(source, chr(0))), 1, 8))::BIGINT % {UNIT} AS u
      FROM s, a),
c AS (SELECT d.*, (e * rn + u) // {UNIT} - (e * (rn - 1) + u) // {UNIT} AS n FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT {columns}, unnest(range(1, n + 1))::INTEGER AS copy_no FROM c WHERE n > 0"""


QUERIES = {"op4_mixing": op4_mixing}
ORACLES = {"op4_mixing": sql_over("documents")}
