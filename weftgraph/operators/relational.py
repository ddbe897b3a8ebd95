"""Relational building blocks: first and last wins, prefix and candidate joins, unique matches, ordered merges.

All are lazy. None sends a table to the tasks of its own accord: whether a side is broadcast is left to
the planner, which knows its size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import paths

Keys = Sequence[str]


def _order(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def first_wins(df: DataFrame, keys: Keys, order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in ``order``; null keys are a key of their own.

    The rank is limited before the shuffle (a partial window group limit), so hot keys don't travel.
    """
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def cap_per_key(df: DataFrame, keys: Keys, order: Sequence[str | Column], most: int, rank: str = "rank") -> DataFrame:
    """At most ``most`` rows of each key, with their rank from 1."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= most)


def top_k(df: DataFrame, by: str, k: int, ties: Sequence[str | Column]) -> DataFrame:
    """The ``k`` rows of largest ``by``; ties by ``ties`` ascending, nulls last."""
    return df.orderBy(F.col(by).desc_nulls_last(), *_order(ties)).limit(k)


def longest_prefix(wanted: DataFrame, known: DataFrame, *, spec: str, ident: str, sep: str = ".", least_parts: int = 1) -> DataFrame:
    """(spec, ident) for every distinct spec: the longest known id among the spec and its ancestors, or null.

    Ancestors are exploded from the distinct specs only and met by an equi-join.
    """
    specs = wanted.select(F.col(spec)).where(F.col(spec).isNotNull()).distinct()
    ups = specs.select(spec, F.explode(paths.prefixes(F.col(spec), sep)).alias("__up"))
    if least_parts > 1:
        ups = ups.where(F.size(F.split("__up", "\\Q" + sep + "\\E")) >= least_parts)
    ids = known.select(F.col(ident).alias("__up")).distinct()
    best = ups.join(ids, "__up").groupBy(spec).agg(F.max_by("__up", F.length("__up")).alias(ident))
    return specs.join(best, spec, "left")


def nearest_ancestor(rows: DataFrame, folders: DataFrame, *, path: str, folder: str) -> DataFrame:
    """(path, folder) for every distinct path: the deepest known folder that holds it, or null.

    The empty folder is the root and holds everything.
    """
    given = rows.select(path).where(F.col(path).isNotNull()).distinct()
    ups = given.select(path, F.explode(F.concat(paths.prefixes(paths.dirname(path), "/"), F.array(F.lit("")))).alias("__up"))
    ids = folders.select(F.col(folder).alias("__up")).distinct()
    best = ups.join(ids, "__up").groupBy(path).agg(F.max_by("__up", F.length("__up")).alias(folder))
    return given.join(best, path, "left")


def first_candidate(rows: DataFrame, known: DataFrame, *, key: Keys, candidates: Column, ident: str) -> DataFrame:
    """(*key, ident, rank): the first of each row's candidate array that is known; rows without one are left out."""
    spread = rows.select(*key, F.posexplode(candidates).alias("rank", "__c")).where("__c IS NOT NULL")
    hits = spread.join(known.select(F.col(ident).alias("__c")).distinct(), "__c")
    return hits.groupBy(*key).agg(F.min_by("__c", "rank").alias(ident), F.min("rank").alias("rank"))


def sole_owner(owners: DataFrame, *, token: Keys, owner: str) -> DataFrame:
    """(*token, owner) of tokens that exactly one owner has."""
    g = owners.groupBy(*token).agg(F.min(owner).alias(owner), F.max(owner).alias("__max"))
    return g.where(F.col(owner) == F.col("__max")).drop("__max")


def missing_from(rows: DataFrame, known: DataFrame, key: Keys) -> DataFrame:
    return rows.join(known.select(*key).distinct(), list(key), "left_anti")


def covered_by(rows: DataFrame, known: DataFrame, key: Keys) -> DataFrame:
    return rows.join(known.select(*key).distinct(), list(key), "left_semi")


def coverage(eligible: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """One row (eligible, covered, missing, ratio) over the distinct keys of ``eligible``; the ratio of nothing is null."""
    ids, have = eligible.select(key).where(F.col(key).isNotNull()).distinct(), covered.select(key).distinct().withColumn("__hit", F.lit(1))
    both = ids.join(have, key, "left").agg(F.count(F.lit(1)).alias("eligible"), F.count("__hit").alias("covered"))
    return both.select("eligible", "covered", (F.col("eligible") - F.col("covered")).alias("missing"), F.round(F.try_divide("covered", "eligible"), 4).alias("ratio"))


def upsert_covered(covered: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return covered.select(key).union(new.select(key)).where(F.col(key).isNotNull()).distinct()


def inverted(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """(a, name): for each a the sorted distinct b."""
    return rows.where(F.col(a).isNotNull()).groupBy(a).agg(F.array_sort(F.collect_set(b)).alias(name))


def counted(rows: DataFrame, keys: Keys, name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


# == ordered merges


def _in_order(c: str, order: str) -> Column:
    got = F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))
    by_order = F.array_sort(got, lambda x, y: F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0))  # maps have no order of their own
    return F.transform(by_order, lambda x: x["v"])


def merged(rows: DataFrame, key: Keys, order: str, rules: Mapping[str, str]) -> DataFrame:
    """One row a key; columns merged by rule, in ascending ``order``. Nulls never win.

    ``first``, ``last``: the value; ``max``, ``min``, ``sum``; ``any``: of booleans; ``union``: arrays, distinct, in
    order of appearance; ``sorted_union``; ``last_filled``: the last array that isn't empty; ``overlay``: maps,
    later values of a key win; ``named``: arrays of structs, the first of each ``name``.
    """
    empty = lambda c: F.array().cast(rows.schema[c].dataType)
    make = {
        "first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))),
        "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))),
        "last_filled": lambda c: F.max_by(c, F.when(F.size(c) > 0, F.col(order))),
        "max": F.max,
        "min": F.min,
        "sum": F.sum,
        "any": F.bool_or,
        "union": lambda c: F.array_distinct(F.flatten(_in_order(c, order))),
        "sorted_union": lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))),
        "overlay": lambda c: F.map_from_entries(F.aggregate(_in_order(c, order), F.map_entries(F.create_map().cast(rows.schema[c].dataType)), _overlay)),
        "named": lambda c: F.aggregate(F.flatten(_in_order(c, order)), empty(c), _add_named),
    }
    return rows.groupBy(*key).agg(*[make[rule](c).alias(c) for c, rule in rules.items()])


def _overlay(done: Column, new: Column) -> Column:
    kept = F.filter(done, lambda e: ~F.map_contains_key(new, e["key"]))
    return F.concat(kept, F.map_entries(new))


def _add_named(done: Column, x: Column) -> Column:
    known = F.exists(done, lambda y: y["name"].eqNullSafe(x["name"]) & (x["name"].isNotNull() | (y == x)))
    return F.when(known, done).otherwise(F.array_append(done, x))


def worst_status(c: str) -> Column:
    """Aggregate: the worst of ok < warn < error; unknown words rank as ok."""
    rank = F.when(F.col(c) == "error", 2).when(F.col(c) == "warn", 1).otherwise(0)
    return F.element_at(F.array(F.lit("ok"), F.lit("warn"), F.lit("error")), F.max(rank) + 1)
