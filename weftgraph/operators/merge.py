"""Merging the node, edge and file tables of several languages into one of each."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import first_wins, merged

LANGUAGES = ("python", "ts", "go", "java", "kotlin", "rust", "ruby")
SCC_COLUMNS = ("scc_id", "scc_size", "scc_id_runtime", "scc_size_runtime")
_UNION = frozenset("types interfaces enums classes functions globals imports exports".split())


def stacked(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The tables by language one below the other, with ``lang_rank`` in the order of LANGUAGES; columns that one lacks are null."""
    known = [k for k in LANGUAGES if k in tables] + sorted(k for k in tables if k not in LANGUAGES)
    ranked = [tables[k].withColumn("lang_rank", F.lit(i)) for i, k in enumerate(known)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def edge_key(edges: DataFrame) -> list[Column]:
    """The columns that make two edges one: ends, kind, subkind, synthetic, and for crosstalk the key and its kind."""
    have = set(edges.columns)
    get = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    kind = F.coalesce(get("kind", "string"), F.lit("import"))
    cross = kind == "crosstalk"
    return [
        F.col("src"), F.col("dst"), kind.alias("k"), F.coalesce(get("subkind", "string"), F.lit("")).alias("sk"), F.coalesce(get("synthetic", "boolean"), F.lit(False)).alias("sy"),
        F.when(cross, get("join", "string")).alias("j"), F.when(cross, get("candidate_kind", "string")).alias("ck"),
    ]


def dedupe_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """The first edge of each key in ``order``; edges with a null or empty end are dropped."""
    sound = edges.where((F.coalesce("src", F.lit("")).cast("string") != "") & (F.coalesce("dst", F.lit("")).cast("string") != ""))
    return first_wins(sound.withColumn("__key", F.struct(*edge_key(edges))), ["__key"], order).drop("__key")


def strongest_edges(edges: DataFrame, order: list[str], optional: list[str]) -> DataFrame:
    """One edge per (src, dst, kind): of the largest weight, then with the most of ``optional`` filled, then the first."""
    rich = reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in optional], F.lit(0))
    keyed = edges.withColumn("__rich", rich)
    return first_wins(keyed, ["src", "dst", "kind"], [F.col("weight").desc_nulls_last(), F.desc("__rich"), *order]).drop("__rich")


def merge_edges(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All languages' edges, first wins in the order of LANGUAGES, then by ``seq``."""
    return dedupe_edges(stacked(tables), ["lang_rank", "seq"]).drop("lang_rank", "seq")


def node_rules(nodes: DataFrame, key: str = "id") -> dict[str, str]:
    """How each column of a node merges: name lists by ordered union, counts by maximum, detailed lists by the last filled, maps by overlay, the rest by the last value."""
    rules = {}
    for f in nodes.schema:
        c, kind = f.name, f.dataType.typeName()
        if c == key or c in (*SCC_COLUMNS, "lang_rank"):
            continue
        named = kind == "array" and f.dataType.elementType.typeName() == "struct" and "name" in f.dataType.elementType.names
        if c.endswith("_detailed"):
            rules[c] = "last_filled"
        elif c in _UNION or (kind == "array" and not named):
            rules[c] = "union"
        elif named:
            rules[c] = "named"
        elif kind == "map":
            rules[c] = "overlay"
        elif c.endswith("_count") and kind in ("integer", "long", "short", "byte"):
            rules[c] = "max"
        else:
            rules[c] = "last"
    return rules


def merge_nodes(tables: Mapping[str, DataFrame], key: str = "id") -> DataFrame:
    """One node per id over all languages; components are left out, as only the merged graph has them."""
    both = stacked(tables)
    return merged(both.where(F.col(key).isNotNull()), [key], "lang_rank", node_rules(both, key))


def merge_files(tables: Mapping[str, DataFrame], key: str = "file", *, last: bool = False) -> DataFrame:
    """One row per file; the first language wins, or the ``last``."""
    return first_wins(stacked(tables), [key], [F.desc("lang_rank") if last else F.col("lang_rank")]).drop("lang_rank")


def fill_missing(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``base`` with its nulls filled from ``more`` and the rows that only ``more`` has."""
    shared = [c for c in base.columns if c != key and c in more.columns]
    other = more.select(key, *[F.col(c).alias(f"__{c}") for c in shared])
    cols = [F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in shared else F.col(c) for c in base.columns if c != key]
    return base.join(other, key, "full").select(key, *cols)


def insert_absent(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    return base.unionByName(more.join(base.select(key), key, "left_anti"), allowMissingColumns=True)


def larger_index(a: DataFrame, b: DataFrame, key: str = "file") -> DataFrame:
    """``a`` back-filled with the files that only ``b`` has."""
    return insert_absent(a, b, key)


def counts_report(nodes: Mapping[str, DataFrame], edges: Mapping[str, DataFrame], extra: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """(what, <language>...): rows of each language's node and edge table, pivoted; ``extra`` tables under "total"."""
    def sizes(what: str, tables: Mapping[str, DataFrame]) -> list[DataFrame]:
        return [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), F.lit(k).alias("lang"), "n") for k, df in tables.items()]

    rows = sizes("nodes", nodes) + sizes("edges", edges)
    rows += [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(w).alias("what"), F.lit("total").alias("lang"), "n") for w, d in (extra or {}).items()]
    langs = [*dict.fromkeys([*nodes, *edges]), *(["total"] if extra else [])]
    return reduce(DataFrame.union, rows).groupBy("what").pivot("lang", langs).agg(F.sum("n"))


def typescript_statistics(nodes: DataFrame) -> DataFrame:
    """One row: how many nodes hold types, interfaces, enums, classes or exports, and how many of each there are."""
    out = []
    for c in "classes enums exports interfaces types".split():
        if c in nodes.columns:
            n = F.greatest(F.size(c), F.lit(0))
            out += [F.count_if(n > 0).alias(f"files_with_{c}"), F.coalesce(F.sum(n), F.lit(0)).alias(f"total_{c}")]
    return nodes.agg(*out)


def latest_schema(tags: DataFrame, tag: str = "schema") -> DataFrame:
    """The highest of tags such as nodefacts@v1.9, by number."""
    number = F.transform(F.regexp_extract_all(F.col(tag), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    return tags.where(F.col(tag).isNotNull()).agg(F.max_by(tag, number).alias(tag))
