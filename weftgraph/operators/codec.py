"""Compact bundles: dictionaries for paths, types and enumerations, rows instead of objects; lossless both ways.

Dictionary ids are dense ranks over the sorted values, computed by range partition and offset, so that no
task sees all values. Documents are encoded with a marked reference for each known path; a marker never
collides with a value of the document, negative numbers included.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import settle

PARSE_STATUS = ("ok", "error", "partial", "warn")
PARAM_KIND = tuple("positional_or_keyword positional_only keyword_only var_positional var_keyword".split())
EDGE_KINDS = tuple("import call reference inherit uses exports".split())
_ABSENT = {"-": 0}  # marks a field that a record lacks, as null is a value


def dense_ids(values: DataFrame, column: str, name: str = "code") -> DataFrame:
    """(column, name): distinct non-null values in order, numbered from 0.

    Values are range-partitioned and settled; numbers run within a partition, and partitions are offset by
    their sizes, of which there is one a partition.
    """
    ordered = settle(values.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).withColumn("__at", F.monotonically_increasing_id()))
    part, k = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("n"))
    a, b = sizes.alias("a"), sizes.alias("b")
    before = a.join(b, F.col("b.__p") < F.col("a.__p"), "left").groupBy(F.col("a.__p").alias("__p")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("__o"))
    return ordered.withColumn("__p", part).join(before, "__p").select(column, (F.col("__o") + k).alias(name))


def path_dictionary(paths: DataFrame, column: str = "path") -> DataFrame:
    """(path, path_id, prefix, prefix_id, leaf): ids by order of path; folders numbered in order of their first path."""
    ids = dense_ids(paths, column, "path_id").withColumnRenamed(column, "path")
    cut = ids.withColumns({"prefix": F.regexp_extract("path", r"^(.*/)", 1), "leaf": F.regexp_extract("path", r"([^/]*)$", 1)})
    firsts = cut.groupBy("prefix").agg(F.min("path_id").alias("first"))
    return cut.join(firsts.join(dense_ids(firsts, "first", "prefix_id"), "first").select("prefix", "prefix_id"), "prefix").select("path", "path_id", "prefix", "prefix_id", "leaf")


def decode_paths(dictionary: DataFrame) -> DataFrame:
    return dictionary.select("path_id", F.concat("prefix", "leaf").alias("path"))


def type_dictionary(symbols: DataFrame) -> DataFrame:
    """(type, code) of the distinct type hints and return types of symbols."""
    hints = symbols.select(F.explode(F.concat(F.array("returns"), F.transform("params", lambda p: p["type"]))).alias("type"))
    return dense_ids(hints.where("type <> ''"), "type")


def encode_column(df: DataFrame, column: str, dictionary: DataFrame, key: str, code: str) -> DataFrame:
    """``df`` with a column's values replaced by their code; unknown ones become null."""
    d = dictionary.select(F.col(key).alias(column), F.col(code).alias("__c"))
    return df.join(d, column, "left").drop(column).withColumnRenamed("__c", column)


def edge_kinds(edges: DataFrame) -> list[str]:
    """The known kinds, then those that only these edges have, by name."""
    seen = [r[0] for r in edges.select(F.coalesce("kind", F.lit("import"))).distinct().limit(1000).collect()]
    return [*EDGE_KINDS, *sorted(set(seen) - set(EDGE_KINDS))]


# == tables of rows


def short_names(fields: Sequence[str], known: Mapping[str, str] | None = None) -> dict[str, str]:
    """A short name for each field, all different: a known one, initials of its words, or x and a number."""
    used: set[str] = set()
    out = {}
    for f in fields:
        words = [w for w in f.split("_") if w]
        tries = [(known or {}).get(f, ""), "".join(w[0] for w in words), "".join(w[:2] for w in words), f]
        got = next((t for t in tries if t and t not in used), None)
        if got is None:
            got = next(f"x{i}" for i in range(len(fields) + len(used) + 1) if f"x{i}" not in used)
        used.add(got)
        out[f] = got
    return out


def json_of(c: Column) -> Column:
    """Any column as JSON text, null as null."""
    return F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1))


def row_lines(df: DataFrame, enums: Mapping[str, Sequence[str]] | None = None) -> tuple[dict, DataFrame]:
    """(head, rows): schema and legend of a table, and its rows as JSON arrays (value), made on the executors."""
    names = short_names(df.columns)
    head = {"schema": [names[c] for c in df.columns], "legend": {v: k for k, v in names.items()}, "enums": {c: list(v) for c, v in (enums or {}).items() if c in names}}
    known = lambda c: F.array(*[F.lit(v) for v in enums[c]])
    coded = lambda c: F.when(F.array_position(known(c), F.col(c)) > 0, (F.array_position(known(c), F.col(c)) - 1).cast("string")).otherwise(json_of(F.col(c)))
    cells = [coded(c) if enums and c in enums else json_of(F.col(c)) for c in df.columns]
    return head, df.select(F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]")).alias("value"))


def decode_rows(head: Mapping[str, Any], rows: Iterable[Sequence[Any]]) -> list[dict]:
    """Records of encoded rows; fields that were null are left out."""
    fields = [head["legend"][s] for s in head["schema"]]
    out = []
    for row in rows:
        rec = {}
        for f, v in zip(fields, row, strict=True):
            known = head["enums"].get(f)
            if v is not None:
                rec[f] = known[v] if known and isinstance(v, int) and not isinstance(v, bool) else v
        out.append(rec)
    return out


def compress_records(records: Sequence[Mapping[str, Any]], enums: Mapping[str, Sequence[str]] | None = None, first: Sequence[str] = ()) -> dict:
    """Records as head and rows: fields are the union of all keys, those of ``first`` first, then by name; absent differs from null."""
    keys = {k for r in records for k in r}
    fields = [f for f in first if f in keys] + sorted(keys - set(first))
    names = short_names(fields)
    enums = {k: list(v) for k, v in (enums or {}).items() if k in keys}

    def cell(f: str, r: Mapping[str, Any]) -> Any:
        if f not in r:
            return _ABSENT
        v = r[f]
        return {"e": enums[f].index(v)} if f in enums and v in enums[f] else {"v": v} if isinstance(v, Mapping) else v

    return {"schema": [names[f] for f in fields], "legend": {v: k for k, v in names.items()}, "enums": enums, "rows": [[cell(f, r) for f in fields] for r in records]}


def decode_records(c: Mapping[str, Any]) -> list[dict]:
    fields = [c["legend"][s] for s in c["schema"]]

    def back(f: str, v: Any) -> Any:
        if isinstance(v, Mapping):
            return c["enums"][f][v["e"]] if "e" in v else v["v"]
        return v

    return [{f: back(f, v) for f, v in zip(fields, row, strict=True) if v != _ABSENT} for row in c["rows"]]


# == whole documents

SEMANTIC_KEYS = frozenset("name kind raw text label language lang preview reason error_snippet content".split())


def encode_document(doc: Any, paths: Sequence[str], *, keep: frozenset[str] = SEMANTIC_KEYS) -> Any:
    """A JSON document with each string that is a path of ``paths`` as {"@": index}, but under the keys of ``keep``.

    An object of the document that looks like a reference is wrapped, so that decoding is exact.
    """
    ids = {p: i for i, p in enumerate(paths)}

    def walk(x: Any, key: str | None) -> Any:
        if isinstance(x, str):
            return {"@": ids[x]} if key not in keep and x in ids else x
        if isinstance(x, list):
            return [walk(v, key) for v in x]
        if isinstance(x, dict):
            inner = {k: walk(v, k) for k, v in x.items()}
            return {"@": inner} if set(x) == {"@"} else inner
        return x

    return walk(doc, None)


def decode_document(doc: Any, paths: Sequence[str]) -> Any:
    def walk(x: Any) -> Any:
        if isinstance(x, list):
            return [walk(v) for v in x]
        if isinstance(x, dict):
            if set(x) == {"@"}:
                v = x["@"]
                return paths[v] if isinstance(v, int) and not isinstance(v, bool) else {k: walk(u) for k, u in v.items()}
            return {k: walk(v) for k, v in x.items()}
        return x

    return walk(doc)


def prefix_list(paths: Sequence[str]) -> dict[str, list]:
    """Sorted paths as folders and (folder, leaf) pairs, and back by ``paths_of``."""
    folders: dict[str, int] = {}
    pairs = []
    for p in paths:
        folder, slash, leaf = p.rpartition("/")
        pairs.append([folders.setdefault(folder + slash, len(folders)), leaf])
    return {"prefixes": list(folders), "paths": pairs}


def paths_of(legend: Mapping[str, list]) -> list[str]:
    return [legend["prefixes"][i] + leaf for i, leaf in legend["paths"]]


FORMAT_GUIDE = {
    "tables": "Each table has a schema of short names, a legend from short names to fields, enums by field, and rows in the order of the schema.",
    "cells": 'A cell is the value itself; {"e": i} is entry i of the field\'s enum, {"v": x} an object, {"-": 0} an absent field.',
    "paths": 'Strings that are paths of nodes are {"@": i}: entry i of path_legend.paths, a pair of a prefix\' index and the rest. {"@": {...}} is an object of the document itself.',
}


def compress_bundle(bundle: Mapping[str, Any], *, guide: bool = True, drop: frozenset[str] = frozenset()) -> dict:
    """A bundle with nodes and edges as tables and paths as references; everything else passes through."""
    paths = sorted({n["id"] for n in bundle.get("nodes", []) if isinstance(n.get("id"), str)})
    body = {k: v for k, v in bundle.items() if k not in ("nodes", "edges") and k not in drop}
    out = {"path_legend": prefix_list(paths), "body": encode_document(body, paths)}
    kinds = [*EDGE_KINDS, *sorted({e.get("kind") for e in bundle.get("edges", []) if isinstance(e.get("kind"), str)} - set(EDGE_KINDS))]
    for name, enums, first in (("nodes", {"parse_status": PARSE_STATUS}, ("id", "file", "name")), ("edges", {"kind": kinds}, ("src", "dst", "kind"))):
        if name in bundle:
            t = compress_records(bundle[name], enums, first)
            fields = [t["legend"][s] for s in t["schema"]]
            t["rows"] = [[encode_document({f: v}, paths)[f] if v != _ABSENT else v for f, v in zip(fields, row, strict=True)] for row in t["rows"]]
            out[name] = t
    if guide:
        out["format_guide"] = FORMAT_GUIDE
    return out


def decode_bundle(c: Mapping[str, Any]) -> dict:
    paths = paths_of(c["path_legend"])
    out = dict(decode_document(c["body"], paths))
    for name in ("nodes", "edges"):
        if name in c:
            t = dict(c[name])
            t["rows"] = [[decode_document(v, paths) if v != _ABSENT else v for v in row] for row in t["rows"]]
            out[name] = decode_records(t)
    return out
