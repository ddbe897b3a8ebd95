"""Reading and writing tables and documents: Parquet stores, tolerant JSON, NDJSON, CSV, single documents."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.errors import AnalysisException


def save_tables(tables: Mapping[str, DataFrame], folder: str, *, partition: Mapping[str, str] | None = None) -> None:
    """Each table as Parquet below ``folder``, replacing what was there once it is complete."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        if partition and name in partition:
            w = w.partitionBy(partition[name])
        w.parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Those of ``names`` that are there."""
    found = {}
    for name in names:
        try:
            found[name] = spark.read.parquet(f"{folder}/{name}")
        except AnalysisException:
            continue
    return found


def first_existing(spark: SparkSession, folders: Iterable[str], names: Iterable[str]) -> str | None:
    """The first of the names that exists, folder by folder."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
            if p.getFileSystem(conf).exists(p):
                return f"{folder}/{name}"
    return None


def read_documents(spark: SparkSession, paths: list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of JSON documents with a schema; documents that don't parse go to errors (path, record)."""
    wide = StructType.fromDDL(schema).add("_corrupt_record", "string")
    text = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", wide, {"mode": "PERMISSIVE"}).alias("d"))
    bad = F.col("d._corrupt_record").isNotNull()
    return text.where(~bad).select("d.*", "path").drop("_corrupt_record"), text.where(bad).select("path", F.col("d._corrupt_record").alias("record"))


def read_graph(spark: SparkSession, path: str, nodes: str = "id string, file string, name string, lang string", edges: str = "src string, dst string, kind string") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph or bundle document, in the given columns; what a record lacks is null."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"nodes array<struct<{_inner(nodes)}>>, edges array<struct<{_inner(edges)}>>").alias("d"))
    return doc.select(F.explode("d.nodes").alias("r")).select("r.*"), doc.select(F.explode("d.edges").alias("r")).select("r.*")


def _inner(ddl: str) -> str:
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, lang) of a manifest document: a list of entries, or an object that holds it under files or items."""
    entry = "struct<path:string,rel_path:string,relpath:string,rel_posix:string,file:string,lang:string,language:string>"
    text = spark.read.text(path, wholetext=True)
    as_list = F.from_json("value", f"array<{entry}>")
    as_doc = F.from_json("value", f"struct<files:array<{entry}>,items:array<{entry}>>")
    listed = F.when(F.ltrim("value").startswith("["), as_list).otherwise(F.coalesce(as_doc["files"], as_doc["items"]))
    e = text.select(F.explode(listed).alias("e"))
    return e.select(F.coalesce("e.rel_posix", "e.relpath", "e.rel_path", "e.path", "e.file").alias("path"), F.coalesce("e.lang", "e.language").alias("lang"))


def require_schema(df: DataFrame, column: str, tag: str) -> DataFrame:
    """``df`` where every row's schema tag is ``tag``; another one raises when the row is read."""
    ok = F.col(column) == tag
    return df.where(F.when(ok, F.lit(True)).otherwise(F.assert_true(ok, F.concat(F.lit("unexpected schema: "), F.coalesce(column, F.lit("null")))).isNull()))


def with_columns_of(df: DataFrame, schema: str) -> DataFrame:
    """``df`` in the columns of ``schema``, those that an older version lacks as nulls."""
    want = StructType.fromDDL(schema)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in want])


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(tables: Iterable[DataFrame], path: str) -> None:
    """Tables of different columns as one CSV with the union of their columns."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in both.schema]
    both.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def rows_as_json(df: DataFrame) -> DataFrame:
    """(value): each row as one JSON object; absent and null fields are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_document(document: Mapping, path: str) -> None:
    """One JSON document on the driver's disk; the file gets its name only when complete."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    tmp = p.with_name(p.name + ".tmp")
    tmp.write_text(json.dumps(document, ensure_ascii=False, sort_keys=True, indent=1) + "\n", encoding="utf-8")
    tmp.replace(p)


def unique_path(path: str) -> str:
    """``path``, or with -2, -3, ... before its suffix the first that isn't taken."""
    p, n = Path(path), 1
    while p.exists():
        n += 1
        p = Path(path).with_stem(f"{Path(path).stem}-{n}")
    return str(p)


def cached(spark: SparkSession, folder: str, key: str, make) -> DataFrame:
    """The table kept under ``key``, or what ``make()`` returns, kept there; a key holds the hash of what it was made from."""
    path = f"{folder}/{key}"
    if first_existing(spark, [path], ["_SUCCESS"]) is None:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def content_key(files: DataFrame, what: str) -> str:
    """A name for what depends on these files alone: of their paths, sizes and times, whatever their order."""
    h = files.agg(F.coalesce(F.sum(F.xxhash64("path", "size", "modified").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n")).first()
    return f"{what}-{h['n']}-{abs(int(h['h'])):x}"
