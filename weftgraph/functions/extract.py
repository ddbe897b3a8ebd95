"""Source files to facts: one Arrow pass a file, whatever its language; everything after it is relational."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import keys, lines
from .source_common import Facts
from .source_other import go_facts, java_facts, kotlin_facts, ruby_facts, rust_facts
from .source_python import import_lines, python_facts
from .source_web import web_facts

EXTRACTORS = {
    "python": python_facts, "ts": web_facts, "js": web_facts, "go": go_facts, "java": java_facts, "kotlin": kotlin_facts, "rust": rust_facts, "ruby": ruby_facts,
}
_USES = "array<struct<base:string,attr:string>>"
FACTS = (
    "path string, lang string, parse_status string, error string, package string, "
    "imports array<struct<raw:string,module:string,names:array<struct<name:string,alias:string>>,is_from:boolean,level:int,type_checking:boolean,line:int,end_line:int,scope:string,conditional:boolean,kind:string,tags:array<string>>>, "
    "symbols array<struct<kind:string,name:string,owner:string,line:int,col:int,docstring:string,params:array<struct<name:string,kind:string,type:string,default:string>>,returns:string,bases:array<string>,decorators:array<string>,flags:array<string>>>, "
    "exports array<string>, refs array<string>, tokens array<string>, class_uses array<string>, notes array<string>, docstring_lines int, "
    f"uses {_USES}, method_uses {_USES}, local_imports array<struct<name:string,line:int,col:int,module:string,attr:string,level:int>>, "
    "relations array<struct<kind:string,subject:string,object:string>>, "
    "candidates array<struct<kind:string,method:string,target:string,meta:map<string,string>,line:int,col:int,syntax:string,confidence:double>>"
)


def facts_of(text: str | None, lang: str) -> tuple[Facts, str, str | None]:
    """(facts, parse status, error) of one source; a source that doesn't parse has only its import lines."""
    run = EXTRACTORS.get(lang)
    if text is None or run is None:
        return Facts(), "ok" if run is None else "error", None if run is None else "no content"
    try:
        return run(text), "ok", None
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        facts = Facts()
        facts["notes"] = [f"import_line:{x}" for x in import_lines(text)] if lang == "python" else []
        why = ": ".join((type(e).__name__, str(e)))
        return facts, "error", why[:200]


def facts(files: DataFrame) -> DataFrame:
    """The facts of ``files`` (path, lang, content). Null paths are left out; null contents give parse status error."""
    schema = to_arrow_schema(StructType.fromDDL(FACTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for path, lang, text in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    f, status, error = facts_of(text, lang)
                    rows.append({**f, "path": path, "lang": lang, "parse_status": status, "error": error})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.where("path IS NOT NULL").select("path", "lang", F.col("content").cast("string")).mapInArrow(run, FACTS)


def metrics(files: DataFrame) -> DataFrame:
    """(path, lang, loc, sloc, comment_lines, blank_lines, comment_pct) of ``files`` (path, lang, content), all in the JVM."""
    m = lines.metrics_for("content", F.col("lang"))
    return files.select("path", "lang", m.alias("m")).select("path", "lang", "m.*")


def count_docstrings(measured: DataFrame, found: DataFrame) -> DataFrame:
    """Python metrics with docstring lines counted as comments rather than code."""
    d = found.select("path", F.col("docstring_lines").alias("__d"))
    j = measured.join(d, "path", "left").withColumn("__d", F.least(F.coalesce("__d", F.lit(0)), F.coalesce("sloc", F.lit(0))))
    moved = j.withColumns({"sloc": F.col("sloc") - F.col("__d"), "comment_lines": F.col("comment_lines") + F.col("__d")}).drop("__d")
    return moved.withColumn("comment_pct", lines.comment_share(F.col("comment_lines"), F.col("loc")))


def candidate_key(kind: Column, method: Column, target: Column) -> Column:
    """The join key of a candidate by its kind."""
    op = keys.graphql_operation(target)
    return (
        F.when(kind.isin("http_route", "http_call"), keys.http_key(method, target))
        .when(kind == "env_ref", keys.env_key(target))
        .when(kind.isin("rpc_call", "rpc_impl"), keys.rpc_key(target))
        .when(kind == "openapi", keys.openapi_key(method, target))
        .when(kind == "socket_event", keys.socket_key(target))
        .when(kind == "queue_event", keys.queue_key(target))
        .when((kind == "graphql_op") & (method == "document"), keys.graphql_key(op["op_type"], op["join_part"]))
        .when(kind == "graphql_op", keys.graphql_key(method, target))
        .when(kind == "route_ref", keys.route_key(target))
    )


def candidates(found: DataFrame) -> DataFrame:
    """(node_id, lang, seq, kind, join, meta, line, col, syntax, confidence) of every candidate in ``facts``."""
    c = found.select(F.col("path").alias("node_id"), "lang", F.posexplode("candidates").alias("seq", "c"))
    return c.select("node_id", "lang", "seq", F.col("c.kind").alias("kind"), candidate_key(F.col("c.kind"), F.col("c.method"), F.col("c.target")).alias("join"), "c.meta", "c.line", "c.col", "c.syntax", "c.confidence")


def import_refs(found: DataFrame) -> DataFrame:
    """(path, lang, package, seq, raw, module, names, ...) of every import in ``facts``."""
    return found.select("path", "lang", "package", F.posexplode("imports").alias("seq", "i")).select("path", "lang", "package", "seq", "i.*")


def symbols(found: DataFrame) -> DataFrame:
    return found.select("path", "lang", "package", F.posexplode("symbols").alias("seq", "s")).select("path", "lang", "package", "seq", "s.*")
