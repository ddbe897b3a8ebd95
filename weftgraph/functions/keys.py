"""Join keys between languages: HTTP routes, environment variables, RPC, sockets, queues, GraphQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import text

HEX = "[0-9a-fA-F]"
UUID = f"{HEX}{{8}}-{HEX}{{4}}-[1-5]{HEX}{{3}}-[89abAB]{HEX}{{3}}-{HEX}{{12}}"
HEX_LENGTH = 12
SCHEME_AND_HOST = "^[a-zA-Z]" + "[a-zA-Z0-9+.-]*" + "://[^/]+(/|$)"


def route_path(c: Column | str, *, decode: bool = False, strict: bool = False) -> Column:
    """The path of a URL or route: no query, fragment, scheme or host, single slashes, none at the end.

    ``decode`` undoes percent-encoding; with ``strict`` a path with ".." is null.
    """
    p = F.trim(text(c))
    s = F.regexp_replace(p, "[?#].*$", "")
    s = F.regexp_replace(s, SCHEME_AND_HOST, "/")
    s = F.when(s.startswith("/"), s).otherwise(F.concat(F.lit("/"), s))
    if decode:
        s = F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)
    s = F.regexp_replace(F.regexp_replace(s, "/+", "/"), "(.)/$", "$1")
    s = F.when(p == "", F.lit("/")).otherwise(s)
    return F.when(~p.contains(".."), s) if strict else s


def route_template(c: Column | str, hex_length: int = HEX_LENGTH) -> Column:
    """route_path with every segment that names an instance as ":id".

    Those are numbers, UUIDs, hexadecimal strings of ``hex_length`` or more, and the parameters :x, {x}
    and <x>. Both sides of a join must use one ``hex_length``.
    """
    instance = rf"^(:.*|\{{.*\}}|<.*>|\d+|{UUID})$"

    def one(seg: Column) -> Column:
        long_hex = (F.length(seg) >= hex_length) & seg.rlike(f"^(0x)?{HEX}+$")
        return F.when((seg != "") & (seg.rlike(instance) | long_hex), F.lit(":id")).otherwise(seg)

    return F.array_join(F.transform(F.split(route_path(c), "/"), one), "/")


def http_method(c: Column | str) -> Column:
    m = F.upper(F.trim(text(c)))
    return F.when(m.rlike("^[A-Z]+$"), m).otherwise(F.lit("*"))


def _key(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def http_key(method: Column | str, path: Column | str, *, params: bool = True, hex_length: int = HEX_LENGTH) -> Column:
    return _key(F.lit("http"), http_method(method), route_template(path, hex_length) if params else route_path(path))


def env_key(name: Column | str) -> Column:
    return _key(F.lit("env"), F.trim(text(name)))


def rpc_key(name: Column | str) -> Column:
    return _key(F.lit("rpc"), F.trim(text(name)))


def openapi_key(kind: Column | str, ident: Column | str) -> Column:
    return _key(F.lit("openapi"), F.trim(text(kind)), F.trim(text(ident)))


def socket_key(event: Column | str) -> Column:
    return _key(F.lit("socket:event"), F.trim(text(event)))


def queue_key(event: Column | str) -> Column:
    return _key(F.lit("queue:event"), F.trim(text(event)))


def graphql_key(operation: Column | str, name: Column | str) -> Column:
    return _key(F.lit("graphql"), F.trim(text(operation)), F.trim(text(name)))


def route_key(path: Column | str, *, params: bool = False) -> Column:
    return _key(F.lit("route"), route_template(path) if params else route_path(path))


def graphql_operation(document: Column | str) -> Column:
    """struct(op_type, name, hash, join_part) of a GraphQL document's first operation."""
    doc = F.trim(F.regexp_replace(text(document), r"\s+", " "))
    word = r"(?i)\b(query|mutation|subscription)\b"
    kind = F.lower(F.regexp_extract(doc, word, 1))
    name = F.regexp_extract(doc, word + r"\s+([_A-Za-z]\w*)", 2)
    digest = F.sha1(doc.cast("binary"))
    return F.struct(
        F.when(kind == "", F.lit("query")).otherwise(kind).alias("op_type"),
        name.alias("name"),
        digest.alias("hash"),
        F.when(name == "", F.concat(F.lit("sha1:"), F.substring(digest, 1, 8))).otherwise(name).alias("join_part"),
    )


def web_framework(code: Column | str, imports: Column) -> Column:
    """Server framework of a file, by its imports first, then by its text."""
    lower, names = F.lower(text(code)), F.transform(imports, lambda i: F.lower(i))
    out = None
    for name in ("fastapi", "flask", "django", "starlette"):
        hit = F.coalesce(F.array_contains(names, name), F.lit(False))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return (
        out.when(text(code).rlike(r"@app\.(get|post)") | lower.contains("fastapi"), F.lit("fastapi"))
        .when(text(code).contains("@app.route") | lower.contains("flask"), F.lit("flask"))
        .when(lower.contains("urlpatterns") | lower.contains("django"), F.lit("django"))
        .otherwise(F.lit("other"))
    )


def candidate(kind: Column | str, key: Column, *, meta: Column, line: Column, col: Column, syntax: Column | str, confidence: Column) -> Column:
    """The record of one end of a possible link between languages."""
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(
        lit(kind).alias("kind"), key.alias("join"), meta.alias("meta"), line.cast("int").alias("line"), col.cast("int").alias("col"),
        lit(syntax).alias("syntax"), confidence.cast("double").alias("confidence"),
    )
