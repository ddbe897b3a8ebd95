"""Edge tables: one schema for all languages, importer to imported, with the policies that shape them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import paths

from .relational import first_wins, sole_owner

COLUMNS = ("src", "dst", "kind", "subkind", "lang", "spec", "reason", "confidence", "weight", "synthetic", "inferred", "type_checking", "join", "candidate_kind", "seq")
_TYPES = dict.fromkeys(COLUMNS, "string") | {"confidence": "double", "weight": "double", "synthetic": "boolean", "inferred": "boolean", "type_checking": "boolean", "seq": "long"}
CONFIDENCE = {
    "import": {"python": 1.0, "ts": 0.8, "go": 0.8, "java": 0.8, "kotlin": 0.5, "rust": 0.8, "ruby": 1.0},
    "external": {"go": 0.4, "java": 0.4, "rust": 0.4, "ruby": 0.3},
    "extends": 0.6, "implements": 0.6, "permits": 0.6, "impl": 0.6, "supertrait": 0.6, "derive": 0.5, "annotation": 0.5, "attribute": 0.2, "mod": 0.4, "symbol": 0.65, "rails_association": 0.9,
}


def shaped(df: DataFrame, **columns: Column) -> DataFrame:
    """An edge table from the given columns; the rest are null."""
    return df.select(*[columns.get(c, F.lit(None)).cast(_TYPES[c]).alias(c) for c in COLUMNS])


def from_links(links: DataFrame, lang: str, *, external: bool = False) -> DataFrame:
    """Edges of a resolver's links; with ``external`` also to ext::spec for what no file answers, by lower confidence."""
    sure = CONFIDENCE["import"].get(lang, 0.8)
    common = {"src": F.col("path"), "lang": F.lit(lang), "spec": F.col("spec"), "reason": F.col("reason"), "type_checking": F.coalesce("type_checking", F.lit(False)), "seq": F.col("seq")}
    inner = shaped(links.where("target IS NOT NULL AND target <> path"), dst=F.col("target"), kind=F.lit("import"), subkind=F.lit("internal"), confidence=F.lit(sure), weight=F.lit(1.0), inferred=F.col("reason").isin("prefix", "parent"), **common)
    if not external:
        return inner
    low = F.lit(CONFIDENCE["external"].get(lang, 0.3)) if lang not in ("java", "rust") else F.when(F.col("reason").isin("stdlib", "external_crate"), F.lit(0.2)).otherwise(F.lit(0.4))
    outer = shaped(links.where("target IS NULL AND spec <> ''"), dst=F.concat(F.lit("ext::"), "spec"), kind=F.lit("import"), subkind=F.lit("external"), confidence=low, weight=F.lit(0.3), **common)
    return inner.unionByName(outer)


def from_relations(rel: DataFrame, lang: str, *, external: bool = False) -> DataFrame:
    sure = F.create_map(*[x for k, v in CONFIDENCE.items() if isinstance(v, float) for x in (F.lit(k), F.lit(v))])
    common = {"src": F.col("path"), "kind": F.col("kind"), "lang": F.lit(lang), "spec": F.col("object"), "confidence": F.coalesce(F.try_element_at(sure, F.col("kind")), F.lit(0.5)), "weight": F.lit(1.0)}
    inner = shaped(rel.where("target IS NOT NULL AND target <> path"), dst=F.col("target"), subkind=F.lit("internal"), **common)
    if not external:
        return inner
    return inner.unionByName(shaped(rel.where("target IS NULL"), dst=F.concat(F.lit("sym::"), "object"), subkind=F.lit("external"), **common))


def from_symbols(links: DataFrame, lang: str = "kotlin") -> DataFrame:
    return shaped(links, src=F.col("path"), dst=F.col("target"), kind=F.lit("symbol"), subkind=F.col("reason"), lang=F.lit(lang), reason=F.col("reason"), confidence=F.lit(CONFIDENCE["symbol"]), weight=F.lit(1.0))


def from_calls(calls: DataFrame, least: float = 0.6) -> DataFrame:
    ok = calls.where((F.col("confidence") >= least) & (F.col("path") != F.col("target")))
    return shaped(ok, src=F.col("path"), dst=F.col("target"), kind=F.lit("call"), lang=F.lit("ruby"), spec=F.col("spec"), confidence=F.col("confidence"), weight=F.col("confidence"))


def from_associations(rows: DataFrame) -> DataFrame:
    ok = rows.where("target IS NOT NULL AND target <> path")
    return shaped(ok, src=F.col("path"), dst=F.col("target"), kind=F.lit("rails_association"), subkind=F.col("kind"), lang=F.lit("ruby"), spec=F.col("name"), reason=F.lit("rails_association_decl"), confidence=F.lit(CONFIDENCE["rails_association"]), weight=F.lit(1.0))


def from_crosstalk(met: DataFrame) -> DataFrame:
    return shaped(met, src=F.col("src"), dst=F.col("dst"), kind=F.col("kind"), lang=F.lit("crosstalk"), confidence=F.col("confidence"), join=F.col("join"), candidate_kind=F.col("candidate_kind"))


def collapse_package_edges(edges: DataFrame) -> DataFrame:
    """Without a file's edges to P/__init__.py if it also has one to something deeper in P; a root __init__ is never dropped.

    The packages above each deeper target are exploded once and anti-joined: no pair of a file's edges is compared.
    """
    init = F.col("dst").endswith("/__init__.py")
    deeper = edges.where(~init).select("src", F.explode(paths.prefixes(paths.dirname("dst"), "/")).alias("pkg")).distinct()
    gone = deeper.select("src", F.concat("pkg", F.lit("/__init__.py")).alias("dst"))
    return edges.join(gone, ["src", "dst"], "left_anti")


def strict_edges(imports: DataFrame, scope: DataFrame) -> DataFrame:
    """Imports (src, token) of nodes in scope (id) whose token is in scope."""
    ids = scope.select("id").distinct()
    return imports.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("token")), "token", "left_semi").select("src", F.col("token").alias("dst"), F.lit(False).alias("inferred"))


def soft_edges(imports: DataFrame, scope: DataFrame) -> DataFrame:
    """Imports (src, token) answered within scope (id): exactly, else by the shallowest id below the token, else by the only id of that name."""
    ids = scope.select("id").distinct()
    known = imports.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    tokens = known.select("token").where("token IS NOT NULL").distinct()
    parts = ids.select("id", paths.token_parts("id").alias("p"))
    exact = tokens.join(ids.select(F.col("id").alias("token")), "token").select("token", F.col("token").alias("dst"), F.lit(0).alias("rank"))
    ups = parts.where(F.size("p") > 1).select("id", F.size("p").alias("depth"), F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.array_join(F.slice("p", 1, k), "."))).alias("up"))
    best = ups.groupBy("up").agg(F.min(F.struct("depth", F.length("id").alias("n"), "id")).alias("m")).select("up", F.col("m.id").alias("dst"))
    spelled = tokens.withColumn("up", F.array_join(paths.token_parts("token"), "."))
    child = spelled.join(best, "up").select("token", "dst", F.lit(1).alias("rank"))
    names = sole_owner(parts.select(F.element_at("p", -1).alias("base"), "id"), token=["base"], owner="id")
    by_name = tokens.withColumn("base", F.try_element_at(paths.token_parts("token"), F.lit(-1))).join(names, "base").select("token", F.col("id").alias("dst"), F.lit(2).alias("rank"))
    one = first_wins(exact.unionByName(child).unionByName(by_name), ["token"], ["rank"])
    return known.join(one, "token").where("src <> dst").select("src", "dst", (F.col("rank") > 0).alias("inferred"))


def whitelisted(edges: DataFrame) -> DataFrame:
    """Edges with both ends, in the columns of the bundle."""
    sound = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> '' AND dst <> ''")
    return sound.select(*[c for c in COLUMNS if c in edges.columns and c != "seq"])


def bundle_direction(edges: DataFrame) -> DataFrame:
    """Edges as bundles have them: Python imports from the provider to the consumer, all others as they are."""
    swap = (F.col("lang") == "python") & (F.col("kind") == "import")
    return edges.withColumns({"src": F.when(swap, F.col("dst")).otherwise(F.col("src")), "dst": F.when(swap, F.col("src")).otherwise(F.col("dst"))})


def provenance(edges: DataFrame, stdlib: Column) -> DataFrame:
    """Edges with local, stdlib or third_party."""
    inner = ~F.col("dst").startswith("ext::")
    return edges.withColumn("provenance", F.when(inner, F.lit("local")).when(stdlib, F.lit("stdlib")).otherwise(F.lit("third_party")))


def annotate_rows(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Import rows (path, pos, text) with the reference of the same text, the k-th occurrence with the k-th; white space doesn't matter."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    kth = lambda order: F.row_number().over(Window.partitionBy("path", "key").orderBy(order))
    a = rows.withColumn("key", squeeze(F.col("text"))).withColumn("k", kth("pos"))
    b = refs.withColumn("key", squeeze(F.col("raw"))).withColumn("k", kth("seq")).select("path", "key", "k", "module", "level", "type_checking", "scope", "tags", "line")
    return a.join(b, ["path", "key", "k"], "left").drop("key", "k")


def infer_from_rows(rows: DataFrame, aliases: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): row texts (path, module) met through aliases (alias, id; the first wins), without self-edges and pairs that ``edges`` has."""
    one = first_wins(aliases, ["alias"], ["id"]).select(F.col("alias").alias("module"), F.col("id").alias("dst"))
    found = rows.select(F.col("path").alias("src"), "module").distinct().join(one, "module").where("src <> dst").select("src", "dst").distinct()
    return found.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def union_all(tables: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for df in tables.values():
        out = df if out is None else out.unionByName(df)
    return out
