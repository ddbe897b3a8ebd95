"""The whole analysis of a source tree: manifest, facts, links, edges, graph, zones, summary, bundle.

Stages are lazy tables; what several stages share is settled once in the shared folder. Nothing is
collected but for the one JSON bundle, which is a document by nature.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import extract, lines, paths
from weftgraph.operators import clones, codec, crosstalk, deadcode, edges as ed, graph, imports, merge, nodes as nd, relational as rel, resolve, seeds, summary, zones
from weftgraph.operators.storage import settle
from weftgraph.sources import tree
from weftgraph.sources.settings import Settings

log = logging.getLogger("weftgraph")
SCHEMA = "weftgraph-bundle@v1"
#: Called as hook(stage, tables so far) after each stage; may replace tables in place.
Hook = Callable[[str, dict[str, DataFrame]], None]


class Events:
    """Counted and capped log events: kinds may be allowed, silenced and limited."""

    def __init__(self, *, allowed: frozenset[str] | None = None, silenced: frozenset[str] = frozenset(), most: int = 1000):
        self.allowed, self.silenced, self.most = allowed, silenced, most
        self.counts: dict[str, int] = {}

    def __call__(self, kind: str, **values: object) -> bool:
        if kind in self.silenced or self.allowed is not None and kind not in self.allowed:
            return False
        self.counts[kind] = self.counts.get(kind, 0) + 1
        if self.counts[kind] > self.most:
            return False
        log.info("%s %s", kind, json.dumps(values, default=str, sort_keys=True))
        return True


@dataclass
class Analysis:
    tables: dict[str, DataFrame]
    settings: Settings
    events: Events = field(default_factory=Events)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None


def language_links(found: DataFrame, refs: DataFrame, symbols: DataFrame, files: DataFrame, settings: Settings, langs: set[str] | None = None) -> dict[str, DataFrame]:
    """The resolver of each language over its references; ``files`` has path, lang and content. ``langs`` limits it to those that occur.

    Each is settled on its own: one plan of all of them would be planned again after every stage.
    """
    modules = lambda: settle(resolve.python_modules(files, list(settings.source_roots)))
    packages = lambda lang: found.where((F.col("lang") == lang) & (F.coalesce("package", F.lit("")) != "")).select("package", "path")
    configs = lambda: resolve.effective_configs(settle(resolve.ts_configs(files)))
    of = {
        "python": lambda: resolve.python(refs, modules()),
        "ts": lambda: resolve.web(refs, files.select("path"), configs()),
        "go": lambda: resolve.go(refs, settle(resolve.go_packages(files, resolve.go_modules(files)))),
        "java": lambda: resolve.java(refs, resolve.declared_types(symbols, "java"), packages("java")),
        "kotlin": lambda: resolve.kotlin(refs, resolve.declared_types(symbols, "kotlin"), packages("kotlin")),
        "rust": lambda: resolve.rust(refs, resolve.rust_modules(files)),
        "ruby": lambda: resolve.ruby(refs, resolve.ruby_providers(files), ruby_types(symbols)),
    }
    return {lang: settle(make()) for lang, make in of.items() if langs is None or lang in langs}


def ruby_types(symbols: DataFrame) -> DataFrame:
    return rel.first_wins(symbols.where("lang = 'ruby' AND kind IN ('class', 'module')").select(F.col("name").alias("fq"), "path"), ["fq"], ["path"])


def rust_types(symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """(fq, path): Rust traits and types by module path and, where one file alone has the name, by name."""
    s = symbols.where("lang = 'rust' AND owner IS NULL AND kind IN ('trait', 'struct', 'enum', 'union', 'type')").select("path", "name")
    full = s.join(modules.select("path", "module"), "path").select(F.concat("module", F.lit("::"), "name").alias("fq"), "path")
    sole = rel.sole_owner(s, token=["name"], owner="path").select(F.col("name").alias("fq"), "path")
    return rel.first_wins(full.unionByName(sole), ["fq"], ["path"])


def language_edges(links: Mapping[str, DataFrame], found: DataFrame, refs: DataFrame, symbols: DataFrame, files: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """Each language's edges: imports, and what else relates its files; for the languages of ``links``."""
    outer = settings.include_external
    made = {lang: ed.from_links(l, lang, external=outer) for lang, l in links.items()}
    types = {
        "java": (lambda: resolve.declared_types(symbols, "java"), "."), "kotlin": (lambda: resolve.declared_types(symbols, "kotlin"), "."),
        "rust": (lambda: rust_types(symbols, resolve.rust_modules(files)), "::"), "ruby": (lambda: ruby_types(symbols), "::"),
    }
    for lang, (make, sep) in types.items():
        if lang in made:
            rel_ = resolve.relations(found, make(), refs, lang, sep)
            made[lang] = made[lang].unionByName(ed.from_relations(rel_, lang, external=outer))
    if "python" in made:
        made["python"] = ed.collapse_package_edges(made["python"])
    if "kotlin" in made:
        tokens = found.where("lang = 'kotlin'").select("path", "package", F.explode("tokens").alias("token"))
        made["kotlin"] = made["kotlin"].unionByName(ed.from_symbols(resolve.symbol_links(tokens, symbols, most=settings.symbol_edges_per_file)))
    if "ruby" in made:
        ruby = made["ruby"].unionByName(ed.from_calls(resolve.ruby_calls(found, symbols))).unionByName(ed.from_associations(resolve.ruby_associations(found, ruby_types(symbols))))
        made["ruby"] = merge.strongest_edges(ruby, ["seq", "spec"], ["spec", "reason", "subkind"])
    return {lang: settle(e) for lang, e in made.items()}


def analyze(spark: SparkSession, source: str | DataFrame, settings: Settings | None = None, *, hook: Hook | None = None, events: Events | None = None) -> Analysis:
    """All tables of a tree, given by its root or as files (path, content, and optionally size, modified)."""
    s, note = (settings or Settings()).checked(), events or Events()
    if isinstance(source, str):
        raw = tree.read_tree(spark, source, include=",".join(s.include), exclude=",".join(s.exclude), maxBytes=str(s.max_file_bytes))
    else:
        raw = source
    for c, default in (("size", F.length("content").cast("long")), ("modified", F.lit(None).cast("timestamp"))):
        if c not in raw.columns:
            raw = raw.withColumn(c, default)
    raw = raw.where("path IS NOT NULL").select("path", paths.extension("path").alias("ext"), tree.language_column("path").alias("lang"), "size", "modified", "content", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))
    if not s.include_tests:
        raw = raw.where(~summary.is_test_file(F.col("path")))
    files = settle(rel.first_wins(raw, ["path"], ["hash"]))
    t: dict[str, DataFrame] = {"files": files, "manifest": files.select("path", "ext", "lang")}

    def done(stage: str) -> None:
        note(f"stage:{stage}")
        if hook:
            hook(stage, t)

    done("manifest")
    code = files.where(F.col("lang").isin(*tree.CODE))
    t["facts"] = settle(extract.facts(code))
    t["refs"] = extract.import_refs(t["facts"])
    if not s.type_checking_imports:
        t["refs"] = t["refs"].where("NOT type_checking")
    if not s.dynamic_imports:
        t["refs"] = t["refs"].where(~F.array_contains("tags", "dynamic"))
    t["symbols"] = extract.symbols(t["facts"])
    t["candidates"] = extract.candidates(t["facts"])
    t["metrics"] = extract.count_docstrings(extract.metrics(code), t["facts"])
    done("facts")
    t["source_roots"] = tree.source_roots(files)
    roots = [r.root for r in t["source_roots"].orderBy("rank").collect() if r.root]
    t["seeds"] = seeds.discover(files, roots)
    t["warnings"] = seeds.warnings(files, roots)
    langs = {r.lang for r in tree.language_counts(code).collect()} | {"python"}  # Python's tables are asked for below
    by_lang = language_links(t["facts"], t["refs"], t["symbols"], files, s, langs | ({"ts"} if "js" in langs else set()))
    t["links"] = ed.union_all({k: v.withColumn("lang", F.lit(k)) for k, v in by_lang.items()})
    done("links")
    made = language_edges(by_lang, t["facts"], t["refs"], t["symbols"], files, s)
    web = F.col("lang").isin("ts", "js")
    py, ts = t["candidates"].where("lang = 'python'"), t["candidates"].where(web)
    t["crosstalk"] = crosstalk.edges(py, ts)
    t["crosstalk_statistics"] = crosstalk.statistics(py, ts)
    made["crosstalk"] = ed.from_crosstalk(t["crosstalk"])
    t["edges"] = settle(merge.dedupe_edges(merge.stacked(made), ["lang_rank", "seq", "spec"]).drop("lang_rank"))
    done("edges")
    t["file_index"] = nd.file_index(t["metrics"], t["facts"], t["links"], t["refs"], files)
    base = t["file_index"].where(F.col("lang").isin(*tree.CODE)).select(
        "id", "file", paths.basename("id").alias("name"), "lang", "package", "parse_status", *lines.COUNTS, "comment_pct", "size", "hash",
        F.col("imports_internal").alias("imports"), F.col("imports_all").alias("imports_all_raw"), "imports_external", "import_style_counts",
    )
    base = base.join(nd.symbol_lists(t["facts"]), "id", "left")
    if s.include_external:
        base = base.unionByName(nd.stubs(base, t["edges"]).withColumn("lang", F.lit("external")), allowMissingColumns=True)
    inner = graph.adjacency(t["edges"], base)
    both, t["cycles"] = graph.cycles(base, t["edges"])
    entry = t["seeds"].select(F.col("file").alias("id")).distinct()
    t["distances"] = graph.distances(base, inner, entry, small=graph.GROUP)
    t["nodes"] = settle(nd.with_degrees(base, inner).join(both, "id", "left").join(t["distances"], "id", "left"))
    reach = graph.hops(inner, entry, small=graph.GROUP)
    t["node_order"] = graph.node_order(reach)
    done("graph")
    t["zones"] = zones.build(t["nodes"].select("id", "file"))
    t["package_rollup"] = nd.package_rollup(t["nodes"].select(zones.package_of("id").alias("zone"), "file", "parse_status", *lines.COUNTS, "functions", "classes", "imports"), "zone")
    t["imports_split"] = imports.split_imports(t["file_index"].select("id", "file", "imports_all", "imports_internal", "imports_external"), imports.own_packages(t["file_index"]))
    t["third_party"] = imports.third_party_usage(t["imports_split"])
    done("zones")
    plain = code.select(F.col("path").alias("file"), F.col("content").alias("text"))
    t["clone_groups"], t["clone_members"], fallback = clones.report(plain, k=s.clone_lines, idents=s.clone_idents)
    note("clones", fallback=fallback)
    pylinks = by_lang["python"]
    pyfiles = files.where("lang = 'python'")
    credit = deadcode.credits(t["facts"], pylinks)
    every = deadcode.starred(pylinks, t["refs"])
    names, lost = deadcode.unused_names(t["facts"], t["symbols"], credit, every), deadcode.unused_imports(t["facts"])
    # packages whose edges were collapsed still run when a module of theirs is imported
    reached = inner.union(ed.from_links(pylinks, "python").select("src", "dst"))
    dead = deadcode.dead_modules(pyfiles, reached, deadcode.roots_of(pyfiles, entry))
    t["dead_code"] = deadcode.report(pyfiles, dead, names, lost)
    t["discovery"] = nd.discovery(t["manifest"], t["nodes"])
    t["coverage"] = rel.coverage(t["file_index"].where("eligible").select("id"), t["nodes"].select("id"), "id")
    done("reports")
    return Analysis(t, s, note)


def summary_tables(a: Analysis) -> dict[str, DataFrame]:
    """The summary as small tables, each one aggregate."""
    n, e = a.nodes, a.edges
    funcs = a.symbols.where("kind IN ('function', 'method')").select("docstring", F.size("params").alias("n_params"))
    env = a.candidates.where("kind = 'env_ref'").select(F.col("meta")["var"].alias("var"), F.col("node_id").alias("file"))
    member = zones.zone_of(a.zones)
    return {
        "counts": summary.counts(nodes=n, edges=e, zones=a.zones, node_order=a.node_order, files=a.file_index), "loc": summary.size_totals(n), "largest_files": summary.largest_files(n),
        "parse_status": summary.parse_states(n, a.file_index), "edge_kinds": summary.edge_kinds(e), "hotspots": summary.hotspots(n, e), "largest_zones": zones.largest(a.zones),
        "cross_zone_edges": zones.cross_edges(e, member), "import_styles": summary.style_totals(a.file_index), "code_metrics": summary.code_metrics(n), "crosstalk": summary.crosstalk_totals(a.candidates),
        "api_surface": summary.api_surface(funcs, a.symbols.where("kind = 'class'")), "environment": summary.environment(env), "environment_totals": summary.environment_totals(env),
        "http_contracts": summary.http_contracts(a.candidates), "testing": summary.testing(n), "change_risk": summary.risky(n), "cycles": a.cycles,
        "import_totals": imports.totals(a.imports_split), "top_packages": a.third_party, "languages": summary.languages(n),
    }


def _plain(df: DataFrame) -> list[dict]:
    return [json.loads(r.value) for r in df.select(F.to_json(F.struct(*df.columns)).alias("value")).toLocalIterator()]


def bundle(a: Analysis, *, compact: bool = False, name: str = "", edges_as_bundle: bool = True) -> dict:
    """The one JSON document of an analysis; keys that would be empty or null are left out of records."""
    e = ed.whitelisted(a.edges)
    if edges_as_bundle:
        e = ed.bundle_direction(e)
    doc = {
        "schema_version": SCHEMA, "meta": {"repo_name": name, "mode": a.settings.mode, "generated_at": f"{datetime.now(timezone.utc):%FT%TZ}"},
        "nodes": _plain(a.nodes.orderBy("id")), "edges": _plain(e.orderBy("src", "dst", "kind", "subkind")), "zones": _plain(a.zones.orderBy("seq")),
        "node_order": [r.id for r in a.node_order.orderBy("gen", "gen_idx").select("id").toLocalIterator()], "summary": {k: _plain(v) for k, v in summary_tables(a).items()},
        "discovery": _plain(a.discovery), "seeds": _plain(a.seeds), "warnings": _plain(a.warnings), "dead_code": _plain(a.dead_code.orderBy("path")), "clone_groups": _plain(a.clone_groups.orderBy("group_id")),
    }
    return codec.compress_bundle(doc) if compact else doc


def graph_document(a: Analysis, *, positions: DataFrame | None = None) -> dict:
    """The graph alone as one document: nodes with their names and places (id, x, y, if given), edges, seeds."""
    n = a.nodes.select("id", "file", "name", "lang", "scc_id", "scc_size")
    n = n if positions is None else n.join(positions.select("id", F.struct("x", "y").alias("pos")), "id", "left")
    head = {"schema_version": SCHEMA, "signature": graph.signature(a.nodes, a.edges).first()[0]}
    return head | {"nodes": _plain(n.orderBy("id")), "edges": _plain(ed.whitelisted(a.edges).orderBy("src", "dst", "kind")), "seeds": _plain(a.seeds)}


OUTPUTS = ("manifest", "symbols", "links", "candidates", "edges", "file_index", "nodes", "node_order", "zones", "package_rollup", "imports_split", "third_party", "seeds", "warnings", "crosstalk", "clone_groups", "clone_members", "dead_code", "discovery", "coverage", "cycles")


def save(a: Analysis, folder: str) -> None:
    """Every table as Parquet below ``folder``, the summary's below ``folder``/summary."""
    from weftgraph.sources.stores import save_tables

    save_tables({k: a.tables[k] for k in OUTPUTS}, folder)
    save_tables(summary_tables(a), f"{folder}/summary")


def follow_up(index: DataFrame, covered: DataFrame) -> DataFrame:
    """Eligible files (id) that are not covered yet: what an incremental run has to do."""
    return rel.missing_from(index.where("eligible").select("id"), covered, ["id"])
