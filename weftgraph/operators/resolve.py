"""Import specs to files, language by language: compositions of prefix, candidate and ranking joins.

Every resolver takes import references (path, seq, module, names, is_from, level, kind, tags,
type_checking, package) and returns links (path, seq, spec, target, state, reason, type_checking): one
row a spec and target, target null and state "external" or "unresolved" where there is none. Specs are
resolved once each, not once an importer, wherever the importer doesn't matter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import paths

from .relational import first_candidate, first_wins, longest_prefix, nearest_ancestor, sole_owner
from .storage import settle

LINK = ("path", "seq", "spec", "target", "state", "reason", "type_checking")


def _links(df: DataFrame, hit: str, miss: Column | str = "not_found", state: Column | None = None) -> DataFrame:
    """Links of rows with a target or null."""
    found = F.col("target").isNotNull()
    why = F.lit(miss) if isinstance(miss, str) else miss
    s = F.when(found, F.lit("internal")).otherwise(F.lit("external") if state is None else state)
    return df.select("path", "seq", "spec", "target", s.alias("state"), F.when(found, F.coalesce("hit", F.lit(hit)) if "hit" in df.columns else F.lit(hit)).otherwise(why).alias("reason"), "type_checking")


# == Python


def python_modules(files: DataFrame, roots: list[str]) -> DataFrame:
    """(module, path, is_package): dotted ids of Python files, below a source root without its name; the first path wins an id."""
    p = F.col("path")
    top = F.substring_index(p, "/", 1)
    inner = F.when(p.contains("/") & top.isin(roots), F.regexp_replace(p, "^[^/]+/", "")).otherwise(p) if roots else p
    m = F.regexp_replace(paths.module_for_path(inner), r"^__init__$", "")
    rows = files.where((F.col("lang") == "python") & p.isNotNull()).select(m.alias("module"), p, (paths.basename(p) == "__init__.py").alias("is_package"))
    return first_wins(rows.where("module <> ''"), ["module"], ["path"])


def python_specs(refs: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, seq, spec, type_checking): the absolute dotted targets of each import, one rule for relative ones, that of the language."""
    j = refs.where("lang = 'python'").join(modules.select("path", F.col("module").alias("consumer"), "is_package"), "path", "left")
    token = F.concat(F.repeat(F.lit("."), F.coalesce(F.col("level"), F.lit(0))), F.coalesce("module", F.lit("")))
    base = paths.absolute_module(token, F.coalesce("consumer", F.lit("")), F.coalesce("is_package", F.lit(False)))
    names = F.transform("names", lambda n: n["name"])
    star = F.array_contains(names, "*")
    targets = F.when(F.col("is_from"), paths.import_targets(base, names, star)).when(F.size("names") > 0, names).otherwise(F.array_compact(F.array("module")))
    return j.select("path", "seq", F.explode(targets).alias("spec"), "type_checking")


def python(refs: DataFrame, modules: DataFrame) -> DataFrame:
    """The exact module, or the nearest that the spec lies in; ``from a import b`` means a.b if there is one, and a."""
    specs = python_specs(refs, modules)
    best = longest_prefix(specs, modules, spec="spec", ident="module")
    j = specs.join(best, "spec", "left").join(modules.select("module", F.col("path").alias("target")), "module", "left")
    kept = j.where(F.col("target").isNull() | (F.col("target") != F.col("path")))
    exact = F.when(F.col("module") == F.col("spec"), F.lit("exact")).otherwise(F.lit("prefix"))
    return _links(kept.withColumn("hit", exact), "exact")


def python_cascade(tokens: DataFrame, modules: DataFrame, *, consumer_prefix: bool = False) -> DataFrame:
    """(token, consumer, target, rank) of tokens in whatever spelling: an id, a shortened id, one below the consumer's packages, a file."""
    t = F.col("token")
    short = paths.shortened(t)
    lists = [F.array(t), short]
    if consumer_prefix:
        ups = paths.prefixes(F.coalesce("consumer", F.lit("")))
        lists.append(F.flatten(F.transform(ups, lambda u: F.transform(short, lambda s: F.concat(u, F.lit("."), s)))))
    known = modules.select(F.col("module").alias("id"), "path").union(modules.select("path", "path"))
    known = first_wins(known, ["id"], ["path"])
    lists.append(F.array(paths.file_id(t), paths.file_id(t, init=True)))
    hit = first_candidate(tokens, known, key=["token", "consumer"], candidates=F.array_distinct(F.flatten(F.array(*lists))), ident="id")
    return hit.join(known, "id").select("token", "consumer", F.col("path").alias("target"), "rank")


def hard_and_soft(links: DataFrame, symbols: DataFrame, modules: DataFrame, facades: DataFrame, patterns: tuple[str, ...] | None) -> DataFrame:
    """Links with ``strength``: hard where an import meets its file, soft where only the package answers.

    For a spec pkg.name that met only the package, soft targets are the modules of the package that
    define name at top level, and, where the package has __getattr__ (``facades``: path), its children
    (those that meet ``patterns``; None: none).
    """
    hard = links.where("target IS NOT NULL").withColumn("strength", F.when(F.col("reason") == "exact", F.lit("hard")).otherwise(F.lit("parent")))
    parents = hard.where("strength = 'parent'").join(modules.select(F.col("path").alias("target"), F.col("module").alias("pkg"), "is_package").where("is_package"), "target")
    parents = parents.withColumn("name", F.substring_index("spec", ".", -1)).where(F.col("spec") == F.concat("pkg", F.lit("."), "name"))
    children = modules.select(F.regexp_replace("module", r"\.[^.]+$", "").alias("pkg"), F.col("path").alias("child")).where(F.col("pkg") != "")
    defs = symbols.where("owner IS NULL AND kind IN ('function', 'class', 'global')").select(F.col("path").alias("child"), "name").distinct()
    a = parents.join(children.join(defs, "child"), ["pkg", "name"]).select(*[c for c in LINK if c not in ("target", "reason")], F.col("child").alias("target"), F.lit("facade").alias("reason"))
    soft = a
    if patterns is not None:
        kids = children.where(paths.matches_glob(paths.basename("child"), patterns)) if patterns else children
        b = parents.join(facades.select(F.col("path").alias("target")), "target", "left_semi").join(kids, "pkg")
        soft = a.unionByName(b.select(*[c for c in LINK if c not in ("target", "reason")], F.col("child").alias("target"), F.lit("dynamic_package").alias("reason")))
    soft = soft.where("target <> path").distinct().withColumn("strength", F.lit("soft"))
    return hard.unionByName(soft)


# == TypeScript and JavaScript


def _loose_json(text: str | None) -> dict:
    """A JSON object with comments and trailing commas; {} for what doesn't parse."""
    s = re.sub(r"(\"(?:\\.|[^\"\\])*\")|//[^\n]*|/\*.*?\*/", lambda m: m[1] or "", text or "", flags=re.S)
    try:
        d = json.loads(re.sub(r",(\s*[}\]])", r"\1", s))
    except ValueError:
        return {}
    return d if isinstance(d, dict) else {}


def ts_configs(files: DataFrame) -> DataFrame:
    """(config, folder, base, extends, paths): alias maps of tsconfig and jsconfig files (path, content); an own base is relative to the root."""
    schema = "config string, base string, extends string, paths array<struct<pattern:string,targets:array<string>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                d = _loose_json(text)
                o = d.get("compilerOptions") if isinstance(d.get("compilerOptions"), dict) else {}
                p = o.get("paths") if isinstance(o.get("paths"), dict) else {}
                ext = d.get("extends") if isinstance(d.get("extends"), str) else None
                rows.append({"config": path, "base": o.get("baseUrl"), "extends": ext, "paths": [{"pattern": k, "targets": [str(x) for x in v]} for k, v in p.items() if isinstance(v, list)]})
            kind = pa.schema([("config", pa.string()), ("base", pa.string()), ("extends", pa.string()), ("paths", pa.list_(pa.struct([("pattern", pa.string()), ("targets", pa.list_(pa.string()))])))])
            yield pa.RecordBatch.from_pylist(rows, kind)

    configs = files.where(paths.basename("path").rlike(r"^(ts|js)config(\.[\w-]+)?\.json$"))
    raw = configs.select("path", "content").mapInArrow(run, schema)
    folder = paths.dirname("config")
    up = F.when(F.col("extends").rlike(r"^\.\.?/"), paths.join_relative("config", F.when(F.col("extends").endswith(".json"), F.col("extends")).otherwise(F.concat("extends", F.lit(".json")))))
    own = F.when(F.col("base").isNotNull(), paths.fold_dots(F.concat(folder, F.lit("/"), "base")))
    return raw.select("config", folder.alias("folder"), F.regexp_replace(own, "^/", "").alias("base"), up.alias("extends"), "paths")


def effective_configs(configs: DataFrame) -> DataFrame:
    """``configs`` with what they extend folded in: the child's patterns override, its base too if it has one.

    A chain ends at a file that isn't there and at one that it has been through.
    """
    now = configs.withColumn("seen", F.array("config"))
    while not now.where("extends IS NOT NULL").isEmpty():
        parent = configs.select(F.col("config").alias("extends"), F.col("base").alias("pb"), F.col("folder").alias("pf"), F.col("paths").alias("pp"), F.col("extends").alias("pe"))
        j = now.join(parent, "extends", "left")
        more = F.filter(F.coalesce("pp", F.array().cast(configs.schema["paths"].dataType)), lambda x: ~F.exists("paths", lambda y: y["pattern"] == x["pattern"]))
        base = F.coalesce("base", "pb", F.when(F.size("paths") == 0, F.col("pf")))
        seen = F.array_append("seen", F.col("extends"))
        nxt = F.when(~F.coalesce(F.array_contains(seen, F.col("pe")), F.lit(False)), F.col("pe"))
        now = settle(j.select("config", "folder", base.alias("base"), nxt.alias("extends"), F.concat("paths", more).alias("paths"), F.when(F.col("extends").isNotNull(), seen).otherwise(F.col("seen")).alias("seen")))
    return now.withColumn("base", F.coalesce("base", "folder")).drop("seen")


def web(refs: DataFrame, files: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """Relative and rooted specs against the files themselves; bare ones by the aliases of the root's tsconfig.json, then those of the nearest config.

    The rest is external (bare, url) or unresolved.
    """
    r = refs.where("lang IN ('ts', 'js') AND module IS NOT NULL AND length(module) <= 512").withColumn("spec", F.col("module"))
    kind = paths.spec_kind("spec")
    plain = paths.strip_query_and_hash("spec")
    base = F.when(kind == "relative", paths.join_relative("path", plain)).when(kind == "absolute", paths.fold_dots(F.regexp_replace(plain, "^/+", "")))
    local = r.withColumn("base", base)
    direct = first_candidate(local.where("base IS NOT NULL"), files, key=["path", "seq"], candidates=paths.web_candidates(F.col("base")), ident="target_path") if "target_path" in files.columns else first_candidate(
        local.where("base IS NOT NULL"), files.select(F.col("path").alias("target")), key=["path", "seq"], candidates=paths.web_candidates(F.col("base")), ident="target"
    )
    found = direct.select("path", "seq", F.col("target").alias("direct"))
    j = r.join(found, ["path", "seq"], "left")
    if configs is not None:
        near = nearest_ancestor(r, configs, path="path", folder="folder")
        one = first_wins(configs, ["folder"], [F.when(paths.basename("config") == "tsconfig.json", 0).otherwise(1), "config"])
        root = r.select("path").distinct().select("path", F.lit("").alias("folder"), F.lit(0).alias("turn"))
        root = root.join(configs.where("config = 'tsconfig.json'").select("folder").distinct(), "folder", "left_semi")
        near = near.where("folder IS NOT NULL").withColumn("turn", F.lit(1)).unionByName(root)
        a = r.where(paths.spec_kind("spec") == "bare").join(near, "path").join(one.select("folder", F.col("base").alias("root"), "paths"), "folder").select("path", "seq", "turn", "spec", "root", F.explode("paths").alias("p"))
        star = _capture(F.col("spec"), F.col("p.pattern"))
        tried = F.transform("p.targets", lambda t: paths.fold_dots(F.concat("root", F.lit("/"), F.replace(t, F.lit("*"), star))))
        cand = F.flatten(F.transform(tried, lambda t: paths.web_candidates(F.regexp_replace(t, "^/+", ""))))
        hits = a.where(star.isNotNull()).withColumn("cand", cand).withColumn("width", F.length("p.pattern"))
        best = first_candidate(hits, files.select(F.col("path").alias("target")), key=["path", "seq", "turn", "width"], candidates=F.col("cand"), ident="target")
        alias = best.groupBy("path", "seq").agg(F.max_by("target", F.struct(-F.col("turn"), "width")).alias("alias"))
        j = j.join(alias, ["path", "seq"], "left")
    else:
        j = j.withColumn("alias", F.lit(None).cast("string"))
    j = j.withColumn("target", F.coalesce("direct", "alias")).withColumn("hit", F.when(F.col("direct").isNotNull(), kind).otherwise(F.lit("alias")))
    state = F.when(kind.isin("bare", "url"), F.lit("external")).otherwise(F.lit("unresolved"))
    return _links(j.where(F.col("target").isNull() | (F.col("target") != F.col("path"))), "direct", kind, state)


def _capture(spec: Column, pattern: Column) -> Column:
    """What a pattern's one * stands for in a spec; "" for an exact match, null for none."""
    before, after = F.substring_index(pattern, "*", 1), F.regexp_replace(pattern, r"^[^*]*\*", "")
    fits = spec.startswith(before) & spec.endswith(after) & (F.length(spec) >= F.length(before) + F.length(after))
    return F.when(~pattern.contains("*"), F.when(spec == pattern, F.lit(""))).when(fits, F.substr(spec, F.length(before) + 1, F.length(spec) - F.length(before) - F.length(after)))


# == Go


def go_modules(files: DataFrame) -> DataFrame:
    """(folder, module) of every go.mod (path, content)."""
    m = F.regexp_extract("content", r"(?m)^\s*module\s+\"?([^\s\"]+)", 1)
    return files.where(paths.basename("path") == "go.mod").select(paths.dirname("path").alias("folder"), m.alias("module")).where("module <> ''")


def main_go_module(files: DataFrame) -> DataFrame:
    """The one module that covers most Go files; ties: the deeper, then the first by path."""
    mods = go_modules(files)
    near = nearest_ancestors(files.where("lang = 'go'"), mods)
    n = near.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    deep = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    return mods.join(n, "folder", "left").orderBy(F.coalesce("n", F.lit(0)).desc(), deep.desc(), "folder").limit(1).select("folder", "module")


def nearest_ancestors(files: DataFrame, folders: DataFrame) -> DataFrame:
    """(path, folder): every known folder that holds a path, not only the deepest."""
    ups = files.select("path", F.explode(F.concat(paths.prefixes(paths.dirname("path"), "/"), F.array(F.lit("")))).alias("folder"))
    return ups.join(folders.select("folder").distinct(), "folder")


def go_packages(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(package_id, folder, representative): packages by import path; doc.go represents one, else the first file that isn't a test."""
    go = files.where((F.col("lang") == "go") & F.col("path").endswith(".go")).select("path", paths.dirname("path").alias("dir"))
    near = nearest_ancestor(go, modules, path="path", folder="folder")
    j = go.join(near, "path").join(modules, "folder", "left")
    below = F.when(F.col("folder") == "", F.col("dir")).otherwise(F.regexp_replace(F.expr("substring(dir, length(folder) + 1)"), "^/", ""))
    pid = F.when(F.col("module").isNull(), F.col("dir")).when(below == "", F.col("module")).otherwise(F.concat("module", F.lit("/"), below))
    base = paths.basename("path")
    order = [F.when(base == "doc.go", 0).when(base.endswith("_test.go"), 2).otherwise(1), "path"]
    return first_wins(j.select(pid.alias("package_id"), "dir", "path"), ["package_id"], order).select("package_id", F.col("dir").alias("folder"), F.col("path").alias("representative"))


def go(refs: DataFrame, packages: DataFrame) -> DataFrame:
    """The package of that import path, or the nearest above it; targets are representative files."""
    r = refs.where("lang = 'go'").withColumn("spec", paths.go_spec("module")).where("spec <> ''")
    best = longest_prefix(r, packages, spec="spec", ident="package_id", sep="/")
    j = r.join(best, "spec", "left").join(packages.select("package_id", F.col("representative").alias("target"), "folder"), "package_id", "left")
    own = F.col("folder").isNotNull() & (F.col("folder") == paths.dirname("path"))
    kind = paths.go_import_kind("spec", F.lit(""))
    hit = F.when(F.col("package_id") == F.col("spec"), F.lit("exact")).otherwise(F.lit("prefix"))
    return _links(j.where(~own).withColumn("hit", hit), "exact", kind)


# == Java and Kotlin


def declared_types(symbols: DataFrame, lang: str, sep: str = ".") -> DataFrame:
    """(fq, path, package, name): top-level types by qualified name, the first path wins."""
    kinds = ("class", "interface", "enum", "record", "annotation", "object", "type", "function", "property") if lang == "kotlin" else ("class", "interface", "enum", "record", "annotation")
    s = symbols.where((F.col("lang") == lang) & F.col("kind").isin(*kinds) & F.col("owner").isNull())
    return first_wins(s.select(paths.qualified(F.coalesce("package", F.lit("")), "name", sep=sep).alias("fq"), "path", "package", "name"), ["fq"], ["path"])


def collisions(symbols: DataFrame, lang: str) -> DataFrame:
    """(fq, files) of types that two files or more declare."""
    s = symbols.where((F.col("lang") == lang) & F.col("kind").isin("class", "interface", "enum", "record", "annotation"))
    g = s.groupBy(paths.qualified(F.coalesce("package", F.lit("")), "name").alias("fq")).agg(F.array_sort(F.collect_set("path")).alias("files"))
    return g.where(F.size("files") > 1)


_JDK = r"^(static:)?(java|javax|jdk|sun|com\.sun|org\.w3c|org\.xml|org\.ietf|netscape)\."


def java(refs: DataFrame, types: DataFrame, packages: DataFrame) -> DataFrame:
    """Types by name, wildcards by every file of the package (path, package), static members by their owner."""
    r = refs.where("lang = 'java' AND module IS NOT NULL")
    wild, static = F.array_contains("tags", "wildcard"), F.col("kind") == "static"
    r = r.withColumn("spec", paths.java_spec("module", wild, static))
    owner = F.regexp_replace("module", r"\.[^.]+$", "")
    direct = first_candidate(r.where(~wild | static), types.select("fq"), key=["path", "seq"], candidates=F.when(static & ~wild, F.array("module", owner)).otherwise(F.array("module")), ident="fq")
    one = direct.join(types.select("fq", F.col("path").alias("target")), "fq").select("path", "seq", "target", F.lit("type").alias("hit"))
    fan = r.where(wild).select("path", "seq", F.col("module").alias("pk")).join(packages.select(F.col("package").alias("pk"), F.col("path").alias("target")).distinct(), "pk")
    hits = one.unionByName(fan.select("path", "seq", "target", F.lit("wildcard_package").alias("hit")))
    j = r.join(hits, ["path", "seq"], "left").where("target IS NULL OR target <> path")
    root = F.array_join(F.slice(F.split("module", r"\."), 1, 2), ".")
    ours = packages.select(F.array_join(F.slice(F.split("package", r"\."), 1, 2), ".").alias("root")).where("root <> ''").distinct().withColumn("ours", F.lit(True))
    j = j.withColumn("root", root).join(ours, "root", "left")
    why = F.when(F.col("spec").rlike(_JDK), F.lit("stdlib")).when(F.col("ours"), F.lit("internal_unresolved")).otherwise(F.lit("third_party"))
    return _links(j, "type", why)


def kotlin(refs: DataFrame, decls: DataFrame, packages: DataFrame) -> DataFrame:
    """The platform stays external; then wildcards by package, declarations by name, members by the nearest owner (three parts or more)."""
    r = refs.where("lang = 'kotlin' AND module IS NOT NULL")
    wild = F.array_contains("tags", "wildcard")
    r = r.withColumn("spec", paths.kotlin_spec("module", wild))
    inner = r.where(~paths.kotlin_is_platform("spec"))
    walk = F.when(F.size(F.split("module", r"\.")) >= 3, paths.prefixes(F.col("module"))).otherwise(F.array("module"))
    direct = first_candidate(inner.where(~wild), decls.select("fq"), key=["path", "seq"], candidates=walk, ident="fq")
    one = direct.join(decls.select("fq", F.col("path").alias("target")), "fq").select("path", "seq", "target", F.when(F.col("rank") == 0, F.lit("direct")).otherwise(F.lit("owner_decl")).alias("hit"))
    fan = inner.where(wild).select("path", "seq", F.col("module").alias("pk")).join(packages.select(F.col("package").alias("pk"), F.col("path").alias("target")).distinct(), "pk")
    j = r.join(one.unionByName(fan.select("path", "seq", "target", F.lit("wildcard_package").alias("hit"))), ["path", "seq"], "left").where("target IS NULL OR target <> path")
    why = F.when(paths.kotlin_is_platform("spec"), F.lit("default_or_stdlib")).when(wild, F.lit("package_not_found")).otherwise(F.lit("decl_not_found"))
    return _links(j, "direct", why)


_WEAK = frozenset(w for b in "html text table tag date calendar time product customer order city".split() for w in (b, b.capitalize())) | {"HTML"}


def symbol_links(tokens: DataFrame, symbols: DataFrame, *, lang: str = "kotlin", most: int = 25) -> DataFrame:
    """(path, target, reason): files whose names a file uses without an import.

    A token counts if exactly one other file declares it: in the same package first, then, for capitalised
    ones, anywhere. At most ``most`` targets a file, in order of reason, then token.
    """
    kinds = {"class": "global_symbol", "interface": "global_symbol", "object": "global_symbol", "enum": "global_symbol", "type": "global_symbol", "function": "top_level_function", "property": "property"}
    s = symbols.where((F.col("lang") == lang) & F.col("owner").isNull() & F.col("kind").isin(*kinds))
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    d = s.select("path", F.coalesce("package", F.lit("")).alias("package"), F.col("name").alias("token"), table[F.col("kind")].alias("reason")).distinct()
    use = tokens.where(~F.col("token").isin(*sorted(_WEAK))).select("path", F.coalesce("package", F.lit("")).alias("package"), "token").distinct()
    use = use.join(d.select("path", "token").distinct(), ["path", "token"], "left_anti")
    near = sole_owner(d.where("package <> ''"), token=["package", "token"], owner="path").withColumnRenamed("path", "target")
    a = use.join(near, ["package", "token"]).select("path", "token", "target", F.lit(0).alias("rank"), F.lit("same_package_symbol").alias("reason"))
    far = sole_owner(d, token=["token", "reason"], owner="path").withColumnRenamed("path", "target")
    order = F.when(F.col("reason") == "global_symbol", 1).when(F.col("reason") == "top_level_function", 2).otherwise(3)
    b = use.where(F.col("token").rlike("^[A-Z]")).join(far, "token").select("path", "token", "target", order.alias("rank"), "reason")
    first = first_wins(a.unionByName(b).where("path <> target"), ["path", "target"], ["rank", "token"])
    w = Window.partitionBy("path").orderBy("rank", "token")
    return first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("path", "target", "reason")


# == Rust


def rust_modules(files: DataFrame) -> DataFrame:
    """(crate, module, path): modules by path below src, per crate (the folder that holds src); the first path wins."""
    p = F.col("path")
    crate = F.regexp_replace(p, r"(^|/)src/.*$", "")
    rows = files.where("lang = 'rust'").select(crate.alias("crate"), paths.rust_module_of(p).alias("module"), "path").where("module IS NOT NULL")
    return first_wins(rows, ["crate", "module"], [F.when(paths.basename(p).isin("lib.rs"), 0).otherwise(1), "path"])


def rust(refs: DataFrame, modules: DataFrame) -> DataFrame:
    """Use paths seen from their module: exact, the nearest module above, or for globs every module below; ``mod x`` names its child."""
    r = refs.where("lang = 'rust' AND module IS NOT NULL").join(modules.select("path", "crate", F.col("module").alias("here")), "path", "left")
    glob = F.array_contains("tags", "wildcard")
    full = F.when(F.col("kind") == "mod", F.concat("here", F.lit("::"), "module")).otherwise(paths.rust_in_context("module", F.coalesce("here", F.lit("crate"))))
    r = r.withColumn("full", full).withColumn("spec", F.when(F.col("kind") == "mod", F.col("module")).otherwise(paths.rust_spec("full", glob, F.col("kind") == "reexport")))
    m = modules.select("crate", F.col("module").alias("id"), F.col("path").alias("target"))
    one = r.where(~glob).select("path", "seq", "crate", F.when(F.col("kind") == "mod", F.array("full")).otherwise(paths.prefixes(F.col("full"), "::")).alias("c"))
    one = one.select("path", "seq", "crate", F.posexplode("c").alias("rank", "id")).join(m, ["crate", "id"]).groupBy("path", "seq").agg(F.min_by("target", "rank").alias("target"), F.min("rank").alias("rank"))
    one = one.select("path", "seq", "target", F.when(F.col("rank") == 0, F.lit("exact")).otherwise(F.lit("parent")).alias("hit"))
    below = modules.select("crate", F.explode(paths.prefixes(F.col("module"), "::")).alias("full"), F.col("path").alias("target"))
    fan = r.where(glob).select("path", "seq", "crate", "full").join(below, ["crate", "full"]).select("path", "seq", "target", F.lit("glob").alias("hit"))
    j = r.join(one.unionByName(fan), ["path", "seq"], "left").where("target IS NULL OR target <> path")
    why = F.when(F.substring_index("full", "::", 1).isin("crate", "self", "super"), F.lit("module_not_found")).otherwise(F.lit("external_crate"))
    return _links(j, "exact", why)


# == Ruby

GEMS = (
    "abbrev active_model active_record active_support action_controller action_mailer action_view base64 benchmark bigdecimal bundler cgi coverage csv date delegate digest drb English "
    "erb etc fiddle fileutils find forwardable getoptlong io ipaddr irb json logger matrix minitest monitor net nokogiri objspace observer open-uri open3 openssl optparse ostruct pathname "
    "pp prettyprint prime psych pstore rack rails rake rdoc readline redis resolv rexml rinda ripper rspec rubygems securerandom set shellwords sidekiq singleton socket stringio strscan "
    "tempfile test thor thread time timeout tmpdir tsort uri weakref webrick yaml zlib"
).split()


def ruby_providers(files: DataFrame) -> DataFrame:
    """(key, target): what a require may name a file by: its path, and its path below each lib, app/*, spec or test folder, all without .rb."""
    p = F.regexp_replace("path", r"\.rb$", "")
    below = F.regexp_replace(p, r"^(?:.*/)?(?:lib|spec|test|app/[^/]+)/", "")
    return files.where("lang = 'ruby'").select(F.explode(F.array_distinct(F.array(p, below))).alias("key"), F.col("path").alias("target"))


def _ruby_root(path: Column) -> Column:
    parts = F.split(path, "/")
    at = F.array_min(F.filter(F.transform(parts, lambda x, i: F.when(x.isin(*"app config features lib spec test".split()), i)), lambda x: x.isNotNull()))
    return F.when(at.isNotNull(), F.array_join(F.slice(parts, 1, at), "/")).when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(F.lit(""))


def best_provider(pairs: DataFrame, key: list[str]) -> DataFrame:
    """The best target of each key's candidates (path, target): of the same package root, sharing most folders, nearest in depth, last by name."""
    a, b = F.split("path", "/"), F.split("target", "/")
    order = [(_ruby_root(F.col("path")) == _ruby_root(F.col("target"))).desc(), paths.common_prefix_length(a, b).desc(), F.abs(F.size(a) - F.size(b)), F.desc("target")]
    return first_wins(pairs, key, order)


def ruby(refs: DataFrame, providers: DataFrame, types: DataFrame) -> DataFrame:
    """Gems and the standard library stay external; relative requires by path; others by the best provider, then by the constant they spell."""
    r = refs.where("lang = 'ruby' AND module IS NOT NULL").withColumn("spec", paths.ruby_spec("module")).where("spec <> ''")
    relative = F.col("kind") == "require_relative"
    gem = ~relative & paths.ruby_is_known_gem("spec", GEMS) & (~F.col("spec").contains("/") | paths.ruby_is_known_gem("spec", [g for g in GEMS if g not in ("rack", "test")]))
    key = F.when(relative, paths.join_relative("path", F.regexp_replace("module", r"\.rb$", ""))).otherwise(F.col("spec"))
    r = r.withColumn("key", key).withColumn("gem", gem)
    pairs = r.where("NOT gem").select("path", "seq", "key").join(providers, "key").where("path <> target")
    one = best_provider(pairs, ["path", "seq"]).select("path", "seq", "target", F.lit("require_index").alias("hit"))
    rest = r.where("NOT gem").join(one, ["path", "seq"], "left_anti").withColumn("fq", paths.camelize("spec"))
    const = rest.join(types.select("fq", F.col("path").alias("target")), "fq").select("path", "seq", "target", F.lit("fq_decl_match").alias("hit"))
    j = r.join(one.unionByName(const), ["path", "seq"], "left").where("target IS NULL OR target <> path")
    return _links(j, "require_index", F.when(F.col("gem"), F.lit("stdlib_or_gem")).otherwise(F.lit("spec_not_found")))


def ruby_calls(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, target, spec, confidence): calls Const.method of a method that another file declares."""
    m = symbols.where("lang = 'ruby' AND owner IS NOT NULL").select(F.concat("owner", F.lit("."), "name").alias("spec"), F.col("path").alias("target"))
    first = first_wins(m, ["spec"], ["target"])
    uses = found.where("lang = 'ruby'").select("path", F.explode("method_uses").alias("u")).select("path", F.concat("u.base", F.lit("."), "u.attr").alias("spec")).distinct()
    return uses.join(first, "spec").where("path <> target").select("path", "target", "spec", F.lit(0.8).alias("confidence"))


def ruby_associations(found: DataFrame, types: DataFrame) -> DataFrame:
    """(path, kind, name, target): Rails associations by the class they name; target null where no file declares it."""
    a = found.where("lang = 'ruby'").select("path", F.explode("relations").alias("r")).where(F.col("r.kind").startswith("association:"))
    a = a.select("path", F.substring_index("r.kind", ":", -1).alias("kind"), F.col("r.object").alias("name")).distinct()
    cls = F.when(F.col("name").rlike("^[A-Z]"), F.col("name")).otherwise(paths.association_class("name"))
    return a.withColumn("fq", cls).join(types.select("fq", F.col("path").alias("target")), "fq", "left").select("path", "kind", "name", "fq", "target")


def relations(found: DataFrame, types: DataFrame, refs: DataFrame, lang: str, sep: str = ".") -> DataFrame:
    """(path, kind, subject, object, target): what types extend, implement or derive, met by full name, import, then package."""
    r = found.where(F.col("lang") == lang).select("path", "package", F.explode("relations").alias("r")).select("path", "package", "r.*").where("object <> '' AND kind NOT LIKE 'association:%'")
    named = refs.where(F.col("lang") == lang).select("path", F.substring_index("module", sep, -1).alias("object"), F.col("module").alias("imported"))
    named = named.groupBy("path", "object").agg(F.min("imported").alias("imported"))
    j = r.join(named, ["path", "object"], "left")
    cand = F.array_compact(F.array("object", "imported", F.concat(F.coalesce("package", F.lit("")), F.lit(sep), "object")))
    hit = first_candidate(j, types.select("fq"), key=["path", "kind", "object"], candidates=cand, ident="fq").join(types.select("fq", F.col("path").alias("target")), "fq")
    return j.drop("imported", "package").distinct().join(hit.select("path", "kind", "object", "target").distinct(), ["path", "kind", "object"], "left").select("path", "kind", "subject", "object", "target")
