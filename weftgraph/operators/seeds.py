"""Entry points: a table of rules over paths and texts, module resolution, ranking and deduplication.

A rule is data: languages, a pattern for the path, one for the text, kind, confidence, priority. All rules
of a file are tested in one projection, so a text is read once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import first_candidate, top_k


@dataclass(frozen=True)
class Rule:
    lang: str | None
    kind: str
    confidence: float
    priority: int
    evidence: str
    source: str
    path: str | None = None
    text: tuple[str, ...] = ()
    symbol: str | None = None
    boosts: tuple[tuple[str, str, float, str], ...] = ()  # (path or text, pattern, confidence then, evidence)


_PY = "python"
_MAIN_RS = r"(?m)^\s*(?:async\s+)?fn\s+main\s*\(\s*\)"
_ASYNC_RS = r"(?m)^\s*async\s+fn\s+main\b"
RULES = (
    Rule(_PY, "package_main", 0.97, 5, "file_exists:__main__.py", "python_package_main", path=r"(^|/)__main__\.py$"),
    Rule(_PY, "script_main_guard", 0.85, 10, "has_if_dunder_main", "python_main_guard", text=(r"if\s+__name__\s*==\s*['\"]__main__['\"]\s*:",)),
    Rule(_PY, "script_main_guard_call_main", 0.92, 9, "calls_main()", "python_main_guard", text=(r"if\s+__name__\s*==\s*['\"]__main__['\"]\s*:", r"(?m)^\s*main\(\)\s*$"), symbol="main"),
    Rule(_PY, "asgi_app_heuristic", 0.82, 12, "found:FastAPI(", "python_framework_heuristics", text=(r"\bFastAPI\s*\(",), symbol="app"),
    Rule(_PY, "wsgi_app_heuristic", 0.80, 12, "found:Flask(", "python_framework_heuristics", text=(r"\bFlask\s*\(",), symbol="app"),
    Rule(_PY, "django_manage", 0.92, 6, "manage.py:execute_from_command_line", "python_framework_heuristics", path=r"manage\.py$", text=(r"\bexecute_from_command_line\s*\(",)),
    Rule(_PY, "django_wsgi", 0.90, 6, "wsgi:get_wsgi_application", "python_framework_heuristics", path=r"wsgi\.py$", text=(r"\bget_wsgi_application\s*\(",), symbol="application"),
    Rule(_PY, "django_asgi", 0.90, 6, "asgi:get_asgi_application", "python_framework_heuristics", path=r"asgi\.py$", text=(r"\bget_asgi_application\s*\(",), symbol="application"),
    Rule(_PY, "celery_app_heuristic", 0.78, 15, "found:Celery(", "python_worker_heuristics", text=(r"\bCelery\s*\(",)),
    Rule(None, "alembic_ini", 0.90, 9, "file_exists:alembic.ini", "python_migrations", path=r"alembic\.ini$"),
    Rule(_PY, "pytest_test_file", 0.70, 30, "tests_convention", "python_tests", path=r"(?i)^tests/(.*/)?(test_[^/]*|[^/]*_test)\.py$"),
    Rule(_PY, "unittest_main", 0.80, 25, "unittest.main()", "python_tests", text=(r"unittest\.main",)),
    Rule("go", "go_main", 0.98, 4, "package main", "go_main_detect", path=r"\.go$", text=(r"(?m)^\s*package\s+main\s*$", r"(?m)^[ \t]*func[ \t]+main[ \t]*\([ \t]*\)"), symbol="main"),
    Rule("java", "java_main", 0.97, 6, "java_entrypoint", "java_main_detect", path=r"\.java$", text=(r"\b(?:public|static)(?:\s+(?:public|static|final))+\s+void\s+main\b[^)]*\bString\b",), symbol="main", boosts=(("text", r"\b(class|interface|enum|record)\s+\w+", 0.98, "declares_type"),)),
    Rule("kotlin", "kotlin_main", 0.96, 6, "fun main()", "kotlin_main_detect", text=(r"\bfun\s+main\s*\(",), symbol="main"),
    Rule("kotlin", "kotlin_script", 0.90, 10, ".kts script", "kotlin_script_detect", path=r"\.kts$"),
    Rule("ruby", "ruby_script_shebang", 0.95, 5, "shebang:ruby", "ruby_script_detect", text=(r"(?m)^#!.*\bruby\b",)),
    Rule("ruby", "ruby_bin_script", 0.92, 6, "conventional_bin_script", "ruby_bin_detect", path=r"^bin/(bundle|console|jobs|rails|rake|server|setup|sidekiq)$"),
    Rule("ruby", "ruby_rack_config", 0.93, 4, "file:config.ru", "ruby_rack_detect", path=r"(?i)config\.ru$", boosts=(("text", r"(?m)^[ \t]*run[ \t]+\w", 0.97, "rack:run"),)),
    Rule("ruby", "ruby_rails_application", 0.97, 4, "class Application < Rails::Application", "ruby_rails_detect", path=r"(?i)config/application\.rb$", text=(r"\bApplication[ \t]*<[ \t]*(?:::)?Rails::Application\b",), symbol="Application"),
    Rule("ruby", "ruby_rails_environment", 0.90, 8, "file:config/environment.rb", "ruby_rails_detect", path=r"(?i)config/environment\.rb$"),
    Rule("ruby", "ruby_rake_file", 0.86, 10, "rake_file", "ruby_rake_detect", path=r"((^|/)Rakefile|\.rake)$", boosts=(("text", r"(?m)^\s*task\s+[:'\"]?\w", 0.91, "defines_rake_task"),)),
    Rule("ruby", "ruby_gemspec", 0.88, 12, "file:gemspec", "ruby_package_detect", path=r"(?i)\.gemspec$"),
    Rule("ruby", "ruby_sidekiq_signal", 0.78, 18, "found:Sidekiq", "ruby_worker_detect", text=(r"\bSidekiq\b",)),
    Rule(None, "ruby_procfile", 0.75, 7, "procfile:worker", "ruby_procfile_detect", path=r"^Procfile(\.dev)?$", text=(r"(?m)^(web|worker)\s*:",), boosts=(("text", r"(?m)^web\s*:", 0.88, "procfile:web"),)),
    Rule("rust", "rust_main", 0.96, 5, "fn main()", "rust_main_detect", path=r"\.rs$", text=(_MAIN_RS,), symbol="main", boosts=(("text", _ASYNC_RS, 0.97, "async fn main()"), ("path", r"(^|/)main\.rs$", 0.98, "file:main.rs"), ("path", r"^src/bin/", 0.97, "location:src/bin/"))),
)
SEED = "struct<kind:string,id:string,file:string,symbol:string,confidence:double,priority:int,evidence:array<string>,source:string>"


def seed(kind: Column, file: Column, symbol: Column, confidence: Column, priority: Column, evidence: Column, source: Column) -> Column:
    """A seed; its id is the file, with the symbol after a colon if there is one."""
    return F.struct(
        kind.alias("kind"), F.when(symbol.isNull(), file).otherwise(F.concat(file, F.lit(":"), symbol)).alias("id"), file.alias("file"), symbol.alias("symbol"),
        confidence.cast("double").alias("confidence"), priority.cast("int").alias("priority"), evidence.alias("evidence"), source.alias("source"),
    )


def by_rules(files: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Seeds of ``files`` (path, lang, content) by rule; a null content meets no text pattern."""
    c = {"path": F.col("path"), "text": F.coalesce("content", F.lit(""))}
    hits = []
    for r in rules:
        ok = F.lit(True) if r.lang is None else F.col("lang") == r.lang
        if r.path:
            ok = ok & c["path"].rlike(r.path)
        for t in r.text:
            ok = ok & c["text"].rlike(t)
        sure, why = F.lit(r.confidence), [F.lit(r.evidence)]
        for where, pattern, then, evidence in r.boosts:
            sure = F.greatest(sure, F.when(c[where].rlike(pattern), F.lit(then)).otherwise(F.lit(0.0)))
            why.append(F.when(c[where].rlike(pattern), F.lit(evidence)))
        s = seed(F.lit(r.kind), c["path"], F.lit(r.symbol).cast("string"), sure, F.lit(r.priority), F.array_compact(F.array(*why)), F.lit(r.source))
        hits.append(F.when(ok, s))
    return files.where("path IS NOT NULL").select(F.explode(F.array_compact(F.array(*hits))).alias("s")).select("s.*")


_CONFIG = r"(^|/)(Dockerfile|docker-compose\.ya?ml|compose\.ya?ml|Procfile|Makefile|pyproject\.toml|setup\.(cfg|py)|README\.(md|rst|txt))$|^\.github/workflows/.*\.ya?ml$|\.service$|^scripts/.*\.(sh|bash)$|^bin/"
_COMMANDS = (  # (pattern with the module and, if any, the symbol; kind; confidence; priority)
    (r"(?i)\buvicorn\s+([\w.]+):(\w+)", "asgi_cmd", 0.98, 1), (r"(?i)\bhypercorn\s+([\w.]+):(\w+)", "asgi_cmd", 0.96, 2), (r"(?i)\bdaphne\s+([\w.]+):(\w+)", "asgi_cmd", 0.95, 2),
    (r"(?i)\bgunicorn\s+([\w.]+):(\w+)", "wsgi_cmd", 0.94, 3), (r"(?i)\bpython3?\s+-m\s+([\w.]+)()", "python_dash_m", 0.92, 6), (r"(?i)\bcelery\s+-A\s+([\w.]+)()", "celery_app_cmd", 0.94, 5),
    (r"(?m)^\s*[\w-]+\s*=\s*[\"']?([\w.]+):(\w+)[\"']?\s*$", "console_script", 0.99, 3),
)


def module_candidates(module: Column, roots: list[str]) -> Column:
    """Paths a dotted module may have below each root, in order: as a file, then as a package."""
    p = F.replace(module, F.lit("."), F.lit("/"))
    return F.array(*[F.concat(F.lit(f"{r}/" if r else ""), p, F.lit(s)) for r in dict.fromkeys([*roots, ""]) for s in (".py", "/__init__.py")])


def by_commands(files: DataFrame, roots: list[str]) -> DataFrame:
    """Seeds from commands and script tables in configuration files, their modules resolved to files; (found, unresolved) in one frame by ``file`` null."""
    conf = files.where(F.col("path").rlike(_CONFIG) & F.col("content").isNotNull()).select("path", "content")
    one = lambda k: F.transform(F.regexp_extract_all("content", F.lit(k[0]), F.lit(0)), lambda m: F.struct(F.regexp_replace(m, r"^\s+|\s+$", "").alias("text"), F.regexp_extract(m, k[0], 1).alias("module"), F.nullif(F.regexp_extract(m, k[0], 2), F.lit("")).alias("symbol"), F.lit(k[1]).alias("kind"), F.lit(k[2]).alias("confidence"), F.lit(k[3]).alias("priority")))
    scripts = F.col("path").rlike(r"(^|/)(pyproject\.toml|setup\.cfg)$") & F.col("content").rlike(r"(project|poetry)\.scripts|console_scripts")
    none = F.array().cast("array<struct<text:string,module:string,symbol:string,kind:string,confidence:double,priority:int>>")
    hits = F.flatten(F.array(*[F.when(scripts, one(k)).otherwise(none) if k[1] == "console_script" else one(k) for k in _COMMANDS]))
    rows = conf.select("path", F.explode(hits).alias("h")).select("path", "h.*")
    mods = rows.select("module").distinct()
    found = first_candidate(mods, files, key=["module"], candidates=module_candidates(F.col("module"), roots), ident="path").select("module", F.col("path").alias("file"))
    j = rows.join(found, "module", "left")
    why = F.array_compact(F.array(F.concat(F.lit("cmd_in:"), "path"), F.col("text"), F.when(F.col("file").isNotNull(), F.concat(F.lit("resolved:"), "module", F.lit("->"), "file"))))
    return j.select(seed(F.col("kind"), F.col("file"), F.col("symbol"), F.col("confidence"), F.col("priority"), why, F.lit("config_cmd_scan")).alias("s")).select("s.*")


def by_executed_files(files: DataFrame) -> DataFrame:
    """Seeds of files that a configuration runs by name, and of the migration scripts it calls."""
    conf = files.where(F.col("path").rlike(_CONFIG) & F.col("content").isNotNull()).select("path", "content")
    runs = conf.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?i)\bpython3?\s+([\w/.\-]+\.py)\b"), F.lit(1))).alias("file"))
    runs = runs.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    a = runs.select(seed(F.lit("python_file_exec"), F.col("file"), F.lit(None).cast("string"), F.lit(0.88), F.lit(7), F.array(F.concat(F.lit("cmd_in:"), "path")), F.lit("config_cmd_scan")).alias("s"))
    calls = conf.where(F.col("content").rlike(r"(?i)\balembic\s+(upgrade|revision|downgrade)\b")).select("path")
    env = top_k(files.where(F.col("path").rlike("^(alembic|migrations)/env[.]py$")).select(F.col("path").alias("file"), F.length("path").alias("n")), "n", 1, ["file"])
    b = calls.crossJoin(env).select(seed(F.lit("alembic_env"), F.col("file"), F.lit(None).cast("string"), F.lit(0.95), F.lit(8), F.array(F.concat(F.lit("cmd_in:"), "path"), F.lit("found_alembic_command")), F.lit("config_cmd_scan")).alias("s"))
    return a.union(b).select("s.*")


def ranked(seeds: DataFrame) -> DataFrame:
    """One seed an id: the row of highest confidence (ties: the lower priority, then kind), with all evidence, sorted; by priority, confidence, id."""
    best = F.struct(F.col("confidence"), (-F.col("priority")).alias("p"), F.col("kind").alias("k"))
    rest = F.struct("kind", "file", "symbol", "priority", "source")
    g = seeds.where("file IS NOT NULL").groupBy("id").agg(F.max_by(rest, best).alias("r"), F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))
    return g.select("id", "r.file", "r.symbol", "r.kind", "confidence", "r.priority", "evidence", "r.source").orderBy("priority", F.desc("confidence"), "id")


def discover(files: DataFrame, roots: list[str]) -> DataFrame:
    """All seeds of a tree (path, lang, content), ranked."""
    return ranked(by_rules(files).unionByName(by_commands(files, roots)).unionByName(by_executed_files(files)))


def warnings(files: DataFrame, roots: list[str]) -> DataFrame:
    """(kind, file, evidence): dynamic imports, and commands whose module no file has."""
    dyn = r"\b(importlib\.(import_module|metadata\.entry_points)|__import__|pkgutil\.iter_modules|pkg_resources\.iter_entry_points)\b"
    a = files.where((F.col("lang") == "python") & F.col("content").rlike(dyn)).select(F.lit("dynamic_imports_present").alias("kind"), F.col("path").alias("file"), F.array(F.lit("dynamic_import_callsite_detected")).alias("evidence"))
    lost = by_commands(files, roots).where("file IS NULL")
    b = lost.select(F.when(F.col("kind") == "console_script", F.lit("console_script_unresolved")).otherwise(F.lit("cmd_module_unresolved")).alias("kind"), F.substring(F.element_at("evidence", 1), 8, 1000).alias("file"), "evidence")
    return a.unionByName(b)
