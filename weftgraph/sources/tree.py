"""Source trees as a Python data source: one row a file, contents read only where asked for.

Spark's own file sources leave out names that begin with an underscore (``__init__.py``), so the tree is
listed through pyarrow's file systems: folders to skip are never entered, filters on language, suffix and
size are taken over before a file is opened, and files are packed into balanced partitions by size.
"""

from __future__ import annotations

import datetime
import fnmatch
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from weftgraph.functions import paths

SCHEMA = "path string, ext string, lang string, size long, modified timestamp, content string"
_ARROW = pa.schema([("path", pa.string()), ("ext", pa.string()), ("lang", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("content", pa.string())])
_BY_LANG = {
    "python": "py pyi", "ts": "ts tsx", "js": "js jsx mjs cjs", "go": "go", "java": "java", "kotlin": "kt kts", "rust": "rs", "ruby": "rb rake gemspec ru",
    "json": "json", "yaml": "yml yaml", "markdown": "md mdx", "html": "htm html", "css": "css less sass scss", "csharp": "cs", "cpp": "c cc cpp cxx h hh hpp",
    "php": "php", "swift": "swift", "sql": "sql", "toml": "toml",
}
LANG_BY_EXT = {f".{e}": lang for lang, exts in _BY_LANG.items() for e in exts.split()}
LANG_BY_NAME = {"go.mod": "go"} | dict.fromkeys("Capfile Gemfile Guardfile Rakefile Vagrantfile config.ru".split(), "ruby")
CODE = ("python", "ts", "js", "go", "java", "kotlin", "rust", "ruby")
SKIPPED = frozenset(
    ".bundle .git .hg .idea .mypy_cache .next .parcel-cache .pytest_cache .ruff_cache .svn .tox .turbo .venv .vscode .weftgraph __pycache__ coverage node_modules out target venv".split()
)
MOST_BYTES = 200 << 20


def suffix(name: str) -> str:
    at = name.rfind(".")
    return name[at:].lower() if at > 0 else ""


def language(name: str) -> str:
    return LANG_BY_NAME.get(name) or LANG_BY_EXT.get(suffix(name), "other")


def language_column(path: Column | str) -> Column:
    """The language of a path, by name first, then by suffix; "other" for the rest."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(F.try_element_at(table(LANG_BY_NAME), paths.basename(path)), F.try_element_at(table(LANG_BY_EXT), paths.extension(path)), F.lit("other"))


def bucket_column(path: Column | str, lang: Column) -> Column:
    """The analyzer a file goes to: js with ts, each other language of code its own, null for the rest."""
    by = F.when(language_column(path).isin(*CODE), language_column(path)).when(lang.isin(*CODE), lang)
    return F.when(by == "js", F.lit("ts")).otherwise(by)


def bucket_counts(manifest: DataFrame) -> DataFrame:
    """(bucket, n) of ``manifest`` (path, lang): files by analyzer; missing_path, outside_root and non_code count what none takes."""
    p = F.col("path")
    out = p.rlike(r"^(\.\./|/)") | p.contains("/../")
    b = F.when(p.isNull() | (F.trim(p) == ""), F.lit("missing_path")).when(out, F.lit("outside_root")).otherwise(F.coalesce(bucket_column("path", F.lower("lang")), F.lit("non_code")))
    return manifest.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@dataclass
class _Part(InputPartition):
    files: tuple[tuple[str, str, int, float], ...]  # name below the root, language, size, time

    def __init__(self, files):
        super().__init__(files)
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.content = options.get("content", "true").lower() != "false"
        self.most = int(options.get("maxbytes", MOST_BYTES))
        self.part_bytes = int(options.get("maxpartitionbytes", 16 << 20))
        self.skip = SKIPPED | set(filter(None, options.get("skip", "").split(",")))
        self.include = [g for g in options.get("include", "").split(",") if g]
        self.exclude = [g for g in options.get("exclude", "").split(",") if g]
        self.filters: list[Filter] = []

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        system, path = pafs.FileSystem.from_uri(self.root) if "://" in self.root else (pafs.LocalFileSystem(), self.root)
        return system, path.rstrip("/")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if f.attribute in (("lang",), ("ext",)) and isinstance(f, (EqualTo, In)) or f.attribute == ("size",) and isinstance(f, (LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, name: str, lang: str, size: int) -> bool:
        if size > self.most or self.include and not any(fnmatch.fnmatch(name, g) for g in self.include) or any(fnmatch.fnmatch(name, g) for g in self.exclude):
            return False
        for f in self.filters:
            x = {"lang": lang, "ext": suffix(name.rpartition("/")[2]), "size": size}[f.attribute[0]]
            ok = {EqualTo: lambda: x == f.value, In: lambda: x in f.value, LessThan: lambda: x < f.value, LessThanOrEqual: lambda: x <= f.value, GreaterThan: lambda: x > f.value, GreaterThanOrEqual: lambda: x >= f.value}
            if not ok[type(f)]():
                return False
        return True

    def partitions(self) -> list[_Part]:
        system, root = self._fs()
        found, folders = [], [root]
        while folders:
            for info in system.get_file_info(pafs.FileSelector(folders.pop())):
                if info.type == pafs.FileType.Directory:
                    if info.base_name not in self.skip:
                        folders.append(info.path)
                elif info.type == pafs.FileType.File:
                    name, lang = info.path[len(root) + 1 :], language(info.base_name)
                    if self._wanted(name, lang, info.size):
                        found.append((name, lang, info.size, info.mtime.timestamp() if info.mtime else 0.0))
        found.sort()
        parts, held, size = [], [], 0
        for f in found:
            held.append(f)
            size += f[2] if self.content else 512
            if size >= self.part_bytes:
                parts.append(_Part(tuple(held)))
                held, size = [], 0
        if held or not parts:
            parts.append(_Part(tuple(held)))
        return parts

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        system, root = self._fs()
        rows, size = [], 0
        for name, lang, n, at in partition.files:
            text = None
            if self.content:
                with system.open_input_stream(f"{root}/{name}") as f:
                    text = f.read().decode("utf-8", "ignore")
            rows.append({"path": name, "ext": suffix(name.rpartition("/")[2]), "lang": lang, "size": n, "modified": datetime.datetime.fromtimestamp(at, datetime.timezone.utc), "content": text})
            size += n
            if size > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class SourceTree(DataSource):
    """``spark.read.format("source_tree").load(root)``.

    Options: content (true), maxBytes, maxPartitionBytes, skip (folder names), include and exclude
    (shell patterns over the relative path), each list joined by commas.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """Files below ``root``; a missing content is null, bytes that are no UTF-8 are left out."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").options(**options).load(root)


def manifest(files: DataFrame) -> DataFrame:
    """(path, ext, lang) of all files, by path."""
    return files.select("path", "ext", "lang").where("path IS NOT NULL").distinct().orderBy("path")


def language_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def read_prefix(content: Column, most: int = 512_000) -> Column:
    """The first bytes of a binary content as text."""
    return F.decode(F.substring(content, 1, most), "UTF-8")


def package_chain(files: DataFrame) -> DataFrame:
    """(folder): folders of which every ancestor below the top, and they themselves, hold an __init__.py."""
    inits = files.where(paths.basename("path") == "__init__.py").select(paths.dirname("path").alias("folder")).where("folder <> ''").distinct()
    ups = inits.select("folder", F.explode(paths.prefixes(F.col("folder"), "/")).alias("up"))
    broken = ups.join(inits.select(F.col("folder").alias("up")), "up", "left_anti").select("folder").distinct()
    return inits.join(broken, "folder", "left_anti")


def source_roots(files: DataFrame, preferred: tuple[str, ...] = tuple("src backend server app services python".split()), least: int = 10) -> DataFrame:
    """(root, rank): top folders to import from.

    Those of ``preferred`` with ``least`` Python files or more, in that order; otherwise the three largest;
    then the root itself ("") if as many files lie in it.
    """
    py = files.where("lang = 'python' AND path IS NOT NULL")
    tops = py.where(F.col("path").contains("/")).groupBy(F.substring_index("path", "/", 1).alias("root")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    place = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col("root"))
    named = tops.where(place > 0).select("root", place.cast("int").alias("rank"))
    from pyspark.sql import Window

    order = Window.partitionBy().orderBy(F.desc("n"), "root")
    biggest = tops.orderBy(F.desc("n"), "root").limit(3).select("root", F.row_number().over(order).alias("rank"))
    none = named.agg(F.count(F.lit(1)).alias("k"))
    chosen = named.unionByName(biggest.crossJoin(none).where("k = 0").drop("k"))
    flat = py.where(~F.col("path").contains("/")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(F.lit("").alias("root"), F.lit(99).alias("rank"))
    return chosen.unionByName(flat)
