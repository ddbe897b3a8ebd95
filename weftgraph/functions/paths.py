"""Path, module and import-spec normalisers as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WEB_EXTENSIONS = ("js", "mjs", "cjs", "jsx", "ts", "tsx")
_STRINGS = "array<string>"


def text(c: Column | str) -> Column:
    """The string, with null as the empty one."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string")


def _segments(c: Column, sep: str = "/") -> Column:
    return F.filter(F.split(c, sep.replace(".", r"\.")), lambda s: (s != "") & (s != "."))


def to_posix(c: Column | str) -> Column:
    """Forward slashes, single, without "." segments or a trailing slash; the empty path is "."."""
    s = F.replace(text(c), F.lit("\\"), F.lit("/"))
    lead = F.when(s.rlike("^//[^/]"), F.lit("//")).when(s.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(lead, F.array_join(_segments(s), "/"))
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def fold_dots(c: Column | str) -> Column:
    """to_posix that also resolves ".." against the segments before it; the empty path stays empty."""
    s = F.replace(text(c), F.lit("\\"), F.lit("/"))
    rooted = s.startswith("/")

    def push(done: Column, seg: Column) -> Column:
        last = F.element_at(done, -1)
        up = (seg == "..") & (F.size(done) > 0)
        pops = up & F.when(F.size(done) > 0, last != "..").otherwise(False)
        above_root = (seg == "..") & (F.size(done) == 0) & rooted
        return F.when(pops, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(above_root, done).otherwise(F.array_append(done, seg))

    parts = F.aggregate(_segments(s), F.array().cast(_STRINGS), push)
    return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def dirname(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(text(c), "^(.*)/[^/]*$", 1), "^$", "")


def basename(c: Column | str) -> Column:
    return F.substring_index(text(c), "/", -1)


def extension(c: Column | str) -> Column:
    """Lower-case suffix with its dot; dot files have none."""
    return F.lower(F.regexp_extract(basename(c), r"^.+(\.[^.]+)$", 1))


def stem(c: Column | str) -> Column:
    return F.regexp_replace(basename(c), r"^(.+)\.[^.]+$", "$1")


def is_module_id(c: Column | str) -> Column:
    s = text(c)
    return (s != "") & ~s.contains("/") & ~s.contains("\\") & ~s.endswith(".py")


def path_for_module(c: Column | str, init: bool = False) -> Column:
    """a.b.c as a/b/c.py, or as the package a/b/c/__init__.py."""
    m = F.btrim(F.trim(text(c)), F.lit("."))
    return F.when(m == "", F.lit("")).otherwise(F.concat(F.replace(m, F.lit("."), F.lit("/")), F.lit("/__init__.py" if init else ".py")))


def module_for_path(c: Column | str) -> Column:
    p = F.regexp_replace(to_posix(c), "/+$", "")
    plain = F.regexp_replace(F.regexp_replace(p, "/__init__\\.py$", ""), "\\.py$", "")
    return F.when(p == "", F.lit("")).when(is_module_id(p), p).otherwise(F.replace(plain, F.lit("/"), F.lit(".")))


def _root(root: str | None) -> str:
    return "/".join((root or "").split("\\")).rstrip("/")


def relative_to(c: Column | str, root: str | None) -> Column:
    """The path below ``root``; what isn't below it, and the root itself, stay as they are."""
    p = to_posix(c)
    r = _root(root)
    if not r:
        return p
    return F.when(p.startswith(r + "/"), F.substr(p, F.lit(len(r) + 2))).otherwise(p)


def file_id(c: Column | str, root: str | None = None, *, init: bool = False, strict: bool = False) -> Column:
    """Canonical node id of a path or dotted module: a repository-relative path that ends in .py.

    With ``strict`` other paths keep their suffix; without it a path without .py gets it.
    """
    raw = F.trim(text(c))
    p = relative_to(F.when(is_module_id(raw), path_for_module(raw, init)).otherwise(raw), root)
    out = F.when(p.endswith(".py"), p)
    if not strict:
        out = out.when(p.contains("/"), F.concat(F.regexp_replace(p, "/+$", ""), F.lit(".py")))
    return F.when(text(c) == "", F.lit("")).otherwise(out.otherwise(p))


def module_id(c: Column | str, root: str | None = None) -> Column:
    raw = F.trim(text(c))
    return F.when(text(c) == "", F.lit("")).when(is_module_id(raw), raw).otherwise(module_for_path(relative_to(raw, root)))


def id_variants(c: Column | str, root: str | None = None) -> Column:
    """The spellings under which an id may be known, distinct, the given one first."""
    given = F.array(text(c), file_id(c, root), file_id(c, root, init=True), module_id(c, root))
    return F.array_distinct(F.transform(F.filter(given, lambda v: v != ""), to_posix))


def is_repo_relative(c: Column | str) -> Column:
    s = text(c)
    return (s != "") & ~s.contains(":") & ~to_posix(s).startswith("/")


# == web


def strip_query_and_hash(c: Column | str) -> Column:
    return F.trim(F.substring_index(F.substring_index(F.trim(text(c)), "#", 1), "?", 1))


def _no_lead(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^(\./)+", ""), "^/", "")


def spec_kind(c: Column | str) -> Column:
    """relative, absolute, url or bare; empty specs are unresolved."""
    s = strip_query_and_hash(c)
    return (
        F.when(s == "", F.lit("unresolved"))
        .when(F.lower(F.trim(text(c))).rlike("^(https?://|data:|blob:)"), F.lit("url"))
        .when(s.rlike(r"^\.\.?/"), F.lit("relative"))
        .when(s.rlike("^/(?!/)"), F.lit("absolute"))
        .otherwise(F.lit("bare"))
    )


def is_bare_spec(c: Column | str) -> Column:
    return spec_kind(c) == "bare"


def web_file_id(c: Column | str, root: str | None = None) -> Column:
    p = fold_dots(strip_query_and_hash(c))
    r = _root(root)
    if r:
        p = F.when(p == r, F.lit("")).when(p.startswith(r + "/"), F.substr(p, F.lit(len(r) + 2))).when(p.rlike("^(/|[A-Za-z]:)"), F.concat(F.lit("/"), p)).otherwise(p)
    return F.regexp_replace(_no_lead(p), "/+$", "")


def join_relative(base: Column | str, spec: Column | str) -> Column:
    """``spec`` seen from the folder of the file ``base``."""
    folder = dirname(_no_lead(fold_dots(base)))
    return fold_dots(F.concat(folder, F.when(folder == "", F.lit("")).otherwise(F.lit("/")), fold_dots(spec)))


def has_web_extension(c: Column | str) -> Column:
    return F.lower(text(c)).rlike(r"\.(" + "|".join(WEB_EXTENSIONS) + ")$")


def web_candidates(base: Column | str) -> Column:
    """Paths that an import of ``base`` may mean, best first.

    The path itself; for .js its TypeScript twins and their index files; without a suffix every web
    extension, then index files with each. Any other suffix stands for itself alone.
    """
    b = text(base)
    cut = F.regexp_replace(b, r"\.js$", "")
    twins = F.array(b, *[F.concat(cut, F.lit(x)) for x in (".ts", ".tsx", "/index.ts", "/index.tsx")])
    bare = F.array(b, *[F.concat(b, F.lit(f"{lead}.{e}")) for lead in ("", "/index") for e in WEB_EXTENSIONS])
    return F.when(b == "", F.array().cast(_STRINGS)).when(b.endswith(".js"), twins).when(extension(b) == "", bare).otherwise(F.array(b))


# == Go, Java, Kotlin, Rust, Ruby


def go_spec(c: Column | str) -> Column:
    s = F.regexp_replace(F.trim(text(c)), "^['\"`](.*)['\"`]$", "$1")
    return F.regexp_replace(F.regexp_replace(F.replace(F.trim(s), F.lit("\\"), F.lit("/")), "/+", "/"), "^/|/$", "")


def go_import_kind(c: Column | str, module_path: Column | str) -> Column:
    s, m = go_spec(c), go_spec(module_path)
    return (
        F.when(s == "", F.lit("unresolved"))
        .when(s.rlike(r"^\.\.?/"), F.lit("relative"))
        .when((m != "") & ((s == m) | s.startswith(F.concat(m, F.lit("/")))), F.lit("local"))
        .when(F.substring_index(s, "/", 1).contains("."), F.lit("module"))
        .otherwise(F.lit("stdlib"))
    )


def java_spec(target: Column | str, wildcard: Column, static: Column) -> Column:
    base = F.trim(text(target))
    full = F.concat(F.when(static, F.lit("static:")).otherwise(F.lit("")), base, F.when(wildcard, F.lit(".*")).otherwise(F.lit("")))
    return F.when(base == "", F.lit("")).otherwise(full)


def java_package_of(path: Column | str) -> Column:
    """Package by folder below src/main/java or src/test/java; null elsewhere."""
    got = F.regexp_extract(text(path), "/src/(?:main|test)/java/(.*)/[^/]*$", 1)
    return F.when(text(path).rlike("/src/(main|test)/java/"), F.replace(got, F.lit("/"), F.lit(".")))


def qualified(package: Column | str, *names: Column | str, sep: str = ".") -> Column:
    """Package and simple names joined; without a first name the result is empty."""
    parts = [text(package), *map(text, names)]
    return F.when(F.trim(parts[1]) == "", F.lit("")).otherwise(F.array_join(F.filter(F.array(*map(F.trim, parts)), lambda x: x != ""), sep))


def kotlin_spec(path: Column | str, wildcard: Column | None = None) -> Column:
    base = F.trim(text(path))
    star = base.endswith(".*") if wildcard is None else base.endswith(".*") | wildcard
    cut = F.regexp_replace(base, r"\.\*$", "")
    return F.when(base == "", F.lit("")).when(star, F.concat(cut, F.lit(".*"))).otherwise(cut)


def kotlin_is_platform(spec: Column | str) -> Column:
    """Whether a spec belongs to the language, the JDK, Android or JetBrains."""
    s = F.regexp_replace(F.trim(text(spec)), r"\.\*$", "")
    return s.rlike(r"^(kotlin|kotlinx|android|androidx)(\.|$)|^(javax?|sun|com\.sun|org\.jetbrains)\.|^java\.lang$")


def rust_spec(path: Column | str, glob: Column, public: Column) -> Column:
    base = F.trim(text(path))
    full = F.concat(F.when(public, F.lit("pub:")).otherwise(F.lit("")), base, F.when(glob, F.lit("::*")).otherwise(F.lit("")))
    return F.when(base == "", F.lit("")).otherwise(full)


def rust_module_of(path: Column | str) -> Column:
    """crate::a::b for src/a/b.rs and src/a/b/mod.rs; crate for the roots; null outside src."""
    p = to_posix(path)
    after = F.regexp_extract(p, r"(?:^|/)src/(.+)$", 1)
    first_src = F.regexp_extract(p, r"^(?:(?!src/)[^/]+/|/)*src/(.+)$", 1)
    after = F.when(first_src != "", first_src).otherwise(after)
    name = F.regexp_replace(F.regexp_replace(after, r"(^|/)mod\.rs$", ""), r"\.rs$", "")
    root = (after == "lib.rs") | (after == "main.rs") | (name == "")
    return F.when(after == "", F.lit(None)).when(root, F.lit("crate")).otherwise(F.concat(F.lit("crate::"), F.replace(name, F.lit("/"), F.lit("::"))))


def rust_in_context(use: Column | str, module: Column | str) -> Column:
    """A use path with self, super and a leading :: replaced by what they mean in ``module``."""
    u, m = F.trim(text(use)), text(module)
    up = F.regexp_replace(m, "::[^:]+$", "")
    parent = F.when(m.contains("::"), up).otherwise(F.lit("crate"))
    grand = F.when(parent.contains("::"), F.regexp_replace(parent, "::[^:]+$", "")).otherwise(F.lit("crate"))
    return (
        F.when(u.startswith("::"), F.substr(u, F.lit(3)))
        .when(u == "self", m)
        .when(u.startswith("self::"), F.concat(m, F.substr(u, F.lit(5))))
        .when(u.startswith("super::super::"), F.concat(grand, F.substr(u, F.lit(13))))
        .when(u.startswith("super::"), F.concat(parent, F.substr(u, F.lit(6))))
        .when(u == "super", parent)
        .otherwise(u)
    )


def ruby_spec(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(text(c)), r"^\./", ""), r"\.rb$", "")


def ruby_is_known_gem(c: Column | str, names: Sequence[str]) -> Column:
    """Whether the spec, or a folder it lies in, is one of ``names`` (folders may end in a slash)."""
    plain = sorted({n.rstrip("/") for n in names})
    return F.substring_index(ruby_spec(c), "/", 1).isin(plain) & (ruby_spec(c) != "")


def camelize(c: Column | str) -> Column:
    """user_admin/post_item as UserAdmin::PostItem."""
    word = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
    part = lambda p: F.array_join(F.transform(F.filter(F.split(p, "_"), lambda w: w != ""), word), "")
    return F.array_join(F.filter(F.transform(F.split(text(c), "/"), part), lambda p: p != ""), "::")


def association_class(c: Column | str) -> Column:
    """Class that a Rails association names: a plain singular, camel-cased."""
    s = F.trim(text(c))
    one = (
        F.when(s.endswith("ies"), F.regexp_replace(s, "ies$", "y"))
        .when(s.rlike("(ses|xes|zes|ches|shes)$"), F.regexp_replace(s, "es$", ""))
        .when(s.endswith("s") & ~s.endswith("ss"), F.regexp_replace(s, "s$", ""))
        .otherwise(s)
    )
    return camelize(one)


# == Python modules


def sanitize_identifier(c: Column | str) -> Column:
    s = F.btrim(F.regexp_replace(text(c), "[^0-9A-Za-z]+", "_"), F.lit("_"))
    s = F.when(s == "", F.lit("_")).otherwise(s)
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)


def absolute_module(token: Column | str, consumer: Column | str, is_package: Column | bool = False) -> Column:
    """What an import token means in the module ``consumer``; null if its dots climb out of the tree.

    One rule serves all uses, that of the language: one dot is the consumer's package, which is the
    consumer itself where ``is_package`` (an __init__ file), each further dot its parent.
    """
    t, mod = F.trim(text(token)), F.btrim(text(consumer), F.lit("."))
    flag = F.lit(is_package) if isinstance(is_package, bool) else is_package
    parts = F.filter(F.split(mod, r"\."), lambda p: p != "")
    package = F.when(flag | (F.size(parts) < 2), parts).otherwise(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    dots = F.length(F.regexp_extract(t, r"^(\.*)", 1))
    rest = F.filter(F.split(F.substr(t, dots + 1), r"\."), lambda p: p != "")
    climb = F.greatest(dots - 1, F.lit(0))
    base = F.slice(package, 1, F.greatest(F.size(package) - climb, F.lit(0)))
    joined = F.nullif(F.array_join(F.concat(base, rest), "."), F.lit(""))
    return F.when((dots == 0) & (t != ""), t).when(climb > F.size(package), F.lit(None)).otherwise(joined)


def import_targets(base: Column | str, names: Column, star: Column) -> Column:
    """Modules that ``from base import names`` may mean: each base.name, then base."""
    b = F.col(base) if isinstance(base, str) else base
    only = F.array(b)
    named = F.array_distinct(F.concat(F.transform(names, lambda n: F.concat(b, F.lit("."), n)), only))
    return F.when(b.isNull(), F.array().cast(_STRINGS)).when(star | (F.size(names) <= 0), only).otherwise(named)


def prefixes(c: Column | str, sep: str = ".") -> Column:
    """The string and its ancestors, longest first."""
    parts = F.filter(F.split(text(c), sep.replace(".", r"\.")), lambda p: p != "")
    n = F.size(parts)
    return F.when(n <= 0, F.array().cast(_STRINGS)).otherwise(F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), sep)))


def shortened(c: Column | str) -> Column:
    """prefixes of a token less what follows a colon, hash or question mark."""
    return prefixes(F.regexp_replace(text(c), "[:#?].*$", ""))


def token_parts(c: Column | str) -> Column:
    """Segments of a path or dotted id."""
    s = F.regexp_replace(text(c), r"\.(py|pyi)$", "")
    return F.filter(F.split(F.when(s.contains("/"), s).otherwise(F.replace(s, F.lit("."), F.lit("/"))), "/"), lambda p: p != "")


def common_prefix_length(a: Column, b: Column) -> Column:
    """Leading elements that two arrays share."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, n.cast("long")).cast("int")


# == small values


def iso_utc(ts: Column) -> Column:
    """Seconds in UTC with a Z; the session's time zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def distinct_in_order(c: Column) -> Column:
    return F.array_distinct(c)


def int_or(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.cast("string").try_cast("long"), F.lit(default))


def enum_code(c: Column, values: Sequence[str]) -> Column:
    """Index of a known value as a string, or the value itself."""
    at = F.array_position(F.array(*[F.lit(v) for v in values]), c)
    return F.when(at > 0, (at - 1).cast("string")).otherwise(c)


def enum_value(c: Column, values: Sequence[str]) -> Column:
    known = F.array(*[F.lit(v) for v in values])
    return F.when(c.rlike("^[0-9]+$") & (c.try_cast("int") < len(values)), F.get(known, c.try_cast("int"))).otherwise(c)


def language_alias(c: Column | str) -> Column:
    """Common spellings of a language as one."""
    s = F.lower(F.trim(text(c)))
    known = {"golang": "go", "python3": "python", "py": "python", "typescript": "ts", "tsx": "ts", "javascript": "js", "jsx": "js", "rs": "rust", "kt": "kotlin", "rb": "ruby"}
    return F.coalesce(*[F.when(s == k, F.lit(v)) for k, v in known.items()], s)


def matches_glob(c: Column | str, globs: Sequence[str]) -> Column:
    """Whether a path meets any shell pattern; * and ? cross slashes, as in fnmatch."""
    import fnmatch

    def plain(g: str) -> str:
        return fnmatch.translate(g).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z")

    return reduce(lambda a, b: a | b, [text(c).rlike(f"(?s)^(?:{plain(g)})$") for g in globs], F.lit(False))


def star_capture(spec: Column | str, pattern: str) -> Column:
    """What the one * of ``pattern`` stands for in ``spec``; "" for an exact match without *, null for none."""
    s = text(spec)
    if "*" not in pattern:
        return F.when(s == pattern, F.lit(""))
    before, _, after = pattern.partition("*")
    fits = s.startswith(before) & s.endswith(after) & (F.length(s) >= len(before) + len(after))
    return F.when(fits, F.substr(s, F.lit(len(before) + 1), F.length(s) - len(before) - len(after)))
