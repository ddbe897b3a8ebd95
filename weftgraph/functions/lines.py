"""Lines of a text and code metrics as Column expressions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import text

_COMMENT, _GAP = "\u0001", "[ \\t\\x0b\\f\\r]"
COUNTS = tuple("loc sloc comment_lines blank_lines".split())
KEYWORDS = frozenset(
    "and as break class continue def elif else except False for from if import in is lambda None not or pass return True try while with yield".split()
)


def lines(c: Column | str) -> Column:
    """Lines of a text; \\r\\n and \\r end one too. What ends in a line end has no further empty line; null and "" have none."""
    s = F.regexp_replace(F.regexp_replace(text(c), "\r\n?", "\n"), "\n\\z", "")
    return F.when(text(c) == "", F.array().cast("array<string>")).otherwise(F.split(s, "\n"))


def is_blank(line: Column) -> Column:
    return ~line.rlike(r"[^\s]")


def _count(arr: Column, test) -> Column:
    return F.size(F.filter(arr, test))


def comment_share(comment: Column, loc: Column) -> Column:
    return F.round(F.try_divide(comment, loc), 6)


def _metrics(loc: Column, blank: Column, comment: Column) -> Column:
    return F.struct(
        loc.alias("loc"), (loc - blank - comment).alias("sloc"), comment.alias("comment_lines"), blank.alias("blank_lines"), comment_share(comment, loc).alias("comment_pct")
    )


def hash_metrics(c: Column | str) -> Column:
    """struct(loc, sloc, comment_lines, blank_lines, comment_pct) of a language with # comments to the line's end."""
    ls = lines(c)
    return _metrics(F.size(ls), _count(ls, is_blank), _count(ls, lambda s: s.rlike(r"^\s*#")))


def marked_comments(c: Column | str) -> Column:
    """A C-like source with every // and /* */ comment reduced to marks, its line structure kept.

    One scan from the left, so what opens first wins; string literals aren't understood, an open block
    runs to the end.
    """
    pieces = F.regexp_extract_all(text(c), F.lit(r"(?s)//[^\r\n]*|/\*.*?(?:\*/|\z)|[^/]+|/"), F.lit(0))
    mark = lambda p: F.when(p.startswith("//") | p.startswith("/*"), F.regexp_replace(p, r"\S+", _COMMENT)).otherwise(p)
    return F.array_join(F.transform(pieces, mark), "")


def c_style_metrics(c: Column | str) -> Column:
    """The same for TypeScript, Go, Java, Kotlin and Rust.

    A blank line is blank inside a comment too; a line with any code is code; the rest are comments.
    """
    ls = lines(marked_comments(c))
    return _metrics(F.size(ls), _count(ls, is_blank), _count(ls, lambda s: s.contains(_COMMENT) & ~s.rlike(f"[^\\s{_COMMENT}]")))


def metrics_for(c: Column | str, lang: Column) -> Column:
    """Metrics by language: # comments for Python and Ruby, C-like ones for the rest."""
    return F.when(lang.isin("python", "ruby"), hash_metrics(c)).otherwise(c_style_metrics(c))


def without_c_comments(c: Column | str) -> Column:
    """A C-like source with comments blanked and line numbers kept."""
    return F.replace(marked_comments(c), F.lit(_COMMENT), F.lit(" "))


def normal_line(line: Column, *, strip_comments: bool = True, idents: bool = False) -> Column:
    """A line for comparison: without # comment, white space squeezed; with ``idents`` every name but keywords is ID."""
    s = F.regexp_replace(line, "#.*$", "") if strip_comments else line
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    if idents:
        s = F.regexp_replace(s, rf"\b(?!(?:{'|'.join(sorted(KEYWORDS))})\b)[A-Za-z_]\w*\b", "ID")
    return s
