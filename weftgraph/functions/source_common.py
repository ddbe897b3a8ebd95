"""What the extractors of all languages share: the record of a file's facts, comment stripping, scanning."""

from __future__ import annotations

import re
from bisect import bisect_right

_SKIP = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*|\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?", re.S)


class Facts(dict):
    """Facts of one file by column; see extract.FACTS."""

    owner: str | None = None

    def __init__(self, package: str | None = None):
        lists = ("imports", "symbols", "exports", "refs", "uses", "method_uses", "class_uses", "local_imports", "candidates", "relations", "tokens", "notes")
        super().__init__({k: [] for k in lists} | {"package": package, "docstring_lines": 0})

    def candidate(self, *, kind: str, target: str, meta: dict, line: int, col: int, syntax: str, confidence: float, method: str | None = None) -> None:
        """Adds a candidate unless the same is there."""
        row = {"kind": kind, "method": method, "target": target, "meta": list(meta.items()), "line": line, "col": col, "syntax": syntax, "confidence": confidence}
        if not any(c["kind"] == kind and c["target"] == target and c["method"] == method and (c["line"], c["col"]) == (line, col) for c in self["candidates"]):
            self["candidates"].append(row)


def import_ref(*, raw: str, module: str | None, names: list = (), is_from: bool = False, level: int = 0, type_checking: bool = False, line: int, end_line: int | None = None, scope: str = "module", kind: str = "import", tags: list = ()) -> dict:
    return {
        "raw": raw, "module": module, "names": [{"name": n, "alias": a} for n, a in names], "is_from": is_from, "level": level, "type_checking": type_checking,
        "line": line, "end_line": end_line or line, "scope": scope, "conditional": scope != "module" or type_checking, "kind": kind, "tags": list(tags),
    }


def symbol(*, kind: str, name: str, owner: str | None = None, line: int = 0, col: int = 0, docstring: str | None = None, params: list = (), returns: str | None = None, bases: list = (), decorators: list = (), flags: list = ()) -> dict:
    return {
        "kind": kind, "name": name, "owner": owner, "line": line, "col": col, "docstring": docstring, "params": list(params), "returns": returns,
        "bases": list(bases), "decorators": list(decorators), "flags": list(flags),
    }


def blank_comments(text: str, *, strings: bool = False) -> str:
    """A C-like source with comments (and, if asked, string contents) turned to spaces; offsets and lines stay."""
    def put(m: re.Match) -> str:
        s = m[0]
        if s.startswith(("//", "/*")):
            return re.sub(r"[^\n]", " ", s)
        return s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1] if strings and len(s) > 1 else s

    return _SKIP.sub(put, text)


class Lines:
    """Line and column of an offset; both for humans: lines from 1, columns from 0."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, offset: int) -> tuple[int, int]:
        k = bisect_right(self.starts, offset)
        return k, offset - self.starts[k - 1]


def depth_zero(text: str) -> str:
    """The text with everything inside braces blanked, so that only top-level code is left."""
    out, depth = [], 0
    for ch in text:
        if ch == "}":
            depth = max(0, depth - 1)
        out.append(ch if depth == 0 or ch == "\n" else " ")
        if ch == "{":
            depth += 1
    return "".join(out)


def split_list(text: str) -> list[str]:
    """Parts between commas outside of brackets."""
    out, depth, part = [], 0, ""
    for ch in text:
        depth += (ch in "<([{") - (ch in ">)]}")
        if ch == "," and depth == 0:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return [p for p in [*out, part.strip()] if p]
