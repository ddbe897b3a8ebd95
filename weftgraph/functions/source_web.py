"""Facts of TypeScript and JavaScript sources by scanning: module specs, top-level symbols, calls across the wire.

Strings and comments are told apart from code; nested template expressions and JSX text are not parsed,
so an import that only exists inside such text may be found too.
"""

from __future__ import annotations

import re

from .source_common import Facts, Lines, blank_comments, depth_zero, import_ref, split_list, symbol

_Q = r"(?P<q>['\"`])(?P<s>(?:(?!(?P=q)).)*)(?P=q)"
_FROM = re.compile(r"(?m)^[ \t]*(?P<w>import|export)\b(?P<mid>[^;'\"`()]*?)\bfrom\s*" + _Q)
_BARE = re.compile(r"(?m)^[ \t]*import\s*" + _Q)
_CALLED = re.compile(r"(?<![\w.$])(?P<w>require|import)\s*\(\s*" + _Q)
_FETCH = re.compile(r"(?<![\w.$])(?P<f>fetch|axios\.(?P<m>\w+))\s*\(\s*" + _Q, re.S)
_AXIOS = re.compile(r"(?<![\w.$])axios\s*\(\s*\{")
_ENV = re.compile(r"(?<![\w.$])(?P<b>process\.env|import\.meta\.env)\.(?P<v>[A-Za-z_$][\w$]*)")
_TRPC = re.compile(r"(?<![\w.$])trpc\.(?P<n>[\w$.]+)\.use(?:Query|Mutation)\b")
_GQL = re.compile(r"(?<![\w.$])(?:gql|graphql)\s*`(?P<d>[^`]*)`")
_SOCKET = re.compile(r"(?<![\w$])\w*socket\w*\.(?P<d>emit|on)\s*\(\s*" + _Q, re.I)
_PUSH = re.compile(r"(?<![\w$])router\.(?:push|replace)\s*\(\s*" + _Q)
_DECL = re.compile(
    r"(?m)^[ \t]*(?P<x>export\s+)?(?P<d>default\s+)?(?:declare\s+)?(?:abstract\s+)?"
    r"(?P<k>async\s+function\*?|function\*?|class|interface|type|enum|const\s+enum|namespace|module|const|let|var)\s+(?P<n>[A-Za-z_$][\w$]*)(?P<r>[^\n]*)"
)
_CLAUSE = re.compile(r"(?m)^[ \t]*export\s*(?:type\s*)?\{(?P<l>[^}]*)\}")
_HTTP = frozenset("get post put patch delete head options".split())


def _names(mid: str) -> list[tuple[str, str | None]]:
    out: list[tuple[str, str | None]] = []
    mid = re.sub(r"^\s*type\b", "", mid).strip()
    if m := re.search(r"\{([^}]*)\}", mid):
        for part in split_list(m[1]):
            a, _, b = part.removeprefix("type ").partition(" as ")
            out.append((a.strip(), b.strip() or None))
    if m := re.search(r"\*\s*(?:as\s+([\w$]+))?", re.sub(r"\{[^}]*\}", "", mid)):
        out.append(("*", m[1]))
    if m := re.match(r"([A-Za-z_$][\w$]*)\s*(?:,|$)", mid):
        out.append(("default", m[1]))
    return out


def _url(m: re.Match) -> tuple[str, float]:
    """A literal URL, or a template with :x for each hole, and how sure that is."""
    if m["q"] == "`" and "${" in m["s"]:
        return re.sub(r"\$\{[^}]*\}", "{x}", m["s"]), 0.9
    return m["s"], 1.0


def _own_keys(code: str, bare: str, at: int) -> str:
    """The object literal that is open at ``at``, without the objects, arrays and calls in it."""
    out, depth = [], 0
    for i in range(at, len(code)):
        depth += (bare[i] in "{[(") - (bare[i] in "}])")
        if depth < 0:
            break
        out.append(code[i] if depth == 0 else " ")
    return "".join(out)


def web_facts(text: str) -> Facts:
    facts, lines = Facts(), Lines(text)
    code = blank_comments(text)
    bare = blank_comments(text, strings=True)

    def is_code(at: int) -> bool:
        return bare[at] == code[at] and not code[at].isspace()

    found: list[tuple[int, dict]] = []
    for m in _FROM.finditer(code):
        if is_code(m.start("w")):
            kind = "import" if m["w"] == "import" else "reexport"
            only_type = bool(re.match(r"\s*type\b(?!\s*(?:,|from))", m["mid"]))
            found.append((m.start("w"), import_ref(raw=m[0].strip(), module=m["s"], names=_names(m["mid"]), is_from=True, type_checking=only_type, line=lines.at(m.start("w"))[0], end_line=lines.at(m.end())[0], kind=kind)))
            if kind == "reexport":
                facts["exports"] += [b or a for a, b in _names(m["mid"])]
    for m in _BARE.finditer(code):
        found.append((m.start(), import_ref(raw=m[0].strip(), module=m["s"], line=lines.at(m.start("q"))[0])))
    for m in _CALLED.finditer(code):
        if is_code(m.start("w")) and not (m["q"] == "`" and "${" in m["s"]):
            kind = "require" if m["w"] == "require" else "dynamic_import"
            found.append((m.start("w"), import_ref(raw=m[0] + ")", module=m["s"], line=lines.at(m.start("w"))[0], kind=kind, tags=["dynamic"] if kind != "require" else [])))
    facts["imports"] = [r for _, r in sorted(found, key=lambda f: f[0])]

    top = depth_zero(bare)
    for m in _DECL.finditer(top):
        name, kind = m["n"], re.sub(r"\s+", " ", m["k"]).strip(" *")
        line, col = lines.at(m.start("n"))
        kind = {"async function": "function", "const enum": "enum", "module": "namespace", "const": "global", "let": "global", "var": "global"}.get(kind, kind)
        bases = []
        if kind in ("class", "interface"):
            for b in re.finditer(r"\b(?:extends|implements)\s+([\w$.,\s<>]+?)(?=\bimplements\b|\{|$)", m["r"]):
                bases += [re.sub(r"<.*", "", x) for x in split_list(b[1])]
        flags = (["exported"] if m["x"] else []) + (["default"] if m["d"] else [])
        facts["symbols"].append(symbol(kind=kind, name=name, line=line, col=col, bases=bases, flags=flags))
        if kind == "global" and re.search(r"=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]*)?=>|[\w$]+\s*=>)", m["r"]):
            facts["symbols"].append(symbol(kind="function", name=name, line=line, col=col, flags=flags))
        if m["x"]:
            facts["exports"].append(name)
    if re.search(r"(?m)^[ \t]*export\s+default\b", top):
        facts["exports"].append("default")
    for m in _CLAUSE.finditer(bare):
        facts["exports"] += [(p.partition(" as ")[2] or p.partition(" as ")[0]).strip().removeprefix("type ") for p in split_list(m["l"])]
    if re.search(r"(?m)^[ \t]*export\s*\*\s*from", bare):
        facts["exports"].append("*")
    facts["exports"] = list(dict.fromkeys(e for e in facts["exports"] if e))

    def add(m: re.Match, kind: str, syntax: str, target: str, meta: dict, sure: float = 1.0, method: str | None = None) -> None:
        if is_code(m.start()):
            line, col = lines.at(m.start())
            facts.candidate(kind=kind, method=method, target=target, meta=meta, line=line, col=col, syntax=syntax, confidence=sure)

    for m in _FETCH.finditer(code):
        verb = (m["m"] or "get").lower()
        url, sure = _url(m)
        if verb in _HTTP and url:
            add(m, "http_call", "axios" if m["m"] else "fetch", url, {"method": verb.upper(), "path": url}, sure, verb.upper())
    for m in _AXIOS.finditer(code):
        own = _own_keys(code, bare, m.end())
        url, verb = (re.search(rf"(?<![\w$]){k}['\"]?\s*:\s*" + _Q, own) for k in ("url", "method"))
        if url:
            v = verb["s"].upper() if verb else "GET"
            add(m, "http_call", "axios", url["s"], {"method": v, "path": url["s"]}, 0.9 if verb else 0.75, v)
    for m in _ENV.finditer(code):
        add(m, "env_ref", m["b"], m["v"], {"var": m["v"], "system": "node" if m["b"] == "process.env" else "vite"})
    for m in _TRPC.finditer(code):
        add(m, "rpc_call", "trpc", "trpc:" + m["n"], {"name": "trpc:" + m["n"], "system": "trpc"}, 0.95)
    for m in _GQL.finditer(code):
        add(m, "graphql_op", "gql", m["d"], {"document": m["d"]}, method="document")
    for m in _SOCKET.finditer(code):
        add(m, "socket_event", m["d"].lower(), m["s"], {"event": m["s"], "dir": m["d"].lower()})
    for m in _PUSH.finditer(code):
        add(m, "route_ref", "router", m["s"], {"path": m["s"]})
    longest = max((len(x) for x in text.split("\n")), default=0)
    if longest > 2000 and len(text) / max(1, text.count("\n") + 1) > 200:
        facts["notes"].append("minified")
    return facts
