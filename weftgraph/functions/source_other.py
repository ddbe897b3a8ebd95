"""Facts of Java, Kotlin, Go, Rust and Ruby sources by scanning; the languages' own parsers aren't at hand."""

from __future__ import annotations

import re

from .source_common import Facts, Lines, blank_comments, depth_zero, import_ref, split_list, symbol

_ID = r"[A-Za-z_]\w*"
_PUB = r"pub(?:\([a-z: ]*\))?[ \t]+"
_PATH = rf"{_ID}(?:\.{_ID})*"


def _bases(text: str | None) -> list[str]:
    return [re.sub(r"[<(].*", "", b, flags=re.S).strip() for b in split_list(text or "")]


# == Java

_TYPE_WORDS = "|".join("abstract final non-sealed private protected public sealed static strictfp".split())
_MEMBER_WORDS = "|".join("abstract default final native private protected public static synchronized".split())
_JAVA_TYPE = re.compile(rf"(?P<m>(?:\b(?:{_TYPE_WORDS})\s+)*)(?P<k>@?\b(?:class|interface|enum|record))\s+(?P<n>{_ID})(?P<h>[^{{;]*)\{{")
_JAVA_MEMBER = re.compile(rf"(?m)^[ \t]*(?:@\w[^\n]*\n[ \t]*)*(?P<m>(?:(?:{_MEMBER_WORDS})\s+)*)(?P<t>{_ID}[\w.<>,\[\]? ]*?)\s+(?P<n>{_ID})\s*(?P<e>\(|=|;)")
_NOT_MEMBERS = frozenset("return new throw else case package import if for while switch try catch do assert".split())


def java_facts(text: str) -> Facts:
    code, lines = blank_comments(text), Lines(text)
    bare = blank_comments(text, strings=True)
    package = re.search(rf"(?m)^\s*package\s+({_PATH})\s*;", bare)
    facts = Facts(package[1] if package else None)
    for m in re.finditer(rf"(?m)^\s*import\s+(static\s+)?({_PATH})(\s*\.\s*\*)?\s*;", bare):
        facts["imports"].append(import_ref(raw=m[0].strip(), module=m[2], line=lines.at(m.start(2))[0], kind="static" if m[1] else "import", tags=["wildcard"] if m[3] else []))
    for m in _JAVA_TYPE.finditer(bare):
        line, col = lines.at(m.start("n"))
        outer = bare.count("{", 0, m.start()) - bare.count("}", 0, m.start())
        head = m["h"]
        for word, kind in (("extends", "extends"), ("implements", "implements"), ("permits", "permits")):
            if b := re.search(rf"\b{word}\s+(.*?)(?=\bimplements\b|\bpermits\b|\bextends\b|$)", head, re.S):
                facts["relations"] += [{"kind": kind, "subject": m["n"], "object": x} for x in _bases(b[1])]
        kind = {"@interface": "annotation"}.get(m["k"], m["k"])
        params = [{"name": p.split()[-1], "kind": "component", "type": " ".join(p.split()[:-1]), "default": None} for p in split_list((re.match(r"\s*\((.*)\)", head, re.S) or ["", ""])[1])] if kind == "record" else []
        facts["symbols"].append(symbol(kind=kind, name=m["n"], line=line, col=col, params=params, flags=[*m["m"].split(), *(["nested"] if outer else [])], bases=[r["object"] for r in facts["relations"] if r["subject"] == m["n"]]))
        if not outer and "public" in m["m"]:
            facts["exports"].append(m["n"])
    body = _members_only(bare)
    for m in _JAVA_MEMBER.finditer(body):
        if m["t"].split()[0] in _NOT_MEMBERS or m["n"] in _NOT_MEMBERS:
            continue
        line, col = lines.at(m.start("n"))
        facts["symbols"].append(symbol(kind="method" if m["e"] == "(" else "field", name=m["n"], line=line, col=col, returns=m["t"].strip(), flags=m["m"].split()))
    for m in re.finditer(rf"@({_PATH})", bare):
        if m[1] != "interface":
            facts["relations"].append({"kind": "annotation", "subject": None, "object": m[1]})
    del code
    return facts


def _members_only(text: str) -> str:
    """The text with everything two or more braces deep blanked."""
    out, depth = [], 0
    for ch in text:
        if ch == "}":
            depth = max(0, depth - 1)
        out.append(ch if depth <= 1 or ch == "\n" else " ")
        if ch == "{":
            depth += 1
    return "".join(out)


# == Kotlin

_KOTLIN_DECL = re.compile(rf"(?m)^[ \t]*(?:@\w\S*\s+)*(?P<m>(?:(?:public|internal|private|protected|open|abstract|final|sealed|data|enum|annotation|inline|suspend|operator|infix|override|const|lateinit|tailrec|value|companion|expect|actual)\s+)*)(?P<k>class|interface|object|fun|val|var|typealias)\s+(?:<[^>]*>\s*)?(?:{_ID}\.)?(?P<n>{_ID})(?P<r>[^\n]*)")
_KOTLIN_IGNORE = frozenset("package import class interface object fun val var if else when for while do return true false null this super is as in by it String Int Long Boolean Double Float Unit Any List Map Set".split())


def kotlin_facts(text: str) -> Facts:
    bare, lines = blank_comments(text, strings=True), Lines(text)
    package = re.search(rf"(?m)^\s*package\s+({_PATH})", bare)
    facts = Facts(package[1] if package else None)
    for m in re.finditer(rf"(?m)^\s*import\s+({_PATH})(\.\*)?(?:\s+as\s+({_ID}))?", bare):
        facts["imports"].append(import_ref(raw=m[0].strip(), module=m[1], names=[(m[1].rpartition(".")[2], m[3])] if m[3] else [], line=lines.at(m.start(1))[0], tags=["wildcard"] if m[2] else []))
    top = depth_zero(bare)
    for m in _KOTLIN_DECL.finditer(top):
        kind = {"fun": "function", "val": "property", "var": "property", "typealias": "type"}.get(m["k"], m["k"])
        line, col = lines.at(m.start("n"))
        bases = _bases(re.split(r"[{=]", re.sub(r"\([^)]*\)", "", m["r"]).partition(":")[2])[0]) if kind in ("class", "interface", "object") else []
        facts["relations"] += [{"kind": "extends", "subject": m["n"], "object": b} for b in bases]
        facts["symbols"].append(symbol(kind=kind, name=m["n"], line=line, col=col, bases=bases, flags=m["m"].split()))
        if not {"private", "internal"} & set(m["m"].split()):
            facts["exports"].append(m["n"])
    rest = re.sub(rf"(?m)^\s*(?:package|import)\s+{_PATH}[^\n]*", "", bare)
    facts["tokens"] = sorted({t for t in re.findall(_ID, rest) if t not in _KOTLIN_IGNORE and len(t) > 1})
    return facts


# == Go


def go_facts(text: str) -> Facts:
    code, bare, lines = blank_comments(text), blank_comments(text, strings=True), Lines(text)
    package = re.search(rf"(?m)^\s*package\s+({_ID})", bare)
    facts = Facts(package[1] if package else None)
    one = re.compile(rf"(?P<a>{_ID}|[._])?[ \t]*[\"`](?P<s>[^\"`\n]+)[\"`]")
    for block in re.finditer(r"(?m)^[ \t]*import\b[ \t]*(?:\((?P<b>[^)]*)\)|(?P<l>[^\n]*))", code):
        part = "b" if block["b"] is not None else "l"
        for m in one.finditer(block[part]):
            facts["imports"].append(import_ref(raw=m[0].strip(), module=m["s"], names=[(m["s"], m["a"])] if m["a"] else [], line=lines.at(block.start(part) + m.start("s"))[0]))
    top = depth_zero(bare)
    for m in re.finditer(rf"(?m)^func\s+(?:\(\s*(?:{_ID}\s+)?\*?(?P<o>{_ID})[^)]*\)\s*)?(?P<n>{_ID})\s*[\[(]", top):
        line, col = lines.at(m.start("n"))
        facts["symbols"].append(symbol(kind="method" if m["o"] else "function", name=m["n"], owner=m["o"], line=line, col=col))
    for m in re.finditer(rf"(?m)^type\s+(?P<n>{_ID})(?:\[[^\]]*\])?\s+(?P<k>struct|interface|=?\s*[\w.\[\]*]+)", top):
        line, col = lines.at(m.start("n"))
        facts["symbols"].append(symbol(kind=m["k"] if m["k"] in ("struct", "interface") else "type", name=m["n"], line=line, col=col))
    for m in re.finditer(rf"(?m)^(?:var|const)\s+(?P<n>{_ID})", top):
        line, col = lines.at(m.start("n"))
        facts["symbols"].append(symbol(kind="global", name=m["n"], line=line, col=col))
    facts["exports"] = sorted({s["name"] for s in facts["symbols"] if s["name"][:1].isupper() and not s["owner"]})
    return facts


# == Rust


def _use_tree(text: str, lead: str = "") -> list[tuple[str, str | None]]:
    """(path, alias) of every leaf of a use declaration; a glob ends in ::*."""
    out: list[tuple[str, str | None]] = []
    for part in split_list(text):
        if "{" in part:
            head, _, rest = part.partition("{")
            out += _use_tree(rest.rstrip().removesuffix("}"), lead + head.strip())
        else:
            path, _, alias = part.partition(" as ")
            path = lead + path.strip()
            out.append((path.removesuffix("::self"), alias.strip() or None))
    return out


def rust_facts(text: str) -> Facts:
    bare, lines = blank_comments(re.sub(r"'(?=[a-z_]\w*\b(?!'))", " ", text), strings=True), Lines(text)
    facts = Facts()
    for m in re.finditer(rf"(?m)^[ \t]*(?P<v>{_PUB})?use\s+(?P<t>[^;]+);", bare):
        for path, alias in _use_tree(re.sub(r"\s+", " ", m["t"])):
            glob = path.endswith("::*") or path == "*"
            facts["imports"].append(
                import_ref(raw=m[0].strip(), module=path.removesuffix("::*"), names=[(path.rpartition("::")[2], alias)] if alias else [], line=lines.at(m.start("t"))[0], kind="reexport" if m["v"] else "import", tags=["wildcard"] if glob else [])
            )
    top = depth_zero(bare)
    for m in re.finditer(rf"(?m)^[ \t]*(?P<v>{_PUB})?(?:async\s+|unsafe\s+|const\s+(?=fn))*(?P<k>fn|struct|enum|trait|union|type|const|static|mod|macro_rules!)\s+(?:mut\s+)?(?P<n>{_ID})(?P<r>[^\n{{;]*)(?P<e>[;{{]?)", top):
        line, col = lines.at(m.start("n"))
        kind = {"fn": "function", "const": "global", "static": "global", "mod": "module", "macro_rules!": "macro"}.get(m["k"], m["k"])
        if kind == "module" and m["e"] == ";":
            facts["imports"].append(import_ref(raw=m[0].strip(), module=m["n"], line=line, kind="mod"))
        facts["symbols"].append(symbol(kind=kind, name=m["n"], line=line, col=col, flags=["pub"] if m["v"] else []))
        if m["v"]:
            facts["exports"].append(m["n"])
        if kind == "trait" and ":" in m["r"]:
            facts["relations"] += [{"kind": "supertrait", "subject": m["n"], "object": b.strip()} for b in m["r"].partition(":")[2].split("+") if b.strip()]
    for m in re.finditer(r"(?m)^[ \t]*impl(?:<[^>]*>)?\s+(?P<a>[\w:<>, ]+?)(?:\s+for\s+(?P<b>[\w:<>, ]+?))?\s*(?:where\b[^{]*)?\{", top):
        a, b = (re.sub(r"<.*", "", x or "").strip() for x in (m["a"], m["b"]))
        if b:
            facts["relations"].append({"kind": "impl", "subject": b, "object": a})
        owner = b or a
        start = m.end()
        end = _closing(bare, start)
        for f in re.finditer(rf"(?m)^[ \t]*(?P<v>{_PUB})?(?:async\s+|unsafe\s+|const\s+)*fn\s+(?P<n>{_ID})", bare[start:end]):
            line, col = lines.at(start + f.start("n"))
            facts["symbols"].append(symbol(kind="method", name=f["n"], owner=owner, line=line, col=col, flags=["pub"] if f["v"] else []))
    for m in re.finditer(r"#!?\[\s*(?P<n>[\w:]+)\s*(?:\((?P<a>[^\]]*)\))?[^\]]*\]", bare):
        if m["n"] == "derive":
            facts["relations"] += [{"kind": "derive", "subject": None, "object": d} for d in split_list(m["a"] or "")]
        else:
            facts["relations"].append({"kind": "attribute", "subject": None, "object": m["n"]})
    return facts


def _closing(text: str, at: int) -> int:
    depth = 1
    for k in range(at, len(text)):
        depth += (text[k] == "{") - (text[k] == "}")
        if depth == 0:
            return k
    return len(text)


# == Ruby

_RUBY_OPEN = re.compile(r"^\s*(?:class|module|def|begin|case|if|unless|while|until|for)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$|=\s*(?:if|case|begin|unless)\b")
_CONST = r"[A-Z]\w*(?:::[A-Z]\w*)*"
_RAILS_DSL = frozenset("has_many has_one belongs_to has_and_belongs_to_many validates validate scope before_action after_action before_save after_save callback delegate enum".split())
_ASSOCIATIONS = frozenset("has_many has_one belongs_to has_and_belongs_to_many".split())


def _ruby_bare(text: str) -> str:
    text = re.sub(r"(?ms)^=begin\b.*?^=end\b[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    return re.sub(r"(?m)(?<![\w\"'#])#(?![{])[^\n]*", lambda m: " " * len(m[0]), text)


def ruby_facts(text: str) -> Facts:
    facts = Facts()
    names: list[str] = []  # of the open class and module bodies; "" for other blocks
    for n, line in enumerate(_ruby_bare(text).split("\n"), 1):
        if m := re.match(r"\s*(require|require_relative|load|autoload)\b[ (]*(?::\w+\s*,\s*)?['\"]([^'\"]+)['\"]", line):
            facts["imports"].append(import_ref(raw=line.strip(), module=m[2], line=n, kind=m[1], scope="module" if not any(names) else "class"))
        space = "::".join(x for x in names if x)
        if m := re.match(rf"\s*(class|module)\s+({_CONST})\s*(?:<\s*({_CONST}))?", line):
            full = f"{space}::{m[2]}" if space else m[2]
            facts["symbols"].append(symbol(kind=m[1], name=full, line=n, bases=[m[3]] if m[3] else []))
            if m[3]:
                facts["relations"].append({"kind": "extends", "subject": full, "object": m[3]})
            if not re.search(r"\bend\s*$", line):
                names.append(m[2])
            continue
        if m := re.match(r"\s*def\s+(self\.)?([a-zA-Z_]\w*[?!=]?)", line):
            facts["symbols"].append(symbol(kind="method" if space else "function", name=m[2], owner=space or None, line=n, flags=["class_method"] if m[1] else []))
        if m := re.match(r"\s*(include|extend|prepend)\s+(" + _CONST + ")", line):
            facts["relations"].append({"kind": m[1], "subject": space or None, "object": m[2]})
        if (m := re.match(r"\s*([a-z_]+)\b[ (]+:(\w+)(.*)", line)) and m[1] in _RAILS_DSL and space:
            facts["notes"].append(f"rails:{m[1]}")
            if m[1] in _ASSOCIATIONS:
                given = re.search(r"class_name:\s*['\"]([\w:]+)['\"]", m[3])
                facts["relations"].append({"kind": f"association:{m[1]}", "subject": space, "object": given[1] if given else m[2]})
        for m in re.finditer(rf"\b({_CONST})\.([a-z_]\w*[?!]?)", line):
            facts["method_uses"].append({"base": m[1], "attr": m[2]})
        for m in re.finditer(rf"(?<![\w:])({_CONST})\b", line):
            facts["refs"].append(m[1])
        if m := re.search(r"\bENV(?:\.fetch\(|\[)\s*['\"](\w+)['\"]", line):
            facts.candidate(kind="env_ref", target=m[1], meta={"var": m[1], "system": "ruby"}, line=n, col=m.start(), syntax="ENV", confidence=1.0)
        one_line = re.search(r"\bend\b", line) and _RUBY_OPEN.search(line)
        if _RUBY_OPEN.search(line) and not one_line:
            names.append("")
        elif re.match(r"\s*end\b", line) and names:
            names.pop()
    facts["refs"] = sorted(set(facts["refs"]))
    facts["method_uses"] = [{"base": a, "attr": b} for a, b in sorted({(u["base"], u["attr"]) for u in facts["method_uses"]})]
    facts["exports"] = sorted({s["name"] for s in facts["symbols"] if s["kind"] in ("class", "module")})
    return facts
