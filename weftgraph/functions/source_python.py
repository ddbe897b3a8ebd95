"""Facts of one Python source by the standard parser: imports, symbols, references, candidates for links."""

from __future__ import annotations

import ast
import json
import re

from .source_common import Facts, import_ref, symbol

_VERBS = frozenset("get post put patch delete head options".split())
_DYNAMIC = {("importlib", "import_module"), ("__import__",), ("import_module",)}
_LINE = re.compile(r"^[ \t]*(?:import[ \t]+[\w.]|from[ \t]+[.\w]+[ \t]+import\b)")


def import_lines(text: str) -> list[str]:
    """Lines that look like imports, for sources that don't parse."""
    return [x.rstrip() for x in text.splitlines() if _LINE.match(x)]


def dotted(node: ast.AST) -> tuple[str, ...]:
    """Names of a chain such as a.b.c; empty for anything else."""
    parts: list[str] = []
    at = node
    while isinstance(at, ast.Attribute):
        at, parts = at.value, [at.attr, *parts]
    return (at.id, *parts) if isinstance(at, ast.Name) else ()


def literal(node: ast.AST | None) -> str | None:
    v = getattr(node, "value", None)
    return v if type(node) is ast.Constant and type(v) is str else None


def template(node: ast.AST | None) -> tuple[str | None, float]:
    """A literal, or an f-string with {} for each expression, and how sure that is."""
    if isinstance(node, ast.JoinedStr):
        return "".join(v.value if isinstance(v, ast.Constant) else "{" + (ast.unparse(v.value) if isinstance(v, ast.FormattedValue) else "") + "}" for v in node.values), 0.9
    return literal(node), 1.0


def _strings(node: ast.AST | None) -> list[str]:
    return [s for e in node.elts if (s := literal(e)) is not None] if isinstance(node, (ast.List, ast.Tuple, ast.Set)) else []


def _keyword(call: ast.Call, name: str) -> ast.AST | None:
    return next((k.value for k in call.keywords if k.arg == name), None)


def _text(node: ast.AST | None) -> str | None:
    return None if node is None else ast.unparse(node)


def parameters(args: ast.arguments) -> list[dict]:
    """Parameters in order with kind, annotation and default; positional-only ones too."""
    plain = [(a, "positional_only") for a in args.posonlyargs] + [(a, "positional_or_keyword") for a in args.args]
    defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
    rows = [(a, k, d) for (a, k), d in zip(plain, defaults, strict=True)]
    rows += [(args.vararg, "var_positional", None)] if args.vararg else []
    rows += [(a, "keyword_only", d) for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True)]
    rows += [(args.kwarg, "var_keyword", None)] if args.kwarg else []
    return [{"name": a.arg, "kind": k, "type": _text(a.annotation), "default": _text(d)} for a, k, d in rows]


class _Visitor(ast.NodeVisitor):
    def __init__(self, text: str, facts: Facts):
        self.text, self.facts = text, facts
        self.scope: list[str] = []
        self.guarded = 0
        self.typing, self.flags = {"typing", "typing_extensions"}, {"TYPE_CHECKING"}
        self.refs: set[str] = set()
        self.uses: set[tuple[str, str]] = set()
        self.bound: dict[str, str] = {}
        self.methods: set[tuple[str, str]] = set()
        self.classes_used: set[str] = set()
        self.doc_lines: set[int] = set()

    # --- scopes and guards

    def where(self) -> str:
        return self.scope[-1] if self.scope else "module"

    def _guard(self, test: ast.AST) -> bool | None:
        """Whether a test is about the type checker: True if it holds for it, False if it doesn't, None if neither."""
        if isinstance(getattr(test, "op", None), ast.Not):
            inner = self._guard(test.operand)
            return None if inner is None else not inner
        if isinstance(test, ast.BoolOp):
            parts = [self._guard(v) for v in test.values]
            return True if any(p is True for p in parts) else None
        if isinstance(test, ast.Compare) and len(test.ops) == 1 and isinstance(test.comparators[0], ast.Constant):
            inner = self._guard(test.left)
            same = bool(test.comparators[0].value) == isinstance(test.ops[0], (ast.Is, ast.Eq))
            return None if inner is None else inner == same
        chain = dotted(test)
        if len(chain) == 1 and chain[0] in self.flags or len(chain) == 2 and chain[0] in self.typing and chain[1] == "TYPE_CHECKING":
            return True
        return None

    def visit_If(self, node):
        kind = self._guard(node.test)
        self.visit(node.test)
        for body, on in ((node.body, kind is True), (node.orelse, kind is False)):
            self.guarded += on
            for x in body:
                self.visit(x)
            self.guarded -= on

    def _inside(self, name: str, node: ast.AST, skip: tuple = ()) -> None:
        self.scope.append(name)
        for x in ast.iter_child_nodes(node):
            if x not in skip:
                self.visit(x)
        self.scope.pop()

    # --- imports

    def _import(self, node: ast.AST, module: str | None, names: list, *, is_from: bool, level: int = 0, tags: tuple = (), kind: str = "import") -> None:
        raw = ast.get_source_segment(self.text, node) or ""
        scope = self.where()
        tagged = (["delegate"] if scope != "module" or "delegate-import" in raw or "delegate-call" in raw else []) + [t for t in tags]
        self.facts["imports"].append(
            import_ref(raw=raw, module=module, names=names, is_from=is_from, level=level, type_checking=self.guarded > 0, line=node.lineno, end_line=node.end_lineno, scope=scope, kind=kind, tags=list(dict.fromkeys(tagged)))
        )

    def visit_Import(self, node):
        for a in node.names:
            if a.name in ("typing", "typing_extensions"):
                self.typing.add(a.asname or a.name)
        if not self.scope:
            for a in node.names:
                self.facts["local_imports"].append({"name": a.asname or a.name.split(".")[0], "line": node.lineno, "col": node.col_offset, "module": a.name, "attr": None, "level": 0})
        self._import(node, None, [(a.name, a.asname) for a in node.names], is_from=False)

    def visit_ImportFrom(self, node):
        if node.module in ("typing", "typing_extensions"):
            self.flags |= {a.asname or a.name for a in node.names if a.name == "TYPE_CHECKING"}
        if not self.scope:
            for a in node.names:
                self.facts["local_imports"].append({"name": a.asname or a.name, "line": node.lineno, "col": node.col_offset, "module": node.module, "attr": a.name, "level": node.level})
        self._import(node, node.module, [(a.name, a.asname) for a in node.names], is_from=True, level=node.level)

    # --- definitions

    def _docstring(self, node: ast.AST) -> str | None:
        body = getattr(node, "body", None)
        if body and isinstance(body[0], ast.Expr) and literal(body[0].value) is not None:
            self.doc_lines.update(range(body[0].lineno, body[0].end_lineno + 1))
            return ast.get_docstring(node)
        return None

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        doc = self._docstring(node)
        owner = self.facts.owner if self.scope == ["class"] else None
        if not self.scope or owner:
            decorators = [_text(d) for d in node.decorator_list]
            flags = ["async"] if isinstance(node, ast.AsyncFunctionDef) else []
            flags += [d for d in ("property", "staticmethod", "classmethod") if d in decorators]
            flags += ["generator"] if any(isinstance(x, (ast.Yield, ast.YieldFrom)) for x in ast.walk(node)) else []
            self.facts["symbols"].append(
                symbol(kind="method" if owner else "function", name=node.name, owner=owner, line=node.lineno, col=node.col_offset, docstring=doc, params=parameters(node.args), returns=_text(node.returns), decorators=decorators, flags=flags)
            )
            if node.name == "__getattr__" and not owner:
                self.facts["notes"].append("module_getattr")
            if not owner and (m := re.fullmatch(r"resolve_(\w+)", node.name)) and [a.arg for a in node.args.args][:2] == ["root", "info"]:
                name = "".join(w.capitalize() for w in m[1].split("_"))
                self._candidate("graphql_op", node, "graphql", method="query", target=name, meta={"op_type": "query", "name": name})
        for d in node.decorator_list:
            self._route(d)
        self._inside("function", node)

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node):
        doc = self._docstring(node)
        bases = [_text(b) for b in node.bases]
        self.classes_used.update(b.split(".")[-1] for b in bases)
        if not self.scope:
            self.facts["symbols"].append(symbol(kind="class", name=node.name, line=node.lineno, col=node.col_offset, docstring=doc, bases=bases, decorators=[_text(d) for d in node.decorator_list]))
            for b in bases:
                if b.endswith("Servicer") and "_grpc." in b:
                    service = b.rsplit(".", 1)[1].removesuffix("Servicer")
                    for m in node.body:
                        if isinstance(m, ast.FunctionDef) and not m.name.startswith("_"):
                            self._candidate("rpc_impl", m, "grpc", target=f"{service}.{m.name}", meta={"name": f"{service}.{m.name}", "system": "grpc"}, confidence=0.9)
            self.facts.owner = node.name
        self._inside("class", node)
        if not self.scope:
            self.facts.owner = None

    def _assign(self, target: ast.AST, value: ast.AST | None, annotation: ast.AST | None = None) -> None:
        if not isinstance(target, ast.Name):
            return
        if not self.scope:
            self.facts["symbols"].append(symbol(kind="global", name=target.id, line=target.lineno, col=target.col_offset, returns=_text(annotation)))
            if target.id == "__all__":
                self.facts["exports"] += _strings(value)
        elif self.scope == ["class"]:
            self.facts["symbols"].append(symbol(kind="attribute", name=target.id, owner=self.facts.owner, line=target.lineno, col=target.col_offset, returns=_text(annotation)))
        if isinstance(value, ast.Call) and (chain := dotted(value.func)) and chain[-1][:1].isupper():
            self.bound[target.id] = ".".join(chain)

    def visit_Assign(self, node):
        for t in node.targets:
            self._assign(t, node.value)
        self.generic_visit(node)

    def visit_AnnAssign(self, node):
        self._assign(node.target, node.value, node.annotation)
        self.generic_visit(node)

    def visit_AugAssign(self, node):
        if isinstance(node.target, ast.Name) and node.target.id == "__all__" and not self.scope:
            self.facts["exports"] += _strings(node.value)
        self.generic_visit(node)

    # --- references

    def visit_Name(self, node):
        self.refs |= {node.id} if isinstance(node.ctx, ast.Load) else set()

    def visit_Attribute(self, node):
        chain = dotted(node)
        if chain:
            self.refs.add(chain[0])
            for k in range(1, len(chain)):
                self.uses.add((".".join(chain[:k]), chain[k]))
            if chain[0] in self.bound and len(chain) > 1:
                self.methods.add((self.bound[chain[0]], chain[1]))
        else:
            self.generic_visit(node)

    # --- candidates for links between languages

    def _candidate(self, kind: str, node: ast.AST, syntax: str, *, target: str, meta: dict, method: str | None = None, confidence: float = 1.0) -> None:
        self.facts.candidate(kind=kind, method=method, target=target, meta=meta, line=node.lineno, col=node.col_offset, syntax=syntax, confidence=confidence)

    def _route(self, dec: ast.AST) -> None:
        if not isinstance(dec, ast.Call) or not (chain := dotted(dec.func)) or len(chain) < 2:
            return
        path, sure = template(dec.args[0] if dec.args else _keyword(dec, "path") or _keyword(dec, "rule"))
        if path is None:
            return
        if chain[-1] in _VERBS:
            self._candidate("http_route", dec, "decorator", method=chain[-1].upper(), target=path, meta={"method": chain[-1].upper(), "path": path, "framework": "fastapi"}, confidence=sure)
        elif chain[-1] == "route":
            for m in _strings(_keyword(dec, "methods")) or ["GET"]:
                self._candidate("http_route", dec, "decorator", method=m.upper(), target=path, meta={"method": m.upper(), "path": path, "framework": "flask"}, confidence=sure)
        elif chain[-1] == "on" and "socket" in chain[0].lower():
            self._candidate("socket_event", dec, "decorator", target=path, meta={"event": path, "system": "socketio", "dir": "on"})

    def visit_Call(self, node):
        chain = dotted(node.func)
        first = literal(node.args[0]) if node.args else None
        if chain:
            if chain[-1][:1].isupper():
                self.classes_used.add(chain[-1])
            if first is not None and chain[-2:] == ("os", "getenv"):
                self._candidate("env_ref", node, "os.getenv", target=first, meta={"var": first, "system": "os"})
            elif first is not None and chain[-3:] == ("os", "environ", "get"):
                self._candidate("env_ref", node, "os.environ.get", target=first, meta={"var": first, "system": "os"})
            elif first is not None and chain in _DYNAMIC:
                self._import(node, first, [], is_from=False, tags=("dynamic", "delegate"), kind="dynamic")
            elif first is not None and chain[-1] == "emit" and "socket" in chain[0].lower():
                self._candidate("socket_event", node, "emit", target=first, meta={"event": first, "system": "socketio", "dir": "emit"})
            elif first is not None and chain[-1] in ("send", "publish") and "producer" in chain[0].lower():
                self._candidate("queue_event", node, "producer", target=first, meta={"event": first, "system": "kafka"})
            elif chain[-1] == "FastAPI":
                for arg, kind in (("openapi_url", "schema"), ("docs_url", "docs")):
                    if (v := literal(_keyword(node, arg))) is not None:
                        self._candidate("openapi", node, arg, method=kind, target=v, meta={"type": kind, "id": v, "framework": "fastapi"})
        self.generic_visit(node)

    def visit_Subscript(self, node):
        if dotted(node.value)[-2:] == ("os", "environ") and (v := literal(node.slice)) is not None:
            self._candidate("env_ref", node, "os.environ[]", target=v, meta={"var": v, "system": "os"})
        self.generic_visit(node)


def python_facts(text: str) -> Facts:
    facts = Facts()
    tree = ast.parse(text)
    v = _Visitor(text, facts)
    v._docstring(tree)
    v.visit(tree)
    facts["refs"] = sorted(v.refs)
    facts["uses"] = [{"base": a, "attr": b} for a, b in sorted(v.uses)]
    facts["method_uses"] = [{"base": a, "attr": b} for a, b in sorted(v.methods)]
    facts["class_uses"] = sorted(v.classes_used)
    facts["exports"] = list(dict.fromkeys(facts["exports"]))
    facts["docstring_lines"] = _doc_only(text, v.doc_lines)
    return facts


def _doc_only(text: str, found: set[int]) -> int:
    """Lines of docstrings that aren't blank."""
    lines = text.split("\n")
    return sum(1 for i in found if i <= len(lines) and lines[i - 1].strip())


def signature_json(sym: dict) -> str:
    return json.dumps({k: sym[k] for k in ("name", "params", "returns", "decorators", "flags")}, ensure_ascii=False)
