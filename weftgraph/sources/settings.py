"""Settings: built-in defaults, overridden by the first file found; values out of bounds fall back."""

from __future__ import annotations

import math
import os
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

FILE, VARIABLE, TABLE = "weftgraph.toml", "WEFTGRAPH_CONFIG", "weftgraph"


@dataclass(frozen=True)
class Settings:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = field(default=tuple(f"**/{d}/**" for d in ".venv build dist site-packages".split()))
    source_roots: tuple[str, ...] = tuple("backend src server app services python".split())
    max_file_bytes: int = 20_000_000
    include_tests: bool = True
    type_checking_imports: bool = True
    dynamic_imports: bool = True
    facade: str = "pattern"  # which children of a package with __getattr__ are soft candidates: off, pattern, all
    facade_patterns: tuple[str, ...] = ("export_*.py",)
    external_prefixes: tuple[str, ...] = ()
    edge_policy: str = "strict"  # strict, soft
    mode: str = "classic"  # classic, zones
    include_external: bool = False
    clone_lines: int = 5
    clone_idents: bool = True
    symbol_edges_per_file: int = 25
    zoom: float = 1.0

    def checked(self) -> Settings:
        one_of = lambda v, *allowed: v if v in allowed else allowed[0]
        zoom = min(max(self.zoom, 0.1), 8.0) if isinstance(self.zoom, (int, float)) and math.isfinite(self.zoom) and self.zoom > 0 else 1.0
        return replace(
            self, zoom=zoom, mode=one_of(str(self.mode).strip().lower(), "classic", "zones"), edge_policy=one_of(str(self.edge_policy).strip().lower(), "strict", "soft"),
            facade=one_of(self.facade, "pattern", "off", "all"), max_file_bytes=self.max_file_bytes if self.max_file_bytes > 0 else 2_000_000,
            source_roots=tuple(r.strip("/\\") for r in self.source_roots), clone_lines=max(2, self.clone_lines),
        )


def from_mapping(values: dict, base: Settings | None = None) -> Settings:
    """Known keys only; lists become tuples."""
    known = {f.name for f in fields(Settings)}
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known}
    return replace(base or Settings(), **given).checked()


def load(root: str | Path, cache: str | Path | None = None) -> Settings:
    """The first that has our table: the file the environment names, the cache's, the root's, the root's pyproject.toml."""
    places = [Path(os.environ[VARIABLE])] if os.environ.get(VARIABLE) else []
    places += [Path(cache) / FILE] if cache else []
    places += [Path(root) / FILE, Path(root) / "pyproject.toml"]
    for p in places:
        if not p.is_file():
            continue
        with p.open("rb") as f:
            data = tomllib.load(f)
        table = data.get("tool", {}).get(TABLE) if p.name == "pyproject.toml" else data.get(TABLE, data)
        if isinstance(table, dict):
            return from_mapping(table)
    return Settings().checked()
