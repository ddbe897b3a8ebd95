"""The queries and DuckDB statements of this subpackage, by name."""

from __future__ import annotations

from . import chat, decontam, globs, minhash, mixing, pst, suffix, topk, toxicity, warc

MODULES = (decontam, toxicity, topk, mixing, minhash, suffix, warc, pst, chat, globs)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
