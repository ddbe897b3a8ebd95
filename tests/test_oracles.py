"""Every query with a DuckDB statement gives its rows; the others run."""

from __future__ import annotations

import ast
from pathlib import Path

import pytest

from tests.oracle import difference
from weftgraph.functions import extract
from weftgraph.plans import workloads
from weftgraph.sources import tree

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the shared tables")


@pytest.mark.parametrize("name", sorted(workloads.ORACLES))
def test_query_equals_its_statement(spark, name):
    assert difference(spark, workloads.QUERIES[name], workloads.ORACLES[name], FOLDER) == ""


@pytest.mark.parametrize("name", ["route_crosstalk", "crosstalk_statistics", "missing_anti", "bfs_levels", "reach_node_order", "trade_scc"])
def test_query_has_rows(spark, name):
    assert workloads.QUERIES[name](spark, FOLDER).count() > (100 if name in ("bfs_levels", "reach_node_order", "trade_scc") else 0)


def test_names_agree():
    assert set(workloads.ORACLES) <= set(workloads.QUERIES)
    assert set(workloads.QUERIES) - set(workloads.ORACLES) == {"source_facts"}


def test_source_facts_equal_plain_calls(spark):
    rows = {r.path: r for r in workloads.source_facts(spark, FOLDER).collect()}
    docs = workloads.document_files(spark, FOLDER).select("path", "lang", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        facts, status, _ = extract.facts_of(d.text, d.lang)
        r = rows[d.path]
        assert (r.parse_status, r.imports, r.symbols, r.candidates) == (status, len(facts["imports"]), len(facts["symbols"]), len(facts["candidates"]))
        if d.lang == "python":
            try:
                ast.parse(d.text)
                assert status == "ok"
            except (SyntaxError, ValueError):
                assert status == "error"
        assert tree.language(d.path.rpartition("/")[2]) == d.lang
