from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.support import DOCS
from weftgraph.llm import mixing


def rows(n=900):
    return [(i * 37 % 5000, "x" * (i % 50), "en", ["big", "big", "big", "mid", None][i % 5], 0) for i in range(n)]


def keyed(df):
    return Counter((r.doc_id, r.source, r.copy_no) for r in df.collect())


def test_equals_sql_at_any_bucket_size(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = Counter((a, b, c) for a, b, c in con.sql(f"SELECT doc_id, source, copy_no FROM ({mixing.sql_over('documents')})").fetchall())
    assert keyed(mixing.mix(docs)) == want == keyed(mixing.mix(docs, bucket_rows=7)) == keyed(mixing.mix(docs, bucket_rows=100))


def test_ranges_are_small_however_ids_lie(spark):
    """A third of the rows without an id, a third with one id, the others close together or far away."""
    data = [(None, f"n{i}", "en", "big", 0) for i in range(300)] + [(77, f"t{i}", "en", "big", 0) for i in range(300)]
    data += [(1000 + i, f"c{i}", "en", "big", 0) for i in range(200)] + [(10**15 * (i + 1), f"f{i}", "en", "mid", 0) for i in range(100)]
    docs = spark.createDataFrame(data, DOCS)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = Counter(con.sql(f"SELECT doc_id, text, copy_no FROM ({mixing.sql_over('documents')})").fetchall())
    got = mixing.mix(docs, bucket_rows=10)
    assert Counter((r.doc_id, r.text, r.copy_no) for r in got.collect()) == want


def test_shares_and_even_spread(spark):
    docs = spark.createDataFrame([(i, "x" * 10, "en", "a" if i < 300 else "b", 10) for i in range(1000)], DOCS)
    got = keyed(mixing.mix(docs, targets={"a": 3, "b": 1}))
    n = Counter(s for _, s, _ in got)
    assert abs(n["a"] - 750) <= 1 and abs(n["b"] - 250) <= 1
    per_doc = Counter(i for i, s, _ in got if s == "a")
    assert set(per_doc.values()) == {2, 3}  # 2.5 expected
    kept = sorted(i for i, s, _ in got if s == "b")
    assert max(b - a for a, b in zip(kept, kept[1:])) <= 3  # one of 2.8


def test_sources_not_named_are_left_out_and_null_can_be_named(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    assert {s for _, s, _ in keyed(mixing.mix(docs, targets={None: 1}))} == {None}


def test_edge_cases(spark):
    data = [(None, "abc", "en", "s", 3), (1, None, "en", "s", None), (1, "same", "en", "s", 4), (1, "same", "en", "s", 4), (2, "", None, "empty", 0), (9, "y" * 200_000, "en", None, 1)]
    docs = spark.createDataFrame(data, DOCS).withColumn("Copy_No", F.lit("c")).withColumn("rank", F.lit(0)).withColumn("e", F.lit(0)).withColumn("size", F.lit(1))
    got = mixing.mix(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "rank", "e", "size", "copy_no"]
    assert got.where("source = 'empty'").count() == 1
    assert got.count() > 0
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(TypeError):
        mixing.mix(docs, 3)
