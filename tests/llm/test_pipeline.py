from __future__ import annotations

import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tests.llm.support import DOCS, prose, words
from weftgraph.llm import mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A small corpus with planted cases, and what becomes of them."""
    rng = random.Random(7)
    d = tmp_path_factory.mktemp("sf")
    items = [(k, " ".join(prose(rng, 30))) for k in range(6)]
    passage = prose(rng, 70)
    rows, labels, plan = [], [], {"toxic": set(), "copy": {}, "passage": [], "leak": set(), "clean": set()}
    for i in range(700):
        w = prose(rng, rng.randrange(100, 200))
        if i % 10 == 1:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["moron", "scum", "idiot"])
            plan["toxic"].add(i)
        elif i % 50 == 2 and i > 100:
            w = rows[i - 9][1].split()  # a document of kind 3
            w[50] = "changed"
            plan["copy"][i] = i - 9
        elif i % 50 == 4:
            w[20:20] = passage
            plan["passage"].append(i)
        elif i % 50 == 5:
            w[30:30] = rng.choice(items)[1].split()
            plan["leak"].add(i)
        else:
            plan["clean"].add(i)
        labels.append((i, 1, int(i in plan["toxic"])))
        rows.append((i, " ".join(w), "en", f"src{i % 4 if i % 4 < 2 else 0}", len(" ".join(w))))
    rows += [(None, "no id at all here", "en", "src0", 3), (1000, None, None, None, None), (1001, "", "en", "src1", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), {r[0]: r for r in rows}, plan, passage


def test_stages_in_turn(spark, sf, tmp_path):
    d, rows, plan, passage = sf
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == COLUMNS + (["copy_no"] if k == 4 else []), name
        kept.append({r.doc_id: r for r in docs.collect()})
    everyone = set(rows)
    assert everyone - set(kept[0]) == plan["toxic"]
    assert set(kept[0]) - set(kept[1]) == set(plan["copy"])
    assert set(kept[2]) == set(kept[1])
    for i in kept[2]:
        w = words(rows[i][1])
        gone = i in plan["passage"][1:]
        assert words(kept[2][i].text) == (w[:20] + w[20 + len(passage) :] if gone else w)
    assert set(kept[2]) - set(kept[3]) == plan["leak"]
    con = duckdb.connect()
    con.register("documents", spark.read.parquet(f"{tmp_path}/3").toPandas())
    want = Counter(r for r in con.sql(f"SELECT doc_id, copy_no FROM ({mixing.sql_over('documents')})").fetchall())
    assert Counter((r.doc_id, r.copy_no) for r in docs.collect()) == want
    again = corpus_pipeline.run(spark, d)
    assert Counter((r.doc_id, r.copy_no, r.text) for r in again.collect()) == Counter((r.doc_id, r.copy_no, r.text) for r in docs.collect())


def test_stages_over_nothing(spark, sf):
    d = sf[0]
    empty = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, empty, d)
        assert got.count() == 0 and got.columns[:5] == COLUMNS, name
