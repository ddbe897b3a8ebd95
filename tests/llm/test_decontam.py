from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.support import docs_frame, prose, words
from weftgraph.llm import decontam


def sw(a, b):
    """Plain Smith-Waterman."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = decontam.MATCH if a[i - 1] == b[j - 1] else decontam.MISS
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] + decontam.GAP, h[i][j - 1] + decontam.GAP)
            best = max(best, h[i][j])
    return best


def fixture(seed=1):
    rng = random.Random(seed)
    items = [(k, " ".join(prose(rng, rng.randrange(15, 50), 1500))) for k in range(25)]
    rows = []
    for i in range(150):
        w = prose(rng, rng.randrange(20, 300), 1500)
        if i % 2:
            copy = rng.choice(items)[1].split()
            rate = rng.choice([0, 0.05, 0.1, 0.2, 0.7])
            copy = [x for x in (rng.choice(["zz", "yy", ""]) if rng.random() < rate else x for x in copy) if x]
            at = rng.randrange(len(w))
            w[at:at] = copy
        rows.append((i, " ".join(w)))
    return rows, items


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_against_full_alignment(spark):
    rows, items = fixture()
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs_frame(spark, rows), benchmark(spark, items)).collect()}
    want = {}
    for i, t in rows:
        for k, it in items:
            a = words(it)
            if len(set(words(t)) & set(a)) > len(set(a)) * 0.4:
                want[(i, k)] = sw(a, words(t)) / (2 * len(a))
    strong = {p for p, s in want.items() if s >= 0.5}
    assert len(strong) > 40
    assert len(strong & set(got)) >= 0.95 * len(strong)
    assert set(got) <= strong
    assert sum(abs(got[p] - want[p]) < 1e-3 for p in got) >= 0.95 * len(got)


def test_parts_of_the_benchmark_add_up(spark):
    rows, items = fixture(4)
    docs, bench = docs_frame(spark, rows), benchmark(spark, items)
    one = sorted(map(tuple, decontam.contaminated(docs, bench).collect()))
    assert sorted(map(tuple, decontam.contaminated(docs, bench, part_chars=900).collect())) == one


def test_batched_alignment_is_exact():
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 5, (40, 12)).astype(np.uint64), rng.integers(1, 5, (40, 30)).astype(np.uint64)
    assert list(decontam.smith_waterman(a, b)) == [sw(list(x), list(y)) for x, y in zip(a, b, strict=True)]


def test_a_leak_in_most_documents_is_still_found(spark):
    rng = random.Random(5)
    item = " ".join(prose(rng, 25))
    rows = [(i, " ".join(prose(rng, 30)) + " " + item) for i in range(60)] + [(100 + i, " ".join(prose(rng, 60))) for i in range(20)]
    got = decontam.contaminated(docs_frame(spark, rows), benchmark(spark, [(1, item)])).collect()
    assert {r.doc_id for r in got} == set(range(60)) and all(r.score == 1 for r in got)


def test_edge_cases(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(1, item), (1, item), (None, item), (2, None), (3, ""), (4, "alpha beta"), (5, "x " * 20_000 + item)]
    docs = docs_frame(spark, rows, item_id=F.lit(1), Score=F.lit("s"), gram=F.lit(2))
    items = [(7, item), (7, item), (8, None), (9, ""), (10, "alpha beta"), (None, item)]
    bench = benchmark(spark, items).withColumn("doc_id", F.lit(4))
    assert sorted(map(tuple, decontam.contaminated(docs, bench).collect())) == [(1, 7, 1.0), (5, 7, 1.0)]
    left = decontam.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "3", "4", "None"]
    assert decontam.contaminated(docs.limit(0), bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0
