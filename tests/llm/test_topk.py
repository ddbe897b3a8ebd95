from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from weftgraph.llm import topk


def brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6) + 0.0
    out = set()
    for i, a in enumerate(ids):
        best = sorted((-s[i, j], b) for j, b in enumerate(ids) if b != a)[:k]
        out |= {(int(a), r + 1, int(b)) for r, (_, b) in enumerate(best)}
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(f) for f in v], 0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, label int")


def test_equals_brute_force_with_many_tiles_levels_and_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[100:160] = x[100]  # more ties than k
    x[200:230] = 2 * x[200]
    ids = rng.permutation(10_000)[:400]
    want = brute(ids, x.astype(float), 5)
    for how in ({"tile": 1000}, {"tile": 60, "fan_in": 2, "asked": 90}):
        got = topk.top_k(frame(spark, ids, x), 5, dim=8, **how).collect()
        assert {(r.vec_id, r["rank"], r.neighbor_id) for r in got} == want and len(got) == len(want)


def test_queries_are_chosen_and_searched_in_all(spark):
    rng = np.random.default_rng(4)
    x, ids = rng.normal(size=(300, 6)).astype(np.float32), np.arange(300)
    got = topk.top_k(frame(spark, ids, x).repartition(5), 4, queries=F.col("vec_id") % 50 == 0, dim=6, tile=32, fan_in=2).collect()
    assert {(r.vec_id, r["rank"], r.neighbor_id) for r in got} == {w for w in brute(ids, x.astype(float), 4) if w[0] % 50 == 0}


def test_strips_do_not_matter():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(90)
    whole = topk.select_tile(x, ids, x, ids, 4)
    for cells in (1, 500):
        assert all((a == b).all() for a, b in zip(whole, topk.select_tile(x, ids, x, ids, 4, cells), strict=True))


def test_edge_cases(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (3, [5.0, 5.0]), (None, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]),
        (6, [1.0]), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, []),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("q", F.lit(1)).withColumn("RANK", F.lit(2)).withColumn("best", F.lit("x"))
    got = topk.top_k(df, 5, dim=2).collect()
    assert {(r.vec_id, r["rank"], r.neighbor_id) for r in got} == {(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 2), (3, 2, 1)}
    assert topk.top_k(df.limit(0), 5, dim=2).count() == 0
    assert topk.top_k(df.where("vec_id = 1"), 5, dim=2).count() == 0
