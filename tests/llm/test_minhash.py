from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.support import docs_frame, prose, words
from weftgraph.llm import minhash


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def edit(rng, text, rate):
    return " ".join("new" + str(rng.randrange(10**6)) if rng.random() < rate else x for x in text.split())


def fixture(seed=2):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(80):
        base = " ".join(prose(rng, rng.randrange(60, 400)))
        for rate in [0, *rng.choices([0, 0.01, 0.03, 0.05], k=rng.randrange(0, 4))]:
            rows.append((n, edit(rng, base, rate)))
            n += 1
    passage = " ".join(prose(rng, 60))
    rows += [(n + k, passage + " " + " ".join(prose(rng, 200))) for k in range(20)]
    rng.shuffle(rows)
    return rows


def test_recall_and_precision_against_brute_force(spark):
    rows = fixture()
    sets = {i: shingles(t) for i, t in rows}
    near = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b]}
    root = {r.doc_id: r.kept_doc_id for r in minhash.near_duplicates(docs_frame(spark, rows)).collect()}
    group = lambda i: root.get(i, i)
    sure = [p for p, j in near.items() if j >= 0.48]
    assert sum(group(a) == group(b) for a, b in sure) >= 0.9 * len(sure)
    # whoever is dropped has a near duplicate, and none of another family
    for i, kept in root.items():
        assert kept < i and kept not in root
        assert max(j for p, j in near.items() if i in p) >= 0.35
    far = [p for p, j in near.items() if j < 0.3]
    assert not any(group(a) == group(b) for a, b in far)


def test_densified_signatures_estimate_similarity():
    rng = random.Random(4)
    base = " ".join(prose(rng, 300))
    texts = [base, edit(rng, base, 0.05), " ".join(prose(rng, 300)), "one", "", None]
    best, n = minhash.signatures(pa.array(texts))
    assert list(n > 0) == [True] * 4 + [False] * 2
    assert (best[:4] != minhash._EMPTY).all()
    a, b = shingles(texts[0]), shingles(texts[1])
    assert abs((best[0] == best[1]).mean() - len(a & b) / len(a | b)) < 0.12
    assert (best[0] == best[2]).mean() < 0.1
    assert len(np.unique(best[3])) == 1


def test_mixed_bucket_is_starred_until_no_pair_is_left(spark):
    """Families that meet in a bucket by way of a shared passage all find their own partners."""
    rng = random.Random(8)
    passage = prose(rng, 30)
    rows = []
    for f in range(12):
        own = prose(rng, 40)
        rows += [(f * 3 + k, " ".join(passage + own + ([f"tail{k}"] if k else []))) for k in range(3)]
    for block in (minhash.BLOCK, 3):
        root = {r.doc_id: r.kept_doc_id for r in minhash.near_duplicates(docs_frame(spark, rows), least=0.8, block=block).collect()}
        assert root == {f * 3 + k: f * 3 for f in range(12) for k in (1, 2)}


def test_recall_from_the_threshold_up():
    """A pair whose bins pass has a common band."""
    rng = random.Random(11)
    hits, all_ = 0, 0
    for _ in range(40):
        base = " ".join(prose(rng, 300))
        texts = [base, *(edit(rng, base, 0.12) for _ in range(8))]
        best, _ = minhash.signatures(pa.array(texts))
        for k in range(1, 9):
            same = best[0] == best[k]
            if same.mean() >= 0.45:
                all_ += 1
                hits += same.reshape(minhash.BANDS, minhash.ROWS).all(1).any()
    assert all_ > 40 and hits >= 0.95 * all_


def test_a_bucket_that_most_rows_share(spark):
    """Copies, and texts that only share a passage, in many more rows than a task may hold of a bucket."""
    rng = random.Random(12)
    passage, copy = " ".join(prose(rng, 150)), " ".join(prose(rng, 200))
    rows = [(i, copy) for i in range(300)] + [(1000 + i, passage + " " + " ".join(prose(rng, 300))) for i in range(150)] + [(2000, rows_of := passage + " end"), (2001, rows_of + " here")]
    root = {r.doc_id: r.kept_doc_id for r in minhash.near_duplicates(docs_frame(spark, rows), block=16).collect()}
    assert {i: r for i, r in root.items() if i < 1000} == {i: 0 for i in range(1, 300)}
    assert root.get(2001) == root.get(2000, 2000)


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5001), (5001, 5002), (5002, 5000), (7, 7)]
    rng.shuffle(edges)
    got = {r.id: r.root for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + k: 1000 for k in range(1, 200)} | {5001: 5000, 5002: 5000}


def test_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, "same text here now"), (2, "Same, text here NOW!"), (2, "Same, text here NOW!"), (None, "same text here now"), (3, None), (4, ""), (5, "..."), (6, "hi"), (7, "hi"), (8, long), (9, long + " end")]
    docs = docs_frame(spark, rows, id=F.lit(3), sig=F.lit("s"), ROOT=F.lit(1))
    assert {(r.doc_id, r.kept_doc_id) for r in minhash.near_duplicates(docs).collect()} == {(2, 1), (7, 6), (9, 8)}
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "3", "4", "5", "6", "8", "None"]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
