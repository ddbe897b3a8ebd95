from __future__ import annotations

import math
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.support import docs_frame, prose
from weftgraph.llm import toxicity

BAD = ["scum", "moron", "idiot", "trash", "worthless"]


def fixture(n=1500, seed=1):
    rng = random.Random(seed)
    rows, toxic = [], {}
    for i in range(n):
        w = prose(rng, rng.randrange(10, 200), 800)
        if i % 7 == 0:
            toxic[i] = 1
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(w))
                w[at:at] = [rng.choice(["you", "the"]), rng.choice([*BAD, "grumpf" + w[0]])]
        else:
            toxic[i] = 0
        rows.append((i, " ".join(w)))
    return rows, toxic


@pytest.fixture(scope="module")
def data():
    return fixture()


def labels(spark, toxic):
    return spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, data):
    rows, toxic = data
    known = {i: t for i, t in toxic.items() if i % 5}
    got = {r.doc_id: r for r in toxicity.score(docs_frame(spark, rows), labels(spark, known)).collect()}
    assert set(got) == set(toxic)
    held = [i for i in toxic if i % 5 == 0]
    hit = sum(got[i].toxic for i in held if toxic[i]) / sum(toxic[i] for i in held)
    wrong = sum(got[i].toxic for i in held if not toxic[i]) / len(held)
    assert hit >= 0.95 and wrong <= 0.01
    p = np.array([got[i].toxicity for i in held])
    y = np.array([toxic[i] for i in held])
    assert ((p - y) ** 2).mean() < 0.03 and ((p >= 0) & (p <= 1)).all()


def test_disguises_are_undone():
    assert toxicity.terms("St*pid!") == ("st*pid", "stpid")
    assert toxicity.terms("1d10t") == ("1d10t", "idiot")
    assert toxicity.terms("sc.u.m") == ("sc.u.m", "scum")
    assert toxicity.terms("idiooot") == ("idiooot", "idiot")
    assert toxicity.terms("Word,") == ("word", "")


def test_near_and_rates():
    lexicon = toxicity.Lexicon.of({"scum": 5.0, "grum*": 3.0})
    x = dict(zip(toxicity.FEATURES, toxicity.dense(pa.array(["YOU are all SCUM! a b c d e f g h grumble"]), lexicon)[0], strict=True))
    assert x["strong_any"] == 2 and x["near_any"] == 1 and x["most_weight"] == 5 and x["top_two"] == 8
    assert x["shout_share"] == 2 / 13 and x["bang_rate"] == 1 / 41 and x["upper_rate"] == 7 / 41
    assert not toxicity.dense(pa.array([None, "", "  "]), lexicon)[:, :10].any()


def plain_features(text, weights):
    """``dense`` of one text, token by token."""
    raw = (text or "").encode()
    out = dict.fromkeys(toxicity.FEATURES, 0.0)
    size = max(len(raw), 1)
    out["upper_rate"] = sum(65 <= c <= 90 for c in raw) / size
    out["punct_rate"] = sum(33 <= c <= 126 and not chr(c).isalnum() for c in raw) / size
    out["bang_rate"] = sum(c in b"!?" for c in raw) / size
    out["digit_rate"] = sum(48 <= c <= 57 for c in raw) / size
    tokens = re.split(r"[\t-\r\x1c-\x20]+", text or "")
    tokens = [t for t in tokens if t]

    def weight(word):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in word).encode()
        return max([weights.get(w.decode(), 0), *(weights.get(w[:k].decode("utf-8", "ignore") + "*", 0) for k in range(4, min(8, len(w))))])

    rows = []
    for t in tokens:
        word = re.sub(r"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f\x80-\xbf\u2000-\u207f]+|[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f\x80-\xbf\u2000-\u207f]+$", "", t)
        hidden = toxicity.terms(t)[1] if word else ""
        rows.append((max(weight(word) if word else 0, weight(hidden) if hidden else 0), word.lower() in toxicity.SECOND_PERSON, bool(hidden) and not word.isdigit(), len(word.encode()) > 2 and t.isupper()))
    n = max(len(rows), 1)
    top = sorted((r[0] for r in rows), reverse=True)
    strong = [i for i, r in enumerate(rows) if r[0] >= toxicity.STRONG]
    near = sum(any(rows[j][1] for j in range(max(0, i - toxicity.NEAR), min(len(rows), i + toxicity.NEAR + 1))) for i in strong)
    out |= {
        "log_words": math.log1p(len(rows)), "strong_share": len(strong) / n, "weight_share": sum(top) / n, "most_weight": (top or [0])[0], "strong_any": len(strong), "near_share": near / n, "near_any": near,
        "hidden_share": sum(r[2] for r in rows) / n, "hidden_strong": sum(rows[i][2] for i in strong), "shout_share": sum(r[3] for r in rows) / n, "top_two": sum(top[:2]),
    }
    return [out[f] for f in toxicity.FEATURES]


def test_features_equal_a_plain_reading():
    rng = random.Random(9)
    pieces = ["you", "YOU!", "tú", "scum", "SCUM,", "sc.u.m", "m0ron", "idiooot", "grumble", "Grumpy.", "(grum)", "Ça", "ÉTÉ", "été", "1000", "b2b", "a-b", "don't", "“scum”", "«été»", "!!!", "...", "é", "的的的", "x", "ääään", "_scum_"]
    weights = {"scum": 5.0, "moron": 4.0, "idiot": 3.0, "grum*": 2.0, "été": 1.5, "grumb*": 2.6}
    texts = [rng.choice([" ", "\n", "\t "]).join(rng.choices(pieces, k=rng.randrange(0, 40))) for _ in range(300)] + [None, "", "  ", "!!!"]
    got = toxicity.dense(pa.array(texts), toxicity.Lexicon.of(weights))
    for x, t in zip(got, texts, strict=True):
        assert np.allclose(x, plain_features(t, weights)), (t, dict(zip(toxicity.FEATURES, zip(x, plain_features(t, weights), strict=True), strict=True)))


def test_one_tree_splits_where_a_plain_search_does():
    rng = np.random.default_rng(5)
    x, w = rng.random((400, 3)), rng.random(400) + 0.5
    y = (x[:, 1] + 0.3 * rng.random(400) > 0.6).astype(float)
    model = toxicity.Trees(n_trees=1, depth=1, rate=1.0).fit(x, y, w)
    p = np.average(y, weights=w)
    g, h = w * (y - p), w * p * (1 - p)
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = max((gain(x[:, f] <= c) + gain(x[:, f] > c), f, c) for f in range(3) for c in model.cuts[f])
    assert (model.feature[0, 0], model.cut[0, 0]) == best[1:]
    right = x[:, best[1]] > best[2]
    want = np.log(p / (1 - p)) + np.where(right, g[right].sum() / (h[right].sum() + 1), g[~right].sum() / (h[~right].sum() + 1))
    assert np.allclose(model.score(x), want)


def test_rare_toxic_labels_are_all_drawn(spark, data):
    rows, toxic = data
    few = dict([(i, t) for i, t in toxic.items() if t][:12] + [(i, t) for i, t in toxic.items() if not t])
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs_frame(spark, rows), labels(spark, few), sample=200).collect()}
    assert None not in got.values()
    assert np.mean([got[i] for i in toxic if toxic[i]]) > np.mean([got[i] for i in toxic if not toxic[i]])


def test_memory_is_bounded_by_a_piece_not_by_the_batch():
    """A batch of 6 MB, as Spark sends them, through the passes over texts."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 10))) + rng.choice(["", "", ","]) for _ in range(2000)]
    texts = pa.array([" ".join(rng.choices(vocabulary, k=450)) for _ in range(2000)] + [None, ""])
    x = np.zeros((20, len(toxicity.FEATURES)))
    x[10:, 0] = 1
    model = toxicity.Model(toxicity.Lexicon.of({vocabulary[0]: 3.0}), toxicity.Trees(n_trees=2).fit(x, x[:, 0]), np.array([-1.0, 1.0]), np.array([0.1, 0.9]))
    model(texts.slice(0, 300))  # tables of powers are made once
    counted = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts)) % 2), texts], names=["toxic", "text"])
    for work in (lambda: model(texts), lambda: list(toxicity._term_counts(iter([counted])))):
        tracemalloc.start()
        got = work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 80e6, most
        assert len(got) == len(texts) or sum(b.num_rows for b in got)
    whole = toxicity.dense(texts, model.lexicon)
    assert (model(texts) == np.where(whole[:, 0] > 0, np.interp(model.trees.score(whole), model.at, model.prob), 0.0)).all()


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = toxicity.Trees().fit(x[:2000], y[:2000])
    assert (((model.score(x[2000:]) > 0) == y[2000:]).mean()) > 0.97


def test_isotonic_equals_brute_force():
    rng = np.random.default_rng(1)
    s = rng.permutation(40).astype(float)
    y = (rng.random(40) < s / 40).astype(float)
    at, p = toxicity.isotonic(s, y)
    o = np.argsort(s)
    z = y[o]
    want = [max(min(z[i : j + 1].mean() for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    assert np.allclose(np.interp(s[o], at, p), want)


def test_edge_cases(spark, data):
    rows, toxic = data
    docs = docs_frame(spark, [*rows, (None, "you worthless scum idiot"), (9001, None), (9002, ""), (9003, "x" * 100_000), (9004, "you moron " * 30_000), (9004, "fine words only")], toxic=F.lit("t"), fold=F.lit(1), X=F.lit(2))
    known = labels(spark, toxic).union(spark.createDataFrame([(None, 1, 1), (3, 0, None), (1, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int"))
    began = time.time()
    got = toxicity.score(docs, known).collect()
    assert time.time() - began < 120 and len(got) == len(rows) + 6
    by = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id in (9001, 9002)}
    assert by[None].toxic and by[9001].toxicity == 0 == by[9002].toxicity
    left = toxicity.drop_toxic(docs, known)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert {9001, 9002} <= set(ids) and None not in ids and ids.count(9004) == 1
    assert len(ids) >= len([t for t in toxic.values() if not t]) * 0.99
    for few in (known.limit(0), known.where("toxic = 0")):
        assert toxicity.drop_toxic(docs, few).count() == len(rows) + 6
        assert toxicity.score(docs, few).where("toxic OR toxicity IS NOT NULL").isEmpty()
    assert toxicity.score(docs.limit(0), known).count() == 0
