from __future__ import annotations

import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.support import docs_frame, prose
from weftgraph.llm import pst

START = "^"


def brute_parts(texts):
    return [[x for x in re.findall("[0-9A-Za-z\u0080-\U0010ffff]+|[^0-9A-Za-z\u0080-\U0010ffff]+", t or "") if x != " "] for t in texts]


def brute_symbols(texts, most=10**9, learnt=None):
    """Symbols of each text by a regular expression and plain counts; rare words are lists of bytes."""
    count = {x: n for x, n in Counter(x for p in brute_parts(texts if learnt is None else learnt) for x in p).items() if n > 1}
    level = {x: math.floor(math.log2(n) * 64) for x, n in count.items()}
    least = min((v for v in level.values() if sum(w >= v for w in level.values()) <= most), default=math.inf)
    known = {x for x, v in level.items() if v >= least}
    return [[s for x in p for s in ([x] if x in known else [(k > 0, b) for k, b in enumerate(x.encode())])] for p in brute_parts(texts)]


def brute_bits(train, texts, critical, least, weight):
    """Bits of every symbol of ``texts`` under the tree of ``train``, by dictionaries over all contexts there are."""
    follow: dict[tuple, Counter] = defaultdict(Counter)
    for s in train:
        for i, c in enumerate(s):
            ctx = [START, *s[:i]][::-1]
            for d in range(len(ctx) + 1):
                follow[tuple(ctx[:d])][c] += 1
    n0 = sum(follow[()].values())
    out = []
    for s in texts:
        bits = []
        for i, c in enumerate(s):
            ctx = [START, *s[:i]][::-1]
            p = {x: (follow[()][x] + 1) / (n0 + pst.SIZE) for x in {*follow[()], c}}
            for d in range(1, len(ctx) + 1):
                f = follow.get(tuple(ctx[:d]))
                if not f:
                    break
                n = sum(f.values())
                factor = math.lgamma(weight) - math.lgamma(weight + n)
                factor += sum(math.lgamma(weight * p[x] + k) - math.lgamma(weight * p[x]) - k * math.log(p[x]) for x, k in f.items())
                if n >= least and factor >= critical:
                    p = {x: (f[x] + weight * v) / (n + weight) for x, v in p.items()}
            bits.append(-math.log2(p[c]))
        out.append(sum(bits) / len(bits) if bits else None)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    syllables = ["the", "on", "ti", "éa", "ing", "Über", "7"]
    made = [" ".join("".join(rng.choices(syllables, [9, 5, 4, 1, 3, 1, 1], k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 60))) + "." for _ in range(60)]
    line = "one line that many texts have in the midst of them and that goes on and on. "
    made += [made[0], made[1], made[2] + " " + made[3]] + [line + w + " " + line + "end " + v for w, v in zip("abcabcabdeab", "xyxyxyzzxxyy", strict=True)]
    made += ["%%% " * 30, "的是不了人 我在有他这", "的是不了人 我在有他这。", "a  b\n\nc", "word"]
    return made


@pytest.mark.parametrize("how", [{"words": 40, "most": 20}, {"least": 5, "weight": 0.5, "critical": 3.0}])
def test_equals_brute_force(spark, texts, how):
    """Whatever the alphabet is, and whether contexts go on symbol by symbol or by spans."""
    sym = brute_symbols(texts, how.get("words", pst.SIZE - pst.WORD))
    want = brute_bits(sym, sym, how.get("critical", 5.0), how.get("least", 2), how.get("weight", 1.0))
    got = {r.doc_id: r for r in pst.score(docs_frame(spark, list(enumerate(texts))).repartition(3), **how).collect()}
    for i, s in enumerate(sym):
        assert got[i].n_symbols == len(s)
        assert got[i].bits_per_symbol == pytest.approx(want[i], abs=1e-3)


def test_states_are_as_long_as_the_test_keeps_them(spark, monkeypatch):
    """A word that depends on one 30 before, with equal text between; records that carry few symbols give the same."""
    rng = random.Random(4)
    between = " ".join(f"same{k}" for k in range(30))
    texts = [f"{k} {between} {k * 2}" for k in rng.choices("xyz", k=60)]
    sym = brute_symbols(texts)
    want = brute_bits(sym, sym, 5.0, 2, 1.0)
    for longest in (pst.LONGEST, pst.SPAN):
        monkeypatch.setattr(pst, "LONGEST", longest)
        got = {r.doc_id: r.bits_per_symbol for r in pst.score(docs_frame(spark, list(enumerate(texts)))).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-3)


def test_held_out_text_is_scored_by_the_other_corpus(spark, texts):
    train, held = texts[:50], [*texts[50:60], "xqj zzv kkw " * 5]
    want = brute_bits(brute_symbols(train), brute_symbols(held, learnt=train), 5.0, 2, 1.0)
    got = {r.doc_id: r.bits_per_symbol for r in pst.score(docs_frame(spark, list(enumerate(held))), docs_frame(spark, list(enumerate(train)))).collect()}
    assert [got[i] for i in range(len(held))] == pytest.approx(want, abs=1e-3)
    assert got[10] > 1.3 * np.mean([got[i] for i in range(10)])


def test_texts_that_occur_twice_are_told_apart(spark):
    rng = random.Random(7)
    once = [" ".join(prose(rng, 120)) for _ in range(200)]
    got = {r.doc_id: r.bits_per_symbol for r in pst.score(docs_frame(spark, list(enumerate(once + once[:20])))).collect()}
    assert max(got[i] for i in range(20)) < min(got[i] for i in range(20, 200))


def test_packed_arrays_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        a, b = rng.integers(0, 1 << 60, n), rng.random(n).astype(np.float32)
        x, y = pst.unpack(pst.pack(a, b), np.int64, np.float32)
        assert (x == a).all() and (y == b).all()


def test_symbols_lose_nothing_but_single_spaces():
    text = "Ça  va? 123 的, x\ty "
    known = np.sort(pst.segments(pa.array(["va x"]))[4])
    s, n = pst.symbols(pa.array([text, None, ""]), known, np.array([1, 0], np.int32))
    assert list(n) == [len(s) - 3, 0, 0] and sorted(s[s >= pst.WORD]) == [pst.WORD, pst.WORD + 1]
    spelled = bytes((int(x) - (pst.FIRST if x >= pst.FIRST else pst.BYTE)) for x in s if pst.START < x < pst.WORD)
    assert spelled == "".join(x for x in brute_parts([text])[0] if x not in ("va", "x")).encode()


def test_edge_cases(spark):
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, "x"), (None, "abc"), (4, "abc"), (4, "abc"), (5, " ".join(prose(rng, 40_000))), (6, " "), (7, "😀".encode("utf-16", "surrogatepass").decode("utf-16"))]
    got = pst.score(docs_frame(spark, rows, gram=F.lit(1), N=F.lit(2), Block=F.lit(3), left=F.lit(4))).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_symbols): r.bits_per_symbol for r in got}
    assert by[1, 0] is None and by[2, 0] is None and by[6, 0] is None and by[3, 1] > 0 and by[None, 1] == by[4, 1] and by[7, 1] > 0
    docs = docs_frame(spark, rows)
    assert pst.score(docs.limit(0)).count() == 0
    assert pst.score(docs.where("doc_id = 2")).first().bits_per_symbol is None
    assert pst.score(docs.where("doc_id = 3"), docs.limit(0)).count() == 1


def test_a_full_bucket_fits_beside_another_task():
    """A bucket with the largest context that one task may hold, and as many other records as it is meant to have."""
    rng = np.random.default_rng(5)
    n = pst.MOST + pst.BUCKET
    older = [rng.zipf(1.3, n).clip(max=50_000).astype(np.int32) + pst.WORD for _ in range(pst.SPAN)]
    older[0][: pst.MOST] = pst.WORD
    after, p = rng.integers(pst.WORD, pst.WORD + 50_000, n).astype(np.int32), np.full(n, 1e-4, np.float32)
    tracemalloc.start()
    got, left = pst.answers(np.zeros(n, np.uint64), older, after, p, np.ones(n, np.uint32), 5.0, 2, 1.0)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert len(got) == len(left) == n and (got != p).any() and peak < 450


def test_rounds_with_little_left_move_blocks_once(spark, monkeypatch):
    """A line that many texts share stays open for many rounds; only those in which much is open join blocks a second time."""
    rounds, joins, answered, updated = [], [], pst._answered, pst._updated
    monkeypatch.setattr(pst, "_answered", lambda blocks, places, *more: (rounds.append(more[1]), answered(blocks, places, *more))[1])
    monkeypatch.setattr(pst, "_updated", lambda *those: (joins.append(1), updated(*those))[1])
    monkeypatch.setattr(pst, "LONGEST", pst.SPAN)
    rng = random.Random(6)
    between = " ".join(f"same{k}" for k in range(40))
    texts = [f"{k} {between} {k * 2}" for k in rng.choices("xyz", k=60)]
    sym = brute_symbols(texts)
    got = {r.doc_id: r.bits_per_symbol for r in pst.score(docs_frame(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(brute_bits(sym, sym, 5.0, 2, 1.0), abs=1e-3)
    assert len(rounds) - pst.PARTS > 5 and len(joins) <= 2


def test_contexts_of_a_common_symbol_take_no_round_of_their_own(spark, monkeypatch):
    """A word that occurs more often than a task may hold, as texts' starts do: its longer contexts are sent in the first round like all others."""
    rounds, answered = [], pst._answered
    monkeypatch.setattr(pst, "_answered", lambda blocks, places, *more: (rounds.append(more[1]), answered(blocks, places, *more))[1])
    rng = random.Random(8)
    texts = [" ".join("the" if k % 3 == 2 else f"w{rng.randrange(400)}" for k in range(30)) for _ in range(120)]
    sym = brute_symbols(texts)
    got = {r.doc_id: r.bits_per_symbol for r in pst.score(docs_frame(spark, list(enumerate(texts))).repartition(2), most=100).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(brute_bits(sym, sym, 5.0, 2, 1.0), abs=1e-3)
    assert len(rounds) == pst.PARTS
