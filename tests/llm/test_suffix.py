from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.support import docs_frame, prose, words
from weftgraph.llm import suffix, textvec


def brute(rows, size=suffix.WINDOW):
    """{(doc, window start): is_first} of all windows that occur more than once."""
    seen: dict[tuple, list] = {}
    for i, text in sorted(rows):
        w = words(text)
        for s in range(len(w) - size + 1):
            seen.setdefault(tuple(w[s : s + size]), []).append((i, s))
    return {p: k == 0 for places in seen.values() if len(places) > 1 for k, p in enumerate(places)}


def fixture(seed=3):
    rng = random.Random(seed)
    shared = [prose(rng, n) for n in (50, 51, 60, 75, 120, 49)]
    rows = []
    for i in range(60):
        w = prose(rng, rng.randrange(0, 200))
        for p in rng.sample(shared, rng.randrange(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        rows.append((i, " ".join(w)))
    rows += [(60 + k, rows[k][1]) for k in range(5)]  # exact copies
    edited = rows[7][1].split()
    for k in range(20, len(edited), 70):
        edited[k] = "changed"
    rows += [(70, " ".join(edited)), (71, "la " * 130), (72, "la " * 60 + "end"), (73, ""), (74, "one two")]
    return rows


def windows(found):
    out = {}
    for doc, s, e, first in found:
        for k in range(s, e - suffix.WINDOW + 1):
            out.setdefault((doc, k), set()).add(first)
    return out


def test_matches_brute_force(spark):
    rows = fixture()
    found = suffix.repeated_passages(docs_frame(spark, rows)).collect()
    got, want = windows(found), brute(rows)
    assert set(got) >= set(want)
    for place, first in want.items():
        assert first in got[place]
    # united spans hold no word beyond those of the windows of their kind
    for kind in (True, False):
        cover = {(d, k + j) for (d, k), f in want.items() if f == kind for j in range(suffix.WINDOW)}
        assert cover == {(d, k) for d, s, e, f in found if f == kind for k in range(s, e)}


def test_repeats_within_the_only_run_of_an_anchor(spark):
    rng = random.Random(8)
    lone, twins, rare = (prose(rng, n) for n in (7, 23, 41))
    rows = [(1, " ".join(lone * 20)), (2, " ".join(twins * 8)), (3, " ".join(twins * 8)), (4, " ".join(prose(rng, 90) + rare * 4 + prose(rng, 60))), (5, " ".join(prose(rng, 300)))]
    want = brute(rows)
    assert {d for d, _ in want} == {1, 2, 3, 4} and all(any(d == i and not f for (d, _), f in want.items()) for i in (1, 2, 4))
    found = suffix.repeated_passages(docs_frame(spark, rows)).collect()
    for kind in (True, False):
        cover = {(d, k + j) for (d, k), f in want.items() if f == kind for j in range(suffix.WINDOW)}
        assert cover == {(d, k) for d, s, e, f in found if f == kind for k in range(s, e)}


def test_cut_text_and_columns(spark):
    rows = fixture(5)
    docs = docs_frame(spark, rows, extra=F.lit(1), th=F.lit("x"), S=F.lit(2))
    got = suffix.drop_repeats(docs)
    assert got.columns == docs.columns
    got = {r.doc_id: r for r in got.collect()}
    want = brute(rows)
    for i, text in rows:
        w = words(text)
        gone = {k + j for (d, k), first in want.items() if d == i and not first for j in range(suffix.WINDOW)}
        assert words(got[i].text) == [x for k, x in enumerate(w) if k not in gone]
        if not gone:
            assert got[i].text == text
        assert got[i].n_chars == len(got[i].text)


def test_cut_keeps_the_rest_verbatim():
    text = "Eins, zwei; drei.\nVier – fünf! Sechs?"
    assert suffix.cut_text(text, [(1, 3)]) == "Eins, Vier – fünf! Sechs?"


def test_repeated_rows_nulls_and_empty_tables(spark):
    rng = random.Random(1)
    passage = " ".join(prose(rng, 80))
    rows = [(1, passage), (1, passage), (None, passage), (3, None), (4, ""), (5, "x " + passage), (5, passage + " y")]
    docs = docs_frame(spark, rows)
    got = sorted((r.doc_id, r.start_word, r.end_word, r.is_first) for r in suffix.repeated_passages(docs).collect())
    assert set(got) == {(1, 0, 80, True), (5, 1, 81, False), (5, 0, 80, False)}
    left = sorted(suffix.drop_repeats(docs).collect(), key=str)
    assert len(left) == len(rows)
    assert sum(r.text == passage for r in left) == 3
    assert suffix.repeated_passages(docs.limit(0)).count() == 0
    assert suffix.drop_repeats(docs.limit(0)).count() == 0


def test_merging_equals_one_sort():
    """Merged shards give the intervals of 50-word windows that sorting all windows gives, whatever the shards."""
    rng = random.Random(9)
    rows = [t for _, t in fixture(9) if len(t.split()) >= 50]
    rng.shuffle(rows)
    w = textvec.words(pa.array(rows))
    runs = [w.hash[i:j] for i, j in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    n = np.array([len(r) - 49 for r in runs])
    seen: dict[bytes, list] = {}
    for i, r in enumerate(runs):
        for s in range(n[i]):
            seen.setdefault(r[s : s + 50].tobytes(), []).append((i, s))
    want = {(i, s, k == 0) for places in seen.values() if len(places) > 1 for k, (i, s) in enumerate(places)}
    for shard_words in (1, 300, 5000, 1 << 20):
        got = suffix.repeats(runs, n, shard_words)
        assert {(int(a), int(b), bool(c)) for a, b, c in zip(*got, strict=True)} == want
