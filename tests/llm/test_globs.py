from __future__ import annotations

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import globs


def regex(glob):
    return re.compile("".join(".*" if s == "" else "." if s is None else re.escape(s) for s in globs.parse_glob(glob)), re.S)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab*?é/[]", max_size=90), max_size=12), st.lists(st.text("abcé/*[", max_size=30), max_size=12))
def test_automaton_equals_regular_expressions(patterns, strings):
    found = globs.Automaton(patterns).run(strings)
    for row, s in zip(found, strings, strict=True):
        assert list(row) == [bool(regex(p).fullmatch(s)) for p in patterns]


def test_words_carry_and_long_strings():
    rng = random.Random(1)
    patterns = ["".join(rng.choices("abc?*", [5, 5, 5, 1, 1], k=rng.randrange(1, 150))) for _ in range(40)]
    strings = [re.sub(r"[*]", lambda m: "ab" * rng.randrange(4), p).replace("?", "b") for p in patterns] + ["", "a" * 20_000]
    found = globs.Automaton(patterns).run(strings)
    for row, s in zip(found, strings, strict=True):
        assert list(row) == [bool(regex(p).fullmatch(s)) for p in patterns]
    assert found[:40].any(1).all()


def test_canonical(spark):
    cases = {
        "HTTP://WWW.Ex.COM:80": "http://www.ex.com/",
        "https://a.b:443//x///Y?utm_source=f&q=1#top": "https://a.b/x/Y?q=1",
        "https://a.b/x?q=1&utm_medium=z": "https://a.b/x?q=1",
        "https://a.b/x?utm_a=1&utm_b=2&c=3&utm_d=4&utm_e=5": "https://a.b/x?c=3",
        "https://a.b/x?my_utm_source=a&b=1&autm_x=2": "https://a.b/x?my_utm_source=a&b=1&autm_x=2",
        "https://a.b/x?utm_a=1": "https://a.b/x",
        "https://a.b/?": "https://a.b/",
        " Mailto:X@y ": "mailto:x@y",
        "": "",
    }
    df = spark.createDataFrame(list(cases.items()), "u string, want string")
    assert df.where(globs.canonical(F.col("u")) != F.col("want")).collect() == []


def test_edge_cases(spark):
    rules = [(1, "deny", "*://a.b/*"), (7, "allow", "*/ok*"), (3, "deny", "")]
    rows = [(1, "https://a.b/ok", "x"), (1, "https://a.b/ok", "x"), (None, "https://a.b/no", "x"), (2, None, None), (3, "", None), (4, "https://c.d/" + "k" * 50_000, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("Verdict", F.lit("?")).withColumn("rules", F.lit(1))
    got = sorted(((r.page_id, r.verdict, r.n_rules, r.rules) for r in globs.filter_urls(pages, rules).collect()), key=str)
    assert got == sorted([(1, "allow", 2, "1,7"), (1, "allow", 2, "1,7"), (None, "deny", 1, "1"), (2, None, 0, ""), (3, "deny", 1, "3"), (4, "none", 0, "")], key=str)
    assert {r.verdict for r in globs.filter_urls(pages, []).collect()} == {"none", None}
    assert globs.filter_urls(pages.limit(0), rules).count() == 0
