from __future__ import annotations

import keyword
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from weftgraph.functions import lines
from weftgraph.operators import clones


def counted(text: str) -> tuple[int, int, int, int]:
    """(loc, sloc, comments, blank) of a C-like source by walking its characters."""
    rows = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    rows = [] if text == "" else rows[:-1] if rows[-1] == "" else rows
    inside, out = False, [0, 0, 0]
    for row in rows:
        code = comment = False
        i = 0
        while i < len(row):
            two = row[i : i + 2]
            if inside:
                comment = True
                inside, i = (False, i + 2) if two == "*/" else (True, i + 1)
            elif two == "//":
                comment = True
                break
            elif two == "/*":
                inside = comment = True
                i += 2
            else:
                code |= not row[i].isspace()
                i += 1
        out[2 if not row.strip() else 0 if code else 1] += 1
    return len(rows), *out


def test_c_style_metrics_equal_a_character_walk(spark):
    rng = random.Random(8)
    bits = ["x = 1;", "//", "/*", "*/", "\n", "\n", " ", "\t", "/", "*", "// c", "a/b", "\r\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 25))) for _ in range(300)] + ["", "\n", "/*", "/**/", "/*/ x", "a\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    for r in df.select("i", lines.c_style_metrics("t").alias("m")).collect():
        assert (r.m.loc, r.m.sloc, r.m.comment_lines, r.m.blank_lines) == (counted(texts[r.i]) if r.i < len(texts) else (0, 0, 0, 0)), repr(texts[r.i])


def normal(s: str) -> str:
    s = " ".join(re.sub("#.*$", "", s).split())
    kept = lines.KEYWORDS
    return re.sub(r"\b[^\W\d]\w*\b", lambda m: m[0] if m[0] in kept else "ID", s)


def test_clones_equal_brute_force(spark):
    rng = random.Random(9)
    pool = ["a = f(b)  # x", "return a", "", "   ", "if a is None:", "for x in y:", "import os", "z = 12", "# only a comment"]
    files = {f"f{i}": "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14))) for i in range(12)} | {"none": None}
    df = spark.createDataFrame(list(files.items()), "file string, text string")
    for k, within in ((2, False), (3, True)):
        want = defaultdict(list)
        for f, t in files.items():
            rows = [(i, n) for i, s in enumerate((t or "").split("\n"), 1) if (n := normal(s))]
            for j in range(len(rows) - k + 1):
                want["\n".join(n for _, n in rows[j : j + k])].append((f, rows[j][0]))
        want = {w: m for w, m in want.items() if len(m) >= 2 and (within or len({f for f, _ in m}) >= 2)}
        wins = clones.windows(df, k)
        got = clones.groups(wins, k, within_file=within, most=10_000)
        found = got.collect()
        assert sorted((r.members, r.files) for r in found) == sorted((len(m), len({f for f, _ in m})) for m in want.values())
        assert all(r.severity == k * (r.files - 1) for r in found)
        assert clones.members(wins, got, k).count() == sum(map(len, want.values()))


def test_fallback_only_if_nothing_is_found(spark):
    df = spark.createDataFrame([("a", "x = 1\ny = 2\nz = 3\nq()\nx = 1\ny = 2\nz = 3"), ("b", "pass")], "file string, text string")
    g, m, fallback = clones.report(df, k=5, idents=False)
    assert fallback and [r.members for r in g.collect()] == [2] and m.count() == 2
    assert clones.report(df.limit(0), k=5)[0].count() == 0


def test_keywords_are_keywords():
    assert all(keyword.iskeyword(k) for k in lines.KEYWORDS)


def test_lines_of_odd_texts(spark):
    df = spark.createDataFrame([("a\r\nb\rc\n",), ("",), (None,), ("\n",)], "t string")
    assert [r.n for r in df.select(F.size(lines.lines("t")).alias("n")).collect()] == [3, 0, 0, 1]
