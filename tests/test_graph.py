from __future__ import annotations

import random
from collections import deque

import pytest

from weftgraph.operators import graph


def frame(spark, pairs, schema="src string, dst string"):
    return spark.createDataFrame(pairs, schema)


def brute_reach(n, pairs):
    out = {i: {i} for i in range(n)}
    nxt = {i: {b for a, b in pairs if a == i} for i in range(n)}
    for i in range(n):
        q = deque([i])
        while q:
            for y in nxt[q.popleft()] - out[i]:
                out[i].add(y)
                q.append(y)
    return out


@pytest.mark.parametrize("group", [graph.GROUP, 6, 0])
@pytest.mark.parametrize("seed,n,m", [(1, 12, 18), (2, 25, 30)])
def test_scc_equals_mutual_reach(spark, group, seed, n, m):
    rng = random.Random(seed)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    reach = brute_reach(n, pairs)
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(n)], "id string")
    got = {r.id: (r.scc_id, r.scc_size) for r in graph.scc(nodes, frame(spark, [(f"n{a}", f"n{b}") for a, b in pairs]), group=group).collect()}
    for i in range(n):
        mates = [f"n{j}" for j in range(n) if j in reach[i] and i in reach[j]]
        assert got[f"n{i}"] == (min(mates), len(mates))


def test_weak_components(spark):
    rng = random.Random(3)
    n, pairs = 40, [(i, i + 1) for i in range(12)] + [(rng.randrange(13, 40), rng.randrange(13, 40)) for _ in range(18)]
    reach = brute_reach(n, pairs + [(b, a) for a, b in pairs])
    got = {r.id: r.c for r in graph.weak(frame(spark, pairs, "src long, dst long")).collect()}
    assert got == {i: min(reach[i]) for i in range(n) if len(reach[i]) > 1}


def test_violations_are_counted(spark):
    nodes, e = spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), frame(spark, [("a", "b"), ("b", "x"), ("y", "z")])
    wrong = spark.createDataFrame([("a", "a", 5), ("b", "b", 1)], "id string, scc_id string, scc_size long")
    assert {r.rule: r.n for r in graph.violations(nodes, e, wrong).collect()} == {"in_equals_out": 0, "scc_sizes_sum_to_nodes": 3, "no_dangling_edge": 3}


def test_scc_of_a_long_path_and_a_long_ring():
    n = 5000
    assert sorted(graph.components_of([[i + 1] if i + 1 < n else [] for i in range(n)])) == list(range(n))
    assert len(set(graph.components_of([[(i + 1) % n] for i in range(n)]))) == 1


@pytest.mark.parametrize("small", [graph.GROUP, 0])
@pytest.mark.parametrize("direction", ["forward", "backward", "both"])
def test_hops(spark, small, direction):
    rng = random.Random(5)
    pairs = {(rng.randrange(15), rng.randrange(15)) for _ in range(20)} | {(0, 1)}
    step = {"forward": pairs, "backward": {(b, a) for a, b in pairs}, "both": pairs | {(b, a) for a, b in pairs}}[direction]
    want, level = {0: 0}, [0]
    while level:
        level = sorted({b for a, b in step if a in level} - set(want))
        want |= {b: max(want.values()) + 1 for b in level}
    got = graph.hops(frame(spark, sorted(pairs), "src long, dst long"), spark.createDataFrame([(0,), (None,), (0,)], "id long"), direction=direction, small=small)
    assert {r.id: r.hops for r in got.collect()} == want
    cut = graph.hops(frame(spark, sorted(pairs), "src long, dst long"), spark.createDataFrame([(0,)], "id long"), direction=direction, most=1, small=small)
    assert {r.id: r.hops for r in cut.collect()} == {k: v for k, v in want.items() if v <= 1}


def test_type_checking_edges_inflate_cycles(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    rows = [("a", "b", False, None, None), ("b", "a", None, None, None), ("b", "c", None, "typing", None), ("c", "a", None, None, "TYPE_CHECKING block"), ("d", "d", None, None, None), ("c", "zz", None, None, None), ("", "a", None, None, None)]
    e = spark.createDataFrame(rows, "src string, dst string, type_checking boolean, subkind string, reason string")
    both, totals = graph.cycles(nodes, e)
    got = {r.id: (r.scc_id, r.scc_size, r.scc_size_runtime) for r in both.collect()}
    assert got == {"a": ("a", 3, 2), "b": ("a", 3, 2), "c": ("a", 3, 1), "d": ("d", 1, 1)}
    t = totals.first()
    assert (t.largest_scc_size, t.largest_scc_size_runtime, t.tc_inflation, t.cycle_nodes) == (3, 2, 1, 3)
    assert {r.rule: r.n for r in graph.violations(nodes, graph.adjacency(e, nodes), graph.scc(nodes, e)).collect()} == {"in_equals_out": 0, "scc_sizes_sum_to_nodes": 0, "no_dangling_edge": 0}
    assert {r.rule: r.n for r in graph.violations(nodes, e.select("src", "dst"), graph.scc(nodes, e)).collect()}["no_dangling_edge"] == 2


def test_reasons_mark_type_checking(spark):
    schema = "src string, dst string, reasons array<struct<conditional:boolean,symbols:array<string>,runtime:boolean>>"
    rows = [("a", "b", [(True, ["x TYPE_CHECKING"], None)]), ("a", "c", [(True, ["x"], None)]), ("a", "d", [(None, None, False)]), ("a", "e", None)]
    e = spark.createDataFrame(rows, schema)
    assert {r.dst for r in e.where(graph.type_checking_only(e)).collect()} == {"b", "d"}


@pytest.mark.parametrize("small", [graph.GROUP, 0])
def test_nothing(spark, small):
    none, nodes = frame(spark, []), spark.createDataFrame([], "id string")
    assert graph.scc(nodes, none, group=small).count() == 0
    assert graph.hops(none, nodes, small=small).count() == 0
    assert graph.degrees(none).count() == 0
    one = spark.createDataFrame([("a",)], "id string")
    assert [tuple(r) for r in graph.scc(one, none, group=small).collect()] == [("a", "a", 1)]
    assert [tuple(r) for r in graph.distances(one, none, one, small=small).collect()] == [("a", 0, 0)]


def placed_graph(seed=7, files=9, each=6, cross=8):
    """Ids 'f:n' with most edges within a file, and some between files, cycles over several among them."""
    rng = random.Random(seed)
    n = files * each
    pairs = {(f * each + rng.randrange(each), f * each + rng.randrange(each)) for f in range(files) for _ in range(9)}
    pairs |= {(0, each), (each, 2 * each), (2 * each, 0)} | {(rng.randrange(n // 2), rng.randrange(n // 2)) for _ in range(cross)}
    pairs = sorted((a, b) for a, b in pairs if a != b)
    return n, pairs, [f"f{i // each}:n{i:03}" for i in range(n)]


@pytest.mark.parametrize("part", [graph.PART, 25, 0])
@pytest.mark.parametrize("seed", [7, 8])
def test_parts_give_the_same(spark, part, seed):
    n, pairs, name = placed_graph(seed)
    e, nodes = frame(spark, [(name[a], name[b]) for a, b in pairs]), spark.createDataFrame([(x,) for x in name], "id string")
    if part == 25:
        cut = graph._cut(e.toDF("a", "b"), part)
        assert cut.parts > 1 and not cut.closed
    reach, both = brute_reach(n, pairs), brute_reach(n, pairs + [(b, a) for a, b in pairs])
    mates = [[j for j in range(n) if j in reach[i] and i in reach[j]] for i in range(n)]
    assert max(map(len, mates)) > 6
    got = {r.id: (r.scc_id, r.scc_size) for r in graph.scc(nodes, e, part=part).collect()}
    assert got == {name[i]: (name[min(mates[i])], len(mates[i])) for i in range(n)}
    got = {r.id: r.c for r in graph.weak(e, part=part).collect()}
    assert got == {name[i]: name[min(both[i])] for i in range(n) if len(both[i]) > 1}
    seeds = [0, 20, n - 1]
    want, level = dict.fromkeys(seeds, 0), set(seeds)
    while level:
        level = {b for a, b in pairs if a in level} - set(want)
        want |= dict.fromkeys(level, max(want.values()) + 1)
    start = spark.createDataFrame([(name[i],) for i in [*seeds, 0]] + [(None,)], "id string")
    assert sorted(tuple(r) for r in graph.hops(e, start, part=part).collect()) == sorted((name[i], h) for i, h in want.items())


@pytest.mark.parametrize("solve", ["weak", "scc", "scc by rounds", "hops", "distances"])
def test_long_ways_within_files_take_no_rounds(spark, monkeypatch, solve):
    pairs = [(f"f{f}:{i:02}", f"f{f}:{i + 1:02}") for f in range(4) for i in range(30)] + [("f0:30", "f0:00")]
    e = frame(spark, pairs)
    nodes, start = e.selectExpr("explode(array(src, dst)) AS id").distinct(), frame(spark, [("f1:00",)], "id string")
    settled = []
    monkeypatch.setattr(graph, "settle", lambda df, was=graph.settle: settled.append(df) or was(df))
    if solve == "weak":
        assert graph.weak(e).select("c").distinct().count() == 4
    elif solve.startswith("scc"):
        assert graph.scc(nodes, e, group=graph.GROUP if solve == "scc" else 0).where("scc_size = 31 AND scc_id = 'f0:00'").count() == 31
    elif solve == "hops":
        assert graph.hops(e, start).agg({"hops": "max"}).first()[0] == 30
    else:
        assert graph.distances(nodes, e, start).agg({"dd": "max"}).first()[0] == 30
    assert len(settled) <= 3


def test_node_order_ranks_over_tasks(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10_000), 3000)
    rows = [(f"n{i}", i % 3) for i in ids]
    reach = spark.createDataFrame(rows, "id string, hops int")
    order = graph.node_order(reach)
    assert not [w for w in order._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number" in w]
    want = {x: k for g in range(3) for k, x in enumerate(sorted(a for a, h in rows if h == g))}
    assert {r.id: r.gen_idx for r in order.collect()} == want and {(r.id, r.gen) for r in order.collect()} == set(rows)
