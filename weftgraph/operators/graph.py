"""Graph operators over edge tables (src, dst): degrees, hops, reachability, strongly connected components.

A graph is first cut into parts of some ``PART`` edges by the places of its nodes (files, folders), each of
which a task solves as far as no edge from or to another part has a say; what is left is contracted again or
goes to fixpoints. These keep the edges hash-partitioned by their join column, so that a round shuffles only
its frontier, and settle each round in the shared folder. There strongly connected components are looked for
within weakly connected ones, many of which a task solves at once; those of more than ``GROUP`` edges are
solved by rounds over all tasks.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import settle

GROUP = PART = 200_000
_CELLS = 1 << 14
_TYPE_ONLY = "type-only type_only type_checking typing".split()


def type_checking_only(edges: DataFrame) -> Column:
    """Whether an edge exists for the type checker alone, by whichever of the known columns the table has."""
    have = {f.name: f.dataType for f in edges.schema}
    tests = [F.lit(False)]
    flag = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    if "type_checking" in have:
        tests.append(flag("type_checking", F.lit(True)))
    if "runtime" in have:
        tests.append(flag("runtime", F.lit(False)))
    if "conditional" in have:
        tests.append(flag("conditional", F.lit("TYPE_CHECKING")) if have["conditional"].typeName() == "string" else F.lit(False))
    if "subkind" in have:
        tests.append(F.coalesce(F.lower("subkind").isin(*_TYPE_ONLY), F.lit(False)))
    if "reason" in have:
        tests.append(F.coalesce(F.lower("reason").contains("type_checking"), F.lit(False)))
    if "reasons" in have and have["reasons"].typeName() == "array" and have["reasons"].elementType.typeName() == "struct":
        names = set(have["reasons"].elementType.names)

        def says(r: Column) -> Column:
            out = F.lit(False)
            if "type_checking" in names:
                out = out | F.coalesce(r["type_checking"], F.lit(False))
            if "runtime" in names:
                out = out | ~F.coalesce(r["runtime"], F.lit(True))
            if {"conditional", "symbols"} <= names:
                out = out | (F.coalesce(r["conditional"], F.lit(False)) & F.coalesce(F.exists(r["symbols"], lambda s: s.contains("TYPE_CHECKING")), F.lit(False)))
            return out

        tests.append(F.coalesce(F.exists("reasons", says), F.lit(False)))
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def adjacency(edges: DataFrame, nodes: DataFrame | None = None, *, runtime_only: bool = False) -> DataFrame:
    """Distinct (src, dst) without self-loops and, where ``nodes`` (id) is given, without dangling ends."""
    e = edges.where(~type_checking_only(edges)) if runtime_only else edges
    e = e.select("src", "dst").where((F.col("src") != F.col("dst")) & (F.col("src").cast("string") != "") & (F.col("dst").cast("string") != "")).distinct()
    if nodes is not None:
        ids = nodes.select("id").where(F.col("id").isNotNull()).distinct()
        e = e.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return e.select("src", "dst")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of every end of an edge, counting rows; one pass and one shuffle."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    one = edges.select(ends.alias("e")).select("e.*").where(F.col("id").isNotNull())
    return one.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def _few(edges: DataFrame, small: int) -> bool:
    """Whether there are at most ``small`` edges; counts no further than that."""
    return edges.limit(small + 1).count() <= small


def _in_one_task(left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    def one(df: DataFrame) -> DataFrame:
        return df.withColumn("__one", F.lit(0)).groupBy("__one")

    return one(left).cogroup(one(right)).applyInArrow(run, schema)


# == parts


def place(c: str | Column) -> Column:
    """Where a node lies by its id: the folder of its file, or the file without a folder; an id without either is its own place."""
    return F.regexp_replace(F.substring_index((F.col(c) if isinstance(c, str) else c).cast("string"), ":", 1), "/[^/]*$", "")


class _Cut:
    """Parts of a graph (a, b): a node's part is that of its place; ``closed`` if no edge leads from part to part."""

    def __init__(self, parts: int, closed: bool):
        self.parts, self.closed = parts, closed

    def of(self, c: str) -> Column:
        return F.lit(0).cast("long") if self.parts == 1 else F.pmod(_cell(c), F.lit(self.parts))

    def dealt(self, edges: DataFrame) -> DataFrame:
        """(part, a, b, way): edges within a part (0), and those between parts with both: leading out (1) and in (2)."""
        if self.closed:
            return edges.select(self.of("a").alias("part"), "a", "b", F.lit(0).alias("way"))
        e = edges.select(self.of("a").alias("p"), self.of("b").alias("q"), "a", "b")
        one = lambda p, way: F.struct(F.col(p).alias("part"), F.lit(way).alias("way"))
        rows = F.when(F.col("p") == F.col("q"), F.array(one("p", 0))).otherwise(F.array(one("p", 1), one("q", 2)))
        return e.select(F.explode(rows).alias("r"), "a", "b").select("r.part", "a", "b", "r.way")


def _cell(c: str) -> Column:
    return F.pmod(F.xxhash64(place(c)), F.lit(_CELLS))


def _cut(edges: DataFrame, part: int) -> _Cut | None:
    """Parts of about ``part`` edges (a, b); none where one would have four times as many, or a quarter of all edges would lead from part to part."""
    if part <= 0:
        return None
    kind = edges.schema["a"].dataType
    if not isinstance(kind, (T.StringType, T.IntegralType)):
        return None
    across = F.sum((_cell("a") != _cell("b")).cast("long"))
    held = edges.groupBy(_cell("a").alias("cell")).agg(F.count(F.lit(1)).alias("n"), across.alias("x")).collect()
    n, x = sum(r.n for r in held), sum(r.x for r in held)
    parts = min(_CELLS, max(1, -(-n // part)))
    if parts == 1:
        return _Cut(1, True)
    if 4 * x > n:
        return None
    load = [0] * parts
    for r in held:
        load[r.cell % parts] += r.n
    if x:
        for r in edges.where(_cell("a") != _cell("b")).groupBy(_cell("b").alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect():
            load[r.cell % parts] += r.n
    return None if max(load) > 4 * part else _Cut(parts, not x)


def _numbered(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """Distinct values, and the columns as positions in them."""
    whole = pa.chunked_array([k for c in columns for k in c.chunks], columns[0].type).combine_chunks().dictionary_encode()
    at = np.asarray(whole.indices.to_numpy(zero_copy_only=False), dtype=np.int64)
    return whole.dictionary, np.split(at, np.cumsum([len(c) for c in columns])[:-1])


def _lists(a: np.ndarray, b: np.ndarray, n: int) -> list[list[int]]:
    order = np.argsort(a, kind="stable")
    ends, to = np.cumsum(np.bincount(a, minlength=n)).tolist(), b[order].tolist()
    return [to[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes a member of its weakly connected component, the same for all."""
    up = list(range(n))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[x] = y
    top = np.array(up, dtype=np.int64)
    while True:
        next_ = top[top]
        if (next_ == top).all():
            return top
        top = next_


def _least(ids: pa.Array, comp: np.ndarray) -> np.ndarray:
    """The position of the least member of each node's component, in the order of ``ids``."""
    order = pc.sort_indices(ids).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    low = np.full(len(order), len(order), dtype=np.int64)
    np.minimum.at(low, comp, rank)
    return order[low[comp]].astype(np.int64)


def _rows(ids: pa.Array, schema: list[str], *blocks: tuple[int, np.ndarray, np.ndarray | None, np.ndarray | None]) -> pa.Table:
    """Blocks of (what, positions, positions or none, numbers or none) as one table."""
    none = lambda k, n: pa.nulls(n, k)
    what = np.concatenate([np.full(len(b[1]), b[0], dtype=np.int32) for b in blocks])
    first = pa.concat_arrays([ids.take(pa.array(b[1])) for b in blocks])
    second = pa.concat_arrays([none(ids.type, len(b[1])) if b[2] is None else ids.take(pa.array(b[2])) for b in blocks])
    number = pa.concat_arrays([none(pa.int64(), len(b[1])) if b[3] is None else pa.array(b[3], pa.int64()) for b in blocks])
    return pa.table([pa.array(what), first, second, number], names=schema)


# == hops and reachability


def hops(edges: DataFrame, seeds: DataFrame, *, direction: str = "forward", most: int | None = None, small: int = 0, part: int = PART) -> DataFrame:
    """(id, hops) of everything within reach of ``seeds`` (id), seeds at 0.

    ``direction``: forward along edges, backward against them, or both. ``most`` bounds the hops. ``small``: edges
    up to which one task solves the whole graph, for callers who know theirs to be small. ``part``: edges of a part of the graph, in which
    a task solves every weakly connected component that no edge between parts touches; the others take a round a hop.
    """
    if direction not in ("forward", "backward", "both"):
        raise ValueError(direction)
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
    e = {"forward": e, "backward": back, "both": e.union(back)}[direction].where("a <> b").distinct()
    start = seeds.select("id").where(F.col("id").isNotNull()).distinct()
    kind = seeds.schema["id"].dataType.simpleString()
    e = settle(e)  # once, whatever made the edges
    if small and _few(e, small):
        return _in_one_task(start, e, _bfs_task(most), f"id {kind}, hops int")
    cut = _cut(e, part) if seeds.schema["id"].dataType == e.schema["a"].dataType else None
    if cut is None:
        return _hops_rounds(e, start, most)
    left, right = start.select(cut.of("id").alias("part"), "id").groupBy("part"), cut.dealt(e).groupBy("part")
    found = left.cogroup(right).applyInArrow(_part_hops_task(most), f"what int, id {kind}, other {kind}, n long")
    done = lambda f: f.where("what = 0").select("id", F.col("n").cast("int").alias("hops"))
    if cut.closed:
        return done(found)
    found = settle(found)
    edges_left = found.where("what = 1").select(F.col("id").alias("a"), F.col("other").alias("b"))
    return done(found).union(_hops_rounds(edges_left, found.where("what = 2").select("id"), most))


def _part_hops_task(most: int | None):
    run = _bfs_task(most)

    def part(seeds: pa.Table, edges: pa.Table) -> pa.Table:
        ids, (s, a, b) = _numbered(seeds["id"], edges["a"], edges["b"])
        way = edges["way"].to_numpy()
        comp = _joined(a[way == 0], b[way == 0], len(ids))
        touched = np.zeros(len(ids), dtype=bool)
        touched[comp[a[way == 1]]] = touched[comp[b[way == 2]]] = True
        open_ = touched[comp]
        shut = ~open_[a] & (way == 0)
        level = run(pa.table({"id": s[~open_[s]]}), pa.table({"a": a[shut], "b": b[shut]}))
        keep = open_[a] & (way < 2)
        at = level["id"].to_numpy()
        return _rows(ids, ["what", "id", "other", "n"], (0, at, None, level["hops"].to_numpy()), (1, a[keep], b[keep], None), (2, s[open_[s]], None, None))

    return part


def _hops_rounds(e: DataFrame, start: DataFrame, most: int | None) -> DataFrame:
    e = settle(e.repartition("a"))
    seen = frontier = settle(start.withColumn("hops", F.lit(0)))
    level = 0
    while most is None or level < most:
        level += 1
        reached = e.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        frontier = settle(reached.join(seen, "id", "left_anti").withColumn("hops", F.lit(level)))
        if frontier.isEmpty():
            break
        # a level is written once; only now and then are they joined into one table
        seen = seen.union(frontier) if level % 32 else settle(seen.union(frontier))
    return seen


def _bfs_task(most: int | None):
    def run(seeds: pa.Table, edges: pa.Table) -> pa.Table:
        next_of = defaultdict(list)
        for a, b in zip(edges.column("a").to_pylist(), edges.column("b").to_pylist(), strict=True):
            next_of[a].append(b)
        seen = dict.fromkeys(seeds.column("id").to_pylist(), 0)
        queue = deque(seen)
        while queue:
            x = queue.popleft()
            if most is not None and seen[x] >= most:
                continue
            for y in next_of.get(x, ()):
                if y not in seen:
                    seen[y] = seen[x] + 1
                    queue.append(y)
        return pa.table({"id": pa.array(list(seen), seeds.schema.field("id").type), "hops": pa.array(list(seen.values()), pa.int32())})

    return run


def reachable(edges: DataFrame, seeds: DataFrame, *, direction: str = "forward", small: int = 0) -> DataFrame:
    return hops(edges, seeds, direction=direction, small=small).select("id")


def distances(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, small: int = 0) -> DataFrame:
    """(id, du, dd): hops of every node upstream and downstream of the seeds; null where out of reach."""
    up = hops(edges, seeds, direction="backward", small=small).withColumnRenamed("hops", "du")
    down = hops(edges, seeds, direction="forward", small=small).withColumnRenamed("hops", "dd")
    return nodes.select("id").distinct().join(up, "id", "left").join(down, "id", "left")


def signature(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(signature): n:<files>;e:<distinct internal edges>, which changes when a graph gains or loses either."""
    e = adjacency(edges, files.select("id")).agg(F.count(F.lit(1)).alias("e"))
    n = files.select("id").distinct().agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(e).select(F.concat(F.lit("n:"), "n", F.lit(";e:"), "e").alias("signature"))


def node_order(reach: DataFrame) -> DataFrame:
    """(id, gen, gen_idx): generation and rank within it by id. Generations are sorted over all tasks, so that none holds a whole one."""
    from pyspark.sql import Window

    rows = settle(reach.select("id", F.col("hops").alias("gen")))  # sorting samples first
    rows = settle(rows.repartitionByRange("gen", "id").sortWithinPartitions("gen", "id").withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("task", F.shiftright("at", 33))
    runs = rows.groupBy("gen", "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("gen").orderBy("task")) - F.col("n")
    # at most as many runs as tasks and generations
    runs = F.broadcast(runs.select("gen", "task", (before - F.col("first")).alias("shift")))
    return rows.join(runs, ["gen", "task"]).select("id", "gen", (F.col("at") + F.col("shift")).alias("gen_idx"))


def unreached(nodes: DataFrame, edges: DataFrame, roots: DataFrame, small: int = 0) -> DataFrame:
    """Ids that no edge enters and no root reaches."""
    inner = adjacency(edges)
    live = reachable(inner, roots, small=small)
    entered = inner.select(F.col("dst").alias("id")).distinct()
    return nodes.select("id").where(F.col("id").isNotNull()).distinct().join(live, "id", "left_anti").join(entered, "id", "left_anti")


# == strongly connected components


def weak(edges: DataFrame, *, part: int = PART) -> DataFrame:
    """(id, c): of every end of an edge the least member of its weakly connected component.

    Tasks join what lies within parts of about ``part`` edges; edges between parts then join the components of these.
    """
    e = settle(edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")))
    cut = _cut(e, part)
    if cut is None:
        return _stars(e)
    kind = e.schema["a"].dataType.simpleString()
    found = cut.dealt(e).groupBy("part").applyInArrow(_weak_task, f"what int, id {kind}, c {kind}, n long")
    if cut.closed:
        return found.select("id", "c")
    found = settle(found)
    ends = settle(found.where("what = 1").select("id", "c"))
    across = e.where(cut.of("a") != cut.of("b")).join(ends.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a")
    links = across.join(ends.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    tops = _stars(links).select(F.col("id").alias("c"), F.col("c").alias("top"))
    return found.where("what = 0").join(tops, "c", "left").select("id", F.coalesce("top", "c").alias("c"))


def _weak_task(edges: pa.Table) -> pa.Table:
    ids, (a, b) = _numbered(edges["a"], edges["b"])
    way = edges["way"].to_numpy()
    least = _least(ids, _joined(a[way == 0], b[way == 0], len(ids)))
    ends = np.unique(np.concatenate([a[way == 1], b[way == 2]]))
    own = np.unique(np.concatenate([a[way == 0], b[way == 0], ends]))
    return _rows(ids, ["what", "id", "c", "n"], (0, own, least[own], None), (1, ends, least[ends], None))


def _stars(edges: DataFrame) -> DataFrame:
    """As ``weak``, of (a, b) over all tasks.

    Stars are merged until none changes (large-star and small-star in turn): each round replaces a node's
    neighbours by the least of them, so that no round makes more edges than there are, and their number grows with the
    logarithm of a component's width.
    """
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    print_ = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.select("u", F.col("m").alias("v")))
        now = settle(small.distinct())
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == print_:
            break
        print_ = seen
    return now.select(F.col("u").alias("id"), F.col("v").alias("c")).union(now.select(F.col("v").alias("id"), F.col("v").alias("c")).distinct())


def scc(nodes: DataFrame, edges: DataFrame, *, runtime_only: bool = False, group: int = GROUP, part: int = PART) -> DataFrame:
    """(id, scc_id, scc_size) of every distinct node; a component is named by its least member as a string.

    ``part``: edges of a part of the graph that a task contracts, whatever components it cuts through. ``group``: of what no contraction
    makes smaller, edges of a weakly connected component that one task may hold; larger ones take rounds over all tasks.
    """
    ids = nodes.select("id").where(F.col("id").isNotNull()).distinct()
    e = settle(adjacency(edges, ids, runtime_only=runtime_only).select(F.col("src").alias("a"), F.col("dst").alias("b")))
    # nodes without a part in any cycle are their own component
    full = _components(e, group, part)
    return ids.join(full, "id", "left").select("id", F.coalesce("scc_id", "id").alias("scc_id"), F.coalesce("scc_size", F.lit(1).cast("long")).alias("scc_size"))


def _named(members: DataFrame) -> DataFrame:
    """(id, scc_id, scc_size) of (id, root)."""
    named = members.groupBy("root").agg(F.min(F.struct(F.col("id").cast("string").alias("s"), "id")).alias("m"), F.count(F.lit(1)).alias("scc_size"))
    return members.join(named, "root").select("id", F.col("m.id").alias("scc_id"), "scc_size")


def _components(e: DataFrame, group: int, part: int) -> DataFrame:
    """(id, scc_id, scc_size) of at least every node of (a, b) on a cycle.

    A task finds the components within a part. Those on no way through it, from an edge that leads in to one that leads out, are whole;
    the others are contracted to their least members, and the graph of these goes on.
    """
    cut = _cut(e, part)
    if cut is None:
        return _named(_scc_grouped(e.select(F.col("a").alias("src"), F.col("b").alias("dst")), group))
    kind = e.schema["a"].dataType.simpleString()
    found = cut.dealt(e).groupBy("part").applyInArrow(_contract_task, f"what int, id {kind}, other {kind}, n long")
    whole = lambda f: f.where("what = 0").select("id", F.col("other").alias("scc_id"), F.col("n").alias("scc_size"))
    if cut.closed:
        return whole(found)
    found = settle(found)
    merged = found.where("what = 1").select("id", F.col("other").alias("root"))
    left = found.where("what = 2").select(F.col("id").alias("a"), F.col("other").alias("b"))
    left = left.join(merged.select(F.col("id").alias("b"), F.col("root").alias("r")), "b", "left").select("a", F.coalesce("r", "b").alias("b"))
    # an open component leads on, so what leads nowhere is whole
    left = settle(left.join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").where("a <> b").select("a", "b").distinct())
    if left.isEmpty():
        return whole(found).union(_named(merged))
    above = _components(left, group, part if 2 * left.count() <= e.count() else 0).select("id", F.col("scc_id").alias("top"))
    under = merged.join(above.withColumnRenamed("id", "root"), "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    alone = above.join(merged.select("id"), "id", "left_anti").select("id", F.col("top").alias("root"))
    return whole(found).union(_named(under.union(alone)))


def _contract_task(edges: pa.Table) -> pa.Table:
    ids, (a, b) = _numbered(edges["a"], edges["b"])
    way = edges["way"].to_numpy()
    ia, ib = a[way == 0], b[way == 0]
    out = _lists(ia, ib, len(ids))
    order: list[int] = []
    comp = np.array(components_of(out, order), dtype=np.int64)
    size = np.bincount(comp, minlength=len(ids))[comp]
    least = _least(pc.cast(ids, pa.string()), comp)
    open_ = np.zeros(len(ids), dtype=bool)
    if (way == 1).any() and (way == 2).any():
        tops = _lists(comp[ia], comp[ib], len(ids))
        leads, led = [False] * len(ids), [False] * len(ids)
        for x in comp[a[way == 1]].tolist():
            leads[x] = True
        for x in comp[b[way == 2]].tolist():
            led[x] = True
        for x in order:  # what a component leads to is found before it
            leads[x] = leads[x] or any(leads[y] for y in tops[x])
        for x in reversed(order):
            if led[x]:
                for y in tops[x]:
                    led[y] = True
        open_ = (np.array(leads) & np.array(led))[comp]
    many = np.arange(len(ids))[size > 1]
    shut, ajar = many[~open_[many]], many[open_[many]]
    within = open_[ia] & open_[ib] & (comp[ia] != comp[ib])
    pairs = np.unique(np.stack([least[ia[within]], least[ib[within]]]), axis=1)
    leave = (way == 1) & open_[a]
    return _rows(
        ids, ["what", "id", "other", "n"], (0, shut, least[shut], size[shut]), (1, ajar, least[ajar], None), (2, pairs[0], pairs[1], None), (2, least[a[leave]], b[leave], None)
    )


def _scc_grouped(e: DataFrame, group: int) -> DataFrame:
    """(id, root) of the ends of ``edges``, by weakly connected components."""
    kind = e.schema["src"].dataType.simpleString()
    e = settle(e.repartition("src"))
    placed = settle(e.join(weak(e, part=0).withColumnRenamed("id", "src"), "src"))
    large = settle(placed.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group).select("c"))
    within = placed.join(large, "c", "left_anti")
    buckets = max(1, -(-2 * within.count() // max(group, 1)))
    inner = within.withColumn("bucket", F.pmod(F.xxhash64("c"), F.lit(buckets))).select("bucket", "src", "dst").groupBy("bucket").applyInArrow(_tarjan_task, f"id {kind}, root {kind}")
    if not large.isEmpty():
        inner = inner.union(_scc_rounds(placed.join(large, "c", "left_semi").select("src", "dst")))
    return inner


def _tarjan_task(edges: pa.Table) -> pa.Table:
    kind = edges.schema.field("src").type
    src, dst = edges.column("src").to_pylist(), edges.column("dst").to_pylist()
    ids = list(dict.fromkeys([*src, *dst]))
    at = {x: i for i, x in enumerate(ids)}
    out: list[list[int]] = [[] for _ in ids]
    for a, b in zip(src, dst, strict=True):
        out[at[a]].append(at[b])
    root = components_of(out)
    return pa.table({"id": pa.array(ids, kind), "root": pa.array([ids[r] for r in root], kind)})


def components_of(out: list[list[int]], order: list[int] | None = None) -> list[int]:
    """For each node a member of its strongly connected component, the same for all; no recursion (Pearce).

    ``order`` gets these members, each after those of the components that its own leads to."""
    n = len(out)
    index, low, comp = [0] * n, [0] * n, [-1] * n
    clock, stack = 0, []
    for start in range(n):
        if index[start]:
            continue
        clock += 1
        index[start] = low[start] = clock
        stack.append(start)
        path = [(start, iter(out[start]))]
        while path:
            v, rest = path[-1]
            for w in rest:
                if not index[w]:
                    clock += 1
                    index[w] = low[w] = clock
                    stack.append(w)
                    path.append((w, iter(out[w])))
                    break
                if comp[w] < 0:
                    low[v] = min(low[v], index[w])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[v])
                if low[v] == index[v]:
                    if order is not None:
                        order.append(v)
                    while True:
                        w = stack.pop()
                        comp[w] = v
                        if w == v:
                            break
    return comp


def _scc_rounds(edges: DataFrame) -> DataFrame:
    """(id, root) of the ends of ``edges``: trim, colour forward, confirm backward, repeat on what is left.

    An edge between two colours lies on no cycle and is dropped, so rounds shrink fast.
    """
    done: list[DataFrame] = []
    e = edges
    while True:
        # a node with no way in or no way out is alone; two layers of them go at once, the colours find the others
        for _ in range(2):
            sources, targets = e.select(F.col("src").alias("id")).distinct(), e.select(F.col("dst").alias("id")).distinct()
            e = e.join(targets.select(F.col("id").alias("src")), "src", "left_semi").join(sources.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
        e = settle(e.repartition("src"))
        if e.isEmpty():
            break
        colour = settle(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("c", F.col("id")))
        while True:
            offered = e.join(colour.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("o"))
            near = colour.join(offered, "id", "left").select("id", F.least("c", F.coalesce("o", "c")).alias("n"), "c")
            # what reaches the node that a node's colour names reaches the node too, so that paths are halved
            far = colour.select(F.col("id").alias("n"), F.col("c").alias("f"))
            after = settle(near.join(far, "n", "left").select("id", F.least("n", F.coalesce("f", "n")).alias("n"), "c"))
            moved = after.where("n <> c").limit(1).count()
            colour = after.select("id", F.col("n").alias("c"))
            if not moved:
                break
        within = e.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
        within = settle(within.select("src", "dst", "cs").repartition("dst"))
        found = frontier = settle(colour.where("id = c"))
        level = 0
        while True:
            level += 1
            reached = within.join(frontier.select(F.col("id").alias("dst"), "c"), "dst").where("cs = c").select(F.col("src").alias("id"), "c").distinct()
            frontier = settle(reached.join(found, "id", "left_anti"))
            if frontier.isEmpty():
                break
            found = found.union(frontier) if level % 32 else settle(found.union(frontier))
        done.append(found.select("id", F.col("c").alias("root")))
        left = within.select("src", "dst").join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti")
        e = settle(left.repartition("src"))
    if not done:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("root")).limit(0)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def scc_summary(components: DataFrame) -> DataFrame:
    """One row (cycle_nodes, largest_scc_size, scc_count) over the components of more than one node."""
    many = components.where("scc_size > 1")
    return many.agg(
        F.count(F.lit(1)).alias("cycle_nodes"), F.coalesce(F.max("scc_size"), F.lit(0).cast("long")).alias("largest_scc_size"), F.countDistinct("scc_id").alias("scc_count")
    )


def cycles(nodes: DataFrame, edges: DataFrame, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Components over all edges and over runtime edges: (id, scc_id, scc_size, scc_id_runtime, scc_size_runtime), and one row of totals."""
    whole, run = scc(nodes, edges, group=group), scc(nodes, edges, runtime_only=True, group=group)
    both = whole.join(run.withColumnsRenamed({"scc_id": "scc_id_runtime", "scc_size": "scc_size_runtime"}), "id")
    a, b = scc_summary(whole), scc_summary(run)
    totals = a.crossJoin(b.select(*[F.col(c).alias(f"{c}_runtime") for c in b.columns]))
    return both, totals.withColumn("tc_inflation", F.col("largest_scc_size") - F.col("largest_scc_size_runtime"))


# == invariants


def violations(nodes: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """(rule, n): how often each invariant of a graph is broken; all 0 for a sound one."""
    d = edges.agg((F.count("dst") - F.count("src")).alias("n"))  # the sums of the degrees
    sizes = components.select("scc_id", "scc_size").distinct().agg(F.coalesce(F.sum("scc_size"), F.lit(0)).alias("s"))
    n = nodes.select("id").distinct().agg(F.count(F.lit(1)).alias("n"))
    ids = nodes.select("id").distinct()
    dangling = edges.select(F.explode(F.array("src", "dst")).alias("id")).join(ids, "id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    rows: Iterable[tuple[str, DataFrame]] = (
        ("in_equals_out", d.select(F.abs("n").alias("n"))),
        ("scc_sizes_sum_to_nodes", sizes.crossJoin(n).select(F.abs(F.col("s") - F.col("n")).alias("n"))),
        ("no_dangling_edge", dangling),
    )
    out = None
    for name, df in rows:
        row = df.select(F.lit(name).alias("rule"), F.col("n").cast("long").alias("n"))
        out = row if out is None else out.union(row)
    return out
