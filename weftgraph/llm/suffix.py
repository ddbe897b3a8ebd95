"""Suffix-array dedup: passages of 50 words or more that occur before, found by merging shard BWTs.

1. Exact sharding. A window is 50 consecutive words; its anchor is the least hash of the 41 10-word grams
   in it. Equal windows have equal anchors, wherever they are, so windows can only repeat within an
   anchor. Runs of windows with one anchor are the unit: (anchor, hash of all their words, document,
   position). A run can repeat itself, as in text of a short period. One that doesn't, which the hashes of
   its windows tell, and whose anchor has no other run in the corpus holds no repeat and is dropped.
2. Runs that are word for word equal collapse to their first one; all windows of the others are repeats.
3. Of anchors with different runs, or with runs that repeat themselves, the first of each are compared.
   They are cut into shards; a shard's words form strings over 10-word symbols (one string for each offset
   modulo 10, each with an end symbol of its own), whose suffix array and Burrows-Wheeler transform are
   made locally. The transforms of all shards of a task are then merged by interleave refinement: the vector that tells from which
   shard each suffix of the merged order comes is redistributed by the transforms' symbols, which sorts
   it by one more leading symbol each time, without comparing suffixes. Where the source intervals or
   symbols differ, the common prefix ends; five rounds leave the intervals of suffixes that share 50 words.
4. In each interval the first window by (document, position) stays; all others are repeats. Repeated
   windows of a document are united into passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, textvec

WINDOW, Q = 50, 10
ROUNDS = WINDOW // Q
_RUNS = "anchor long, seg long, inner boolean, doc_id long, th int, s int, n int"


def window_anchors(gram: np.ndarray) -> np.ndarray:
    """Least of the WINDOW - Q + 1 grams from each position, by doubling."""
    width, have, m = WINDOW - Q + 1, 1, gram
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def runs_of(w: textvec.Words) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor, hash, inner) of every maximal run of windows with one anchor; inner: it holds equal windows."""
    none = np.empty(0, np.int64)
    if len(w.hash) < WINDOW:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    sums = w.prefix()
    anchor = window_anchors(w.gram(Q, sums))
    v = np.flatnonzero(w.inside(WINDOW))
    if not len(v):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    a = anchor[v]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(v) != 1) | (a[1:] != a[:-1])]))
    n = np.diff(np.append(first, len(v)))
    s = v[first]
    run = np.repeat(np.arange(len(n)), n)
    key = textvec.mix(w.gram(WINDOW, sums)[v] + textvec.mix(run.astype(np.uint64)))
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    inner = np.zeros(len(n), bool)
    if len(twice):
        inner[run[np.isin(key, twice)]] = True
    return w.doc[s], s, n, a[first], textvec.run_hash(sums, s, s + n + WINDOW - 1), inner


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in textvec.chunks(whole, 2):
            w = textvec.words(batch.column(2))
            doc, s, n, anchor, seg, inner = runs_of(w)
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(inner), batch.column(0).take(rows), batch.column(1).take(rows),
                    pa.array((s - w.bounds[doc]).astype(np.int32)), pa.array(n.astype(np.int32)),
                ],
                names=["anchor", "seg", "inner", "doc_id", "th", "s", "n"],
            )


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, followed, doc_id, th, s, n, words) of the wanted runs of each document."""
    for whole in batches:
        for batch in textvec.chunks(whole, 2):
            w = textvec.words(batch.column(2))
            want = batch.column(3)
            doc = np.repeat(np.arange(len(want)), np.asarray(pc.list_value_length(want)))
            flat = want.flatten()
            anchor, followed, s, n = (flat.field(i) for i in range(4))
            begin = w.bounds[doc] + np.asarray(s)
            end = begin + np.asarray(n) + WINDOW - 1
            raw = [w.hash[i:j].tobytes() for i, j in zip(begin, end, strict=True)]
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [anchor, followed, batch.column(0).take(rows), batch.column(1).take(rows), s, n, pa.array(raw, pa.binary())],
                names=["anchor", "followed", "doc_id", "th", "s", "n", "words"],
            )


class Shard:
    """Suffixes of the strings of some runs in order of their first five symbols, and the transform."""

    def __init__(self, runs: list[np.ndarray], first_end: int):
        length = np.array([len(r) for r in runs])
        size = length + 1  # entries of a run: its symbols and Q end symbols, by position
        self.base = np.cumsum(size) - size
        self.run = np.repeat(np.arange(len(runs)), size)
        self.pos = np.arange(size.sum()) - self.base[self.run]
        flat = np.concatenate(runs)
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(flat * textvec.powers(textvec.BASE, len(flat)), dtype=np.uint64, out=sums[1:])
        at = self.pos + (self.base - np.arange(len(runs)))[self.run]
        real = self.pos <= (length - Q)[self.run]
        symbol = np.empty(len(self.pos), np.int64)
        symbol[real] = (textvec.run_hash(sums, at[real], at[real] + Q) >> np.uint64(1)).view(np.int64)
        symbol[~real] = -1 - (first_end + self.run[~real] * Q + self.pos[~real] % Q)
        end = (length - Q)[self.run]
        here = np.arange(len(symbol))
        # the entry before the first of a string is, cyclically, its end
        wrap = end + 1 + (self.pos - end - 1) % Q - self.pos
        before = here + np.where(self.pos >= Q, -Q, wrap)
        keys, ahead = [symbol], here
        for _ in range(ROUNDS - 1):
            ahead = np.where(real[ahead], ahead + Q, ahead)
            keys.append(symbol[ahead])
        self.order = np.lexsort(keys[::-1])
        self.bwt = symbol[before[self.order]]


def merge(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, entry, interval) in merged order; entries of an interval share their first WINDOW words."""
    sizes = np.array([len(x.bwt) for x in shards])
    base = np.cumsum(sizes) - sizes
    # the symbols are ranked once; a round only counts them, in the order that the one before it left
    distinct, rank = np.unique(np.concatenate([x.bwt for x in shards]), return_inverse=True)
    rank = rank.astype(np.uint16 if len(distinct) <= 1 << 16 else np.int32)
    z = np.repeat(np.arange(len(shards)), sizes)
    interval = np.zeros(len(z), np.int64)
    place = np.arange(len(z))  # in the concatenation of the shards' orders
    for _ in range(ROUNDS):
        symbol = rank[place]
        order = np.argsort(symbol, kind="stable")
        z, symbol, interval = z[order], symbol[order], interval[order]
        fresh = np.ones(len(z), bool)
        fresh[1:] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
        interval = np.cumsum(fresh)
        by_shard = np.argsort(z, kind="stable")
        place = np.empty(len(z), np.int64)
        place[by_shard] = np.arange(len(z))
    entry = np.concatenate([x.order for x in shards])[place]
    return z, entry, interval


def repeats(runs: list[np.ndarray], n: np.ndarray, shard_words: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, window, first): windows that occur more than once in ``runs``; the first is the one of the earliest run and position."""
    ends = np.cumsum([len(r) for r in runs])
    cuts = np.searchsorted(ends, np.arange(shard_words, ends[-1], shard_words)) + 1
    edges = np.unique(np.concatenate([[0], cuts, [len(runs)]]))
    edges = edges[edges <= len(runs)]
    shards = [Shard(runs[i:j], int(i) * Q) for i, j in zip(edges[:-1], edges[1:], strict=True)]
    z, entry, interval = merge(shards)
    first_run, offset = edges[:-1], np.cumsum([0, *(len(x.run) for x in shards[:-1])])
    run = np.concatenate([x.run + i for x, i in zip(shards, first_run, strict=True)])[offset[z] + entry]
    pos = np.concatenate([x.pos for x in shards])[offset[z] + entry]
    whole = pos < n[run]
    run, pos, interval = run[whole], pos[whole], interval[whole]
    many = np.bincount(interval)[interval] > 1
    run, pos, interval = run[many], pos[many], interval[many]
    order = np.lexsort((pos, run, interval))
    run, pos, interval = run[order], pos[order], interval[order]
    first = np.ones(len(run), bool)
    first[1:] = interval[1:] != interval[:-1]
    return run, pos, first


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by anchor: (doc_id, th, s, e, first), the repeated passages within compared runs."""

    def work(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        doc, th, s = (np.asarray(t.column(i)) for i in (2, 3, 4))
        order = np.lexsort((s, th, doc))
        place = np.stack([doc, th, s])[:, order]
        order = order[np.concatenate([[True], (place[:, 1:] != place[:, :-1]).any(0)])]
        doc, th, s, n = doc[order], th[order], s[order], np.asarray(t.column(5))[order]
        runs = [np.frombuffer(b, np.uint64) for b in t.column(6).take(pa.array(order)).to_pylist()]
        # runs are in order of (document, position)
        run, pos, first = repeats(runs, n)
        at = np.cumsum(n) - n
        kind = np.zeros(n.sum(), np.int8)  # of every window: 1 a first, 2 a repeat
        kind[np.repeat(np.asarray(t.column(1))[order], n)] = 1  # an equal run comes later
        kind[at[run] + pos] = np.where(first, 1, 2)
        run = np.repeat(np.arange(len(n)), n)[kind > 0]
        pos = (np.arange(len(kind)) - np.repeat(at, n))[kind > 0]
        first = kind[kind > 0] == 1
        begin = np.ones(len(run), bool)
        begin[1:] = (run[1:] != run[:-1]) | (first[1:] != first[:-1]) | (pos[1:] != pos[:-1] + 1)
        i = np.flatnonzero(begin)
        last = np.append(i[1:], len(run)) - 1 if len(i) else i
        r = run[i]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc[r]), pa.array(th[r].astype(np.int32)), pa.array((s[r] + pos[i]).astype(np.int32)),
                pa.array((s[r] + pos[last] + WINDOW).astype(np.int32)), pa.array(first[i]),
            ],
            names=["doc_id", "th", "s", "e", "first"],
        )

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = np.asarray(batch.column(0))
        cut = int(np.searchsorted(anchor, anchor[-1], side="left"))  # the last anchor may go on in the next batch
        if held and cut == 0 and held[-1].column(0)[-1].as_py() != anchor[0]:
            yield work(held)
            held, size = [], 0
        if cut:
            held.append(batch.slice(0, cut))
            size += held[-1].nbytes
            if size > 16 << 20:
                yield work(held)
                held, size = [], 0
        held.append(batch.slice(cut))
        size += held[-1].nbytes
    if held:
        yield work(held)


def _united(found: DataFrame) -> DataFrame:
    """Overlapping or touching passages of a document and kind as one."""
    w = Window.partitionBy("doc_id", "th", "first").orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("fresh", (before.isNull() | (before < F.col("s"))).cast("int"))
    island = F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("island", island).groupBy("doc_id", "th", "first", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("th"), text.alias("text"))


def _passages(docs: DataFrame) -> DataFrame:
    slim = _keyed(docs)
    runs = slim.mapInArrow(_find_runs, _RUNS)
    by_anchor, by_run = Window.partitionBy("anchor"), Window.partitionBy("anchor", "seg")
    # one sort by anchor serves all windows; rows of one place, which only repeated rows give, share a rank
    runs = runs.withColumn("r", F.dense_rank().over(by_anchor.orderBy("seg", "doc_id", "th", "s")))
    runs = runs.select("*", F.min("r").over(by_run).alias("r0"), F.max("r").over(by_run).alias("r1"))
    runs = runs.select("*", F.max("r").over(by_anchor).alias("n_runs"), (F.max("inner").over(by_anchor) | (F.min("seg").over(by_anchor) < F.max("seg").over(by_anchor))).alias("mixed"))
    runs = common.cut(runs.where("n_runs > 1 OR inner").selectExpr("anchor", "seg", "doc_id", "th", "s", "n", "mixed", "r = r0 AS leads", "r1 > r AS followed"))
    span = [F.col("s"), (F.col("s") + F.col("n") + WINDOW - 1).alias("e")]
    later = runs.where("NOT leads").select("doc_id", "th", *span, F.lit(False).alias("first"))
    led = runs.where("leads AND followed AND NOT mixed").select("doc_id", "th", *span, F.lit(True).alias("first"))
    wanted = runs.where("leads AND mixed").groupBy("doc_id", "th").agg(F.collect_set(F.struct("anchor", "followed", "s", "n")).alias("want"))
    compared = (
        slim.join(wanted, ["doc_id", "th"])
        .select("doc_id", "th", "text", "want")
        .mapInArrow(_cut_words, "anchor long, followed boolean, doc_id long, th int, s int, n int, words binary")
        .repartition("anchor")
        .sortWithinPartitions("anchor", "doc_id", "th", "s")
        .mapInArrow(_compare, "doc_id long, th int, s int, e int, first boolean")
    )
    return _united(later.union(led).union(compared))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, is_first): passages made of 50-word windows that occur more than once.

    A window that occurred before, in order of document id and position, is a repeat (``is_first`` false);
    one that occurs for the first time, and again later, is a first. Windows of one kind that overlap or
    touch are united; word offsets count from 0, ends are exclusive. Words are compared without case and
    punctuation. Defined cases: null, empty and short texts have no passages; rows with a null id are left
    alone; rows that repeat both id and text are one document, rows that repeat the id with another text
    are documents of their own; other columns play no part; an empty table gives an empty result.
    """
    return _passages(docs).select("doc_id", F.col("s").alias("start_word"), F.col("e").alias("end_word"), F.col("first").alias("is_first"))


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` (word offsets) and what follows each up to the next word."""
    raw = text.encode("utf-8", "surrogatepass")
    w = textvec.words(pa.array([text], pa.string()))
    out, at = [], 0
    for s, e in sorted(spans):
        begin = int(w.start[s])
        out.append(raw[at:begin])
        at = int(w.start[e]) if e < len(w.start) else len(raw)
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeated passage cut out of its text; first occurrences and all else stay.

    A column ``n_chars`` follows the text where it was cut. A document of which nothing is left but
    separators keeps its row, with an empty text.
    """
    cuts = _passages(docs).where("NOT first").groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("__cuts"))
    cuts = cuts.withColumnsRenamed({"doc_id": "__cut_id", "th": "__cut_th"})
    text = F.col("text").cast("string")
    joined = docs.join(cuts, (F.col("doc_id") == F.col("__cut_id")) & (F.hash(text) == F.col("__cut_th")), "left")

    @F.arrow_udf("string")
    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        cut = [None if c is None or t is None else cut_text(t, [(x["s"], x["e"]) for x in c]).strip() for t, c in zip(texts.to_pylist(), spans.to_pylist(), strict=True)]
        return pa.array(cut, pa.string())

    hit = F.col("__cuts").isNotNull()
    # only texts that are cut cross over to Python
    changed = joined.withColumn("__new", without(F.when(hit, text), F.col("__cuts")))
    made = {"text": F.when(hit, F.col("__new")).otherwise(text)}
    for c in docs.columns:
        if c.lower() == "n_chars":
            made[c] = F.when(hit, F.char_length("__new").cast(docs.schema[c].dataType)).otherwise(F.col(f"`{c}`"))
    return changed.select(*[(made[c] if c in made else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(common.table(spark, sf_dir, "documents"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLES: dict[str, str] = {}
