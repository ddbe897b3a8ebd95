"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star edges.

One hash of every word 3-gram goes to one of 256 bins and keeps the bin's minimum; an empty bin copies
the bin that a fixed pseudo-random walk of its own meets first among those filled from the text. Four
bins make a band, 64 bands a document. In a bucket every document is paired with the least id only
(a star); pairs are verified on all bins. The members of a bucket that fail are starred again among
themselves, until none is left, so that copies don't cost all their pairs and no bucket is cut short. A
task does that for a block of a bucket; where a bucket has several, the centres of each two blocks meet in a
task of their own, so that none holds more than two blocks. Verified edges are contracted by alternating large-star and
small-star steps, and the least id of each group stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textvec

BINS, BANDS, ROWS, SHINGLE = 256, 64, 4, 3
BLOCK = 4096  # members of a bucket that one task stars
_EMPTY = np.uint32(0xFFFFFFFF)
_WALK = np.stack([np.random.Generator(np.random.PCG64(b)).permutation(BINS) for b in range(BINS)])  # a row: where bin b looks, in turn
_ODD = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Densified minima, text by bin, and the number of words of each text; without words a row is void."""
    w = textvec.words(texts)
    n_docs, n_words = len(w.bounds) - 1, np.diff(w.bounds)
    best = np.full(n_docs * BINS, _EMPTY, np.uint32)

    def put(doc: np.ndarray, h: np.ndarray) -> None:
        np.minimum.at(best, doc * BINS + (h >> np.uint64(56)).astype(np.int64), ((h >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.uint32))

    s = w.prefix()
    ok = w.inside(SHINGLE)
    put(w.doc[: len(ok)][ok], w.gram(SHINGLE, s)[ok])
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        put(short, textvec.run_hash(s, w.bounds[short], w.bounds[short + 1]))
    best = best.reshape(n_docs, BINS)
    filled = best != _EMPTY
    d, b = np.nonzero(~filled & (n_words > 0)[:, None])
    for step in range(BINS):
        if not len(d):
            break
        to = _WALK[b, step]
        hit = filled[d, to]
        best[d[hit], b[hit]] = best[d[hit], to[hit]]
        d, b = d[~hit], b[~hit]
    return best, n_words


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in textvec.chunks(whole, 1):
            best, n_words = signatures(batch.column(1))
            rows = np.flatnonzero(n_words)
            best = best[rows]
            bands = np.zeros((len(rows), BANDS), np.uint64)
            for k in range(BANDS):
                for r in range(ROWS):
                    bands[:, k] += textvec.mix(best[:, k * ROWS + r].astype(np.uint64) + _ODD[k, r])
            bands = textvec.mix(bands * _ODD[:, 0] + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            # a byte of each bin is enough to verify a pair: unequal bins agree by chance once in 256
            byte = (textvec.mix(best.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel())),
                    pa.array([byte[i].tobytes() for i in range(len(rows))], pa.binary()),
                ],
                names=["id", "bands", "sig"],
            )


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    return ((x == y).mean(1) - 1 / 256) / (1 - 1 / 256) >= least


def _bytes(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, BINS)


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                same = _alike(_bytes(b.column(2)), _bytes(b.column(3)), least)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same)], names=["a", "b", "same"])

    return run


def star_out(ids: np.ndarray, sigs: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Stars of a bucket: the least id with all that are like it, then likewise the rest, until none is left."""
    order = np.argsort(ids, kind="stable")
    ids, sigs = ids[order], sigs[order]
    centre, member = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(ids) > 1:
        same = _alike(sigs[1:], sigs[:1], least)
        member.append(ids[1:][same])
        centre.append(np.full(int(same.sum()), ids[0]))
        ids, sigs = ids[1:][~same], sigs[1:][~same]
    return np.concatenate(centre), np.concatenate(member)


_REST = "a long, b long, bucket long, block int, blocks int, sig binary"


def _star_rest(least: float):
    """Edges (a, b) of a block, and, if its bucket has others, the members (b, a null) that no one before is like."""

    def run(t: pa.Table) -> pa.Table:
        ids, sigs = np.asarray(t.column("id").combine_chunks()), _bytes(t.column("sig"))
        a, b = star_out(ids, sigs, least)
        blocks = t.column("blocks")[0].as_py()
        alone = np.flatnonzero(~np.isin(ids, b)) if blocks > 1 else np.empty(0, np.int64)
        n, m = len(a), len(alone)
        return pa.table({
            "a": pa.array(np.append(a, np.zeros(m, np.int64)), pa.int64(), mask=np.arange(n + m) >= n), "b": pa.array(np.append(b, ids[alone]), pa.int64()),
            "bucket": pa.array(np.repeat(t.column("bucket")[0].as_py(), n + m), pa.int64()), "block": pa.array(np.repeat(t.column("block")[0].as_py(), n + m), pa.int32()),
            "blocks": pa.array(np.repeat(blocks, n + m), pa.int32()), "sig": pa.array([None] * n + [sigs[k].tobytes() for k in alone], pa.binary()),
        })

    return run


def _meet(least: float):
    """Edges between the centres of two blocks."""

    def run(t: pa.Table) -> pa.Table:
        ids, sigs, low = np.asarray(t.column("b").combine_chunks()), _bytes(t.column("sig")), np.asarray(t.column("lower"))
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        x, y = np.flatnonzero(low), np.flatnonzero(~low)
        for k in x if len(y) else ():
            like = ids[y[_alike(sigs[y], sigs[k : k + 1], least)]]
            a.append(np.minimum(like, ids[k]))
            b.append(np.maximum(like, ids[k]))
        return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, root): every id of ``edges`` (a, b) that isn't the least of its connected component, with that least id."""
    stars = common.cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        both = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # least neighbours are aggregated before they are shuffled, and joined, so that a star of any size is split
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select("a", "b", "m")
        after = small.select(F.col("m").alias("a"), "b").union(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        after = common.cut(after)
        # at rest every b has one a, and no a is a b
        if after.select("a").distinct().join(after.select(F.col("b").alias("a")), "a", "left_semi").isEmpty() and after.groupBy("b").count().where("count > 1").isEmpty():
            return after.select(F.col("b").alias("id"), F.col("a").alias("root"))
        stars = after


def near_duplicates(docs: DataFrame, *, least: float = 0.45, block: int = BLOCK) -> DataFrame:
    """(doc_id, kept_doc_id): every document to drop and the one of its group that stays, the least id.

    Two documents are near duplicates if their sets of word 3-grams have an estimated Jaccard similarity
    of ``least`` or more; ``block``: members of a bucket that one task holds; groups are the connected components of near duplicates. A text of one or two
    words has its whole as the only shingle. Defined cases: null, empty and wordless texts have no
    duplicates; rows with a null id are left alone; rows that repeat an id count as one document, which
    is compared by one of its texts; other columns play no part; an empty table gives an empty result.
    """
    slim = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sketch = common.cut(slim.mapInArrow(_sketch, "id long, bands array<long>, sig binary"))
    sigs = sketch.select("id", "sig")
    rows = sketch.select(F.explode("bands").alias("bucket"), "id")
    once = sigs.groupBy("id").agg(F.min("sig").alias("sig"))
    heads = rows.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre < last").drop("last")
    starred = common.cut(rows.join(heads, "bucket").where("id <> centre"))
    pairs = starred.select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    both = pairs.join(once.withColumnsRenamed({"id": "a", "sig": "x"}), "a").join(once.withColumnsRenamed({"id": "b", "sig": "y"}), "b")
    judged = common.cut(both.select("a", "b", "x", "y").mapInArrow(_verify(least), "a long, b long, same boolean"))
    failed = judged.where("not same").select(F.col("a").alias("centre"), F.col("b").alias("id"))
    rest = common.cut(starred.join(failed, ["centre", "id"], "left_semi").select("bucket", "id").distinct())
    sizes = rest.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = rest.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).join(once, "id")
    within = common.cut(placed.groupBy("bucket", "block").applyInArrow(_star_rest(least), _REST))
    centres = within.where("a IS NULL").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("other <> block")
    centres = centres.select("bucket", "b", "sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") < F.col("other")).alias("lower"))
    across = centres.groupBy("bucket", "i", "j").applyInArrow(_meet(least), "a long, b long")
    matched = judged.where("same").select("a", "b").union(within.where("a IS NOT NULL").select("a", "b")).union(across)
    return components(matched).select(F.col("id").alias("doc_id"), F.col("root").alias("kept_doc_id"))


def drop_near_duplicates(docs: DataFrame, **how: float) -> DataFrame:
    """``docs`` without the documents that ``near_duplicates`` names; all columns and all else stay."""
    gone = near_duplicates(docs, **how).select(F.col("doc_id").alias("__gone_id"))
    return docs.join(gone, F.col("doc_id") == F.col("__gone_id"), "left_anti")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


QUERIES = {"op5_minhash": op5_minhash}
ORACLES: dict[str, str] = {}
