"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

Document frequencies of all word 3-grams of the test items are counted over the whole corpus. Seeds are
the 3-grams that are rare in it, and in any case the rarer half of each item's, so that an item that has
leaked into many documents keeps seeds too. Where a document holds a seed, the passage around it, as wide
as the item and half as much on both sides, is aligned with the item by words (match 2, mismatch and gap
-1). The best score as a share of a perfect match decides. The item set is taken in parts of bounded
size, so that what is sent to the tasks doesn't grow with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textvec

SEED = 3
MATCH, MISS, GAP = 2, -1, -1


@dataclass
class Items:
    """Test items as word hashes, and a sorted table of their 3-grams."""

    ids: np.ndarray
    words: np.ndarray
    bounds: np.ndarray
    grams: np.ndarray  # distinct, sorted
    at_gram: np.ndarray  # of every occurrence, sorted by gram: index in grams
    at_item: np.ndarray
    at_pos: np.ndarray

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` of known 3-grams, and which they are; a bitmap settles most."""
        bits = np.zeros(1 << 20, bool)
        bits[(self.grams >> np.uint64(44)).astype(np.int64)] = True
        maybe = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.grams, h[maybe])
        at[at == len(self.grams)] = 0
        real = self.grams[at] == h[maybe] if len(self.grams) else np.zeros(len(maybe), bool)
        return maybe[real], at[real]


def items_of(ids: list[int], texts: list[str]) -> Items:
    w = textvec.words(pa.array(texts, pa.string()))
    ok = w.inside(SEED)
    pos = np.flatnonzero(ok)
    h, item = w.gram(SEED)[ok], w.doc[: len(ok)][ok]
    grams, which = np.unique(h, return_inverse=True)
    order = np.argsort(which, kind="stable")
    return Items(np.array(ids, np.int64), w.hash, w.bounds, grams, which[order], item[order], (pos - w.bounds[item])[order])


def _counter(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs = np.zeros(len(items.grams), np.int64), 0
        for whole in batches:
            n_docs += whole.num_rows
            for batch in textvec.chunks(whole, 1):
                w = textvec.words(batch.column(1))
                pos, gram = items.lookup(w.gram(SEED))
                ok = w.inside(SEED)[pos]
                pair = np.unique(w.doc[pos[ok]] * len(items.grams) + gram[ok])
                np.add.at(df, pair % max(1, len(items.grams)), 1)
        seen = np.flatnonzero(df)
        # the number of documents goes by the name of gram -1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int64()), pa.array(np.append(df[seen], n_docs), pa.int64())], names=["gram", "df"])

    return run


def rare_seeds(items: Items, df: np.ndarray, common_df: float) -> np.ndarray:
    """For each occurrence in the item table whether it is a seed: of a df up to ``common_df``, or in the rarer half of its item's (ties: the earlier)."""
    order = np.lexsort((items.at_pos, df[items.at_gram], items.at_item))
    item = items.at_item[order]
    rank = np.arange(len(order)) - np.searchsorted(item, item, side="left")
    size = np.bincount(item, minlength=len(items.ids))[item]
    seed = np.empty(len(order), bool)
    seed[order] = rank < (size + 1) // 2
    return seed | (df[items.at_gram] <= common_df)


def smith_waterman(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best local scores of the rows of ``a`` against those of ``b`` (word hashes; 0 pads and never matches)."""
    n, wide = b.shape
    slope = -GAP * np.arange(1, wide + 1, dtype=np.int32)
    h = np.zeros((n, wide + 1), np.int32)
    best = np.zeros(n, np.int32)
    for i in range(a.shape[1]):
        equal = (b == a[:, i : i + 1]) & (b != 0)
        now = np.maximum(h[:, :-1] + np.where(equal, np.int32(MATCH), np.int32(MISS)), h[:, 1:] + np.int32(GAP))
        np.maximum(now, 0, out=now)
        # gaps along the row: a running maximum after the slope is taken out
        h[:, 1:] = np.maximum.accumulate(now + slope, axis=1) - slope
        np.maximum(best, h.max(1), out=best)
    return best


def align(doc: np.ndarray, bounds: np.ndarray, items: Items, seeds: np.ndarray, d: np.ndarray, p: np.ndarray, g: np.ndarray):
    """(text, item, score) of every passage around the seed hits (text d, word p, 3-gram g), best per pair first."""
    lo = np.searchsorted(items.at_gram, g, side="left")
    n = np.searchsorted(items.at_gram, g, side="right") - lo
    hit = np.repeat(np.arange(len(g)), n)
    occ = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    keep = seeds[occ]
    hit, occ = hit[keep], occ[keep]
    item = items.at_item[occ]
    size = np.diff(items.bounds)[item]
    # nearby diagonals share a passage: it begins at a multiple of half the item's length
    half = np.maximum(1, size // 2)
    block = (p[hit] - items.at_pos[occ]) // half
    tasks = np.unique(np.stack([d[hit], item, block]), axis=1)
    td, ti, tb = tasks
    size = np.diff(items.bounds)[ti]
    half = np.maximum(1, size // 2)
    begin = np.maximum(0, tb * half - half)
    end = np.minimum(np.diff(bounds)[td], tb * half + half + size + half)
    score = np.zeros(len(td))
    by_size = np.argsort(size, kind="stable")
    for part in np.array_split(by_size, max(1, -(-int(size.sum() * 3) // 400_000))) if len(by_size) else []:
        if not len(part):
            continue
        rows, cols = int(size[part].max()), int((end - begin)[part].max())
        i, j = np.arange(rows), np.arange(cols)
        a = np.where(i < size[part, None], items.words[np.minimum(items.bounds[ti[part], None] + i, len(items.words) - 1)], 0)
        b = np.where(j < (end - begin)[part, None], doc[np.minimum(bounds[td[part], None] + begin[part, None] + j, len(doc) - 1)], 0)
        score[part] = smith_waterman(a, b) / (MATCH * size[part])
    return td, ti, score


def _aligner(items: Items, seeds: np.ndarray, least: float):
    is_seed = np.zeros(len(items.grams), bool)
    is_seed[items.at_gram[seeds]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textvec.chunks(whole, 1):
                w = textvec.words(batch.column(1))
                pos, gram = items.lookup(w.gram(SEED))
                ok = w.inside(SEED)[pos] & is_seed[gram]
                pos, gram = pos[ok], gram[ok]
                d = w.doc[pos]
                td, ti, score = align(w.hash, w.bounds, items, seeds, d, pos - w.bounds[d], gram)
                bad = np.flatnonzero(score >= least)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(td[bad])), pa.array(items.ids[ti[bad]]), pa.array(score[bad])], names=["doc_id", "item_id", "score"]
                )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.5, rare: float = 0.001, part_chars: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, score): the documents that hold a copy of a test item, exact or edited.

    A 3-gram in at most a share ``rare`` of the documents, or in at most 10, counts as rare.

    ``score`` is the best local alignment's share of the item's perfect score, rounded to 4 places, and is
    ``least`` or more. Defined cases: null and empty texts on either side match nothing, nor do items of
    fewer than 3 words; rows with a null id are left alone; rows that repeat a document's id are judged
    together, the best score counts; items that repeat an id likewise; other columns play no part; an
    empty table on either side gives an empty result.
    """
    slim = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    given = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    chars = given.agg(F.sum(F.char_length("text"))).first()[0] or 0
    parts = max(1, -(-chars // part_chars))
    found: DataFrame | None = None
    for k in range(parts):
        rows = given.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).orderBy("item_id", "text").toArrow()
        items = items_of(*(c.to_pylist() for c in rows.columns))
        df = np.zeros(len(items.grams) + 1, np.int64)
        counted = slim.mapInArrow(_counter(items), "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))
        counts = counted.toArrow()  # no more rows than the part of the items has 3-grams
        gram, n = (np.asarray(c.combine_chunks()).astype(np.int64) for c in counts.columns)
        df[gram] = n
        seeds = rare_seeds(items, df[:-1], max(10.0, rare * df[-1]))
        hits = slim.mapInArrow(_aligner(items, seeds, least), "doc_id long, item_id long, score double")
        found = hits if found is None else found.union(hits)
    return found.groupBy("doc_id", "item_id").agg(F.round(F.max("score"), 4).alias("score"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how: float) -> DataFrame:
    """``docs`` without the documents that ``contaminated`` names; all columns and all else stay."""
    gone = contaminated(docs, benchmark, **how).select(F.col("doc_id").alias("__gone_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone_id"), "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontamination": op1_decontamination}
ORACLES: dict[str, str] = {}
