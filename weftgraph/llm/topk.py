"""Exact top-k search by cosine: tiled matrix products, partial selection per tile, tree merging.

Vectors stay where they are; queries are sent to them in parts of bounded size. A task takes its vectors
``tile`` at a time: the score matrix with the queries is made strip by strip in single precision, a
partition of every row finds the k-th best, and whatever reaches it within the rounding error is scored again in
double precision. A task keeps one list a query; the lists of all tasks are then merged level by level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARGIN = 4e-5  # more than twice the error of a single-precision product of unit vectors, plus the rounding of scores


def select_tile(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, strip_cells: int = 1 << 22):
    """For unit rows ``q`` and ``x``: (row of q, id, score) of each row's k best by score, then id; never itself."""
    q32, x32 = q.astype(np.float32), x.astype(np.float32).T
    rows, ids, scores = [], [], []
    strip = max(1, strip_cells // max(1, len(x)))
    for at in range(0, len(q), strip):
        s = q32[at : at + strip] @ x32
        s[qid[at : at + strip, None] == xid[None, :]] = -2
        if s.shape[1] > k:
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            r, c = np.nonzero(s >= (least - MARGIN)[:, None])
        else:
            r, c = (g.ravel() for g in np.indices(s.shape))
        r, c = r[ok := s[r, c] > -1.5], c[ok]
        exact = np.empty(len(r))
        for a in range(0, len(r), 1 << 16):
            exact[a : a + (1 << 16)] = np.einsum("ij,ij->i", q[at + r[a : a + (1 << 16)]], x[c[a : a + (1 << 16)]])
        exact = np.round(exact, 6) + 0.0
        order = np.lexsort((xid[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        first = np.searchsorted(r, r, side="left")
        keep = np.arange(len(r)) - first < k
        rows.append(at + r[keep])
        ids.append(xid[c[keep]])
        scores.append(exact[keep])
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(scores)


def _matrix(vectors: pa.ListArray, dim: int) -> np.ndarray:
    m = np.asarray(vectors.flatten()).astype(np.float64).reshape(-1, dim)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


class Best:
    """The k best (score, id) of every query so far, best first; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.neg, self.ids = k, np.full((n, k), np.inf), np.zeros((n, k), np.int64)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``rows`` ascend, with at most k entries each."""
        at = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        some, which = np.unique(rows, return_inverse=True)
        neg, other = np.full((len(some), self.k), np.inf), np.zeros((len(some), self.k), np.int64)
        neg[which, at], other[which, at] = -scores, ids
        neg, other = np.concatenate([self.neg[some], neg], 1), np.concatenate([self.ids[some], other], 1)
        by_id = np.argsort(other, axis=1, kind="stable")
        neg, other = np.take_along_axis(neg, by_id, 1), np.take_along_axis(other, by_id, 1)
        order = np.argsort(neg, axis=1, kind="stable")[:, : self.k]
        self.neg[some], self.ids[some] = np.take_along_axis(neg, order, 1), np.take_along_axis(other, order, 1)

    def lists(self) -> pa.ListArray:
        there = self.neg < np.inf
        offsets = np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(self.neg[there]), pa.array(self.ids[there])], ["neg", "id"]))


def _searcher(shared, k: int, dim: int, tile: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = shared.value
        best, held, n = Best(len(qid), k), [], 0

        def flush() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            xid, x = np.asarray(t.column(0).combine_chunks()), _matrix(t.column(1).combine_chunks(), dim)
            for at in range(0, len(xid), tile):
                best.add(*select_tile(q, qid, x[at : at + tile], xid[at : at + tile], k))

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= tile:
                flush()
                held, n = [], 0
        if held:
            flush()
        part = pa.array(np.full(len(qid), TaskContext.get().partitionId(), np.int32))
        lists = best.lists()
        for at in range(0, len(qid), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(qid[at : at + 4096]), part[at : at + 4096], lists[at : at + 4096]], names=["vec_id", "s", "best"])

    return search


def top_k(vectors: DataFrame, k: int = 10, *, queries: Column | None = None, dim: int = 64, tile: int = 16_384, asked: int = 65_536, fan_in: int = 16) -> DataFrame:
    """(vec_id, rank, neighbor_id, score): every vector's k nearest others by cosine, rounded to 6 places.

    ``queries``: which vectors to ask for, by default all; ``asked``: queries that are sent at once. Ties go to the
    smaller id. Defined cases: rows with a null id, or an embedding that is null, zero,
    not of ``dim`` numbers, or holds a null or non-finite number, are neither query nor answer; of rows
    that repeat an id the least embedding counts; with fewer than k others all of them are listed;
    other columns are dropped; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    vec = F.col("embedding")
    clean = (
        vectors.where(F.col("vec_id").isNotNull() & (F.size(vec) == dim))
        .where(F.forall(vec, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf")))) & F.exists(vec, lambda v: v != 0))
        .groupBy(F.col("vec_id").cast("long").alias("vec_id"))
        .agg(F.min(vec).alias("embedding"))
    )
    clean = common.settle(clean, "vectors")
    wanted = clean if queries is None else clean.where(queries)
    parts = max(1, math.ceil(wanted.count() / asked))
    lists: DataFrame | None = None
    for part in range(parts):
        t = wanted.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).orderBy("vec_id").toArrow().combine_chunks()
        if not t.num_rows:
            continue
        shared = spark.sparkContext.broadcast((np.asarray(t.column(0).combine_chunks()).astype(np.int64), _matrix(t.column(1).combine_chunks(), dim)))
        found = clean.mapInArrow(_searcher(shared, k, dim, tile), "vec_id long, s int, best array<struct<neg:double,id:long>>")
        lists = found if lists is None else lists.union(found)
    if lists is None:
        return spark.createDataFrame([], "vec_id long, rank int, neighbor_id long, score double")
    blocks = max(2, clean.rdd.getNumPartitions() * parts)
    while blocks > 1:
        lists = lists.groupBy("vec_id", F.floor(F.col("s") / fan_in).cast("int").alias("s")).agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        blocks = math.ceil(blocks / fan_in)
    found = lists.select("vec_id", F.posexplode("best").alias("rank", "b"))
    return found.select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias("neighbor_id"), (F.lit(0.0) - F.col("b.neg")).alias("score"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50, against all vectors."""
    return top_k(common.table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, min(embedding)::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64 GROUP BY vec_id),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE list_dot_product(e, e) > 0),
p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_dot_product(a.e, b.e) / (a.norm * b.norm), 6) + 0.0 AS score FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_id)::INTEGER AS rank FROM p)
SELECT vec_id, rank, neighbor_id, score FROM r WHERE rank <= 10"""

QUERIES = {"op3_topk": op3_topk}
ORACLES = {"op3_topk": ORACLE}
