"""Language-model scoring with a probabilistic suffix tree over words and bytes.

Symbols. A text is cut into words (runs of ASCII letters and digits and of bytes beyond ASCII) and what lies
between them; a single space is implied. The commonest words and separators of the corpus, a bounded number,
are symbols of their own; all others are spelled by their bytes. So the alphabet is bounded, no text is lost
and no script is merged. A text's start is one more symbol, the oldest of any context.

Tree. A context is a state if the symbols that follow it diverge from the distribution of the longest state
that ends it: the log of the Bayes factor between a distribution of its own, with a Dirichlet prior of
``weight`` around that state's, and that state's must reach ``critical``. A state's distribution is smoothed
towards that of the state below it by the same weight. A position is scored by its longest state. The length
of contexts and the number of states have no bound; both follow the corpus.

Execution. Nothing of the tree is gathered: it is made and used where its occurrences meet. Texts are packed
into blocks; each round, a block sends every open position's next few older symbols, equal ones merged and
counted, to the bucket of their context; a bucket tests all contexts of its positions and answers with each
one's probability and with which can still find a longer state. What follows a symbol that occurs more often than a task
may hold is counted beforehand, and the table of it goes to the buckets that share that symbol's longer contexts, so that
these are sent once like all others. Longer contexts of so many occurrences go on by one symbol a round, as merged counts
only; the others by as many as keep a round small. Rounds end when no context is left in whose counts a further state could
hide, which an exact bound on the Bayes factor tells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textvec

BITS, SPAN = 20, 5
SIZE, _MASK = 1 << BITS, (1 << BITS) - 1
START, BYTE, FIRST, WORD = 0, 1, 257, 513  # a byte within a spelled word, its first byte, the commonest words
PARTS = 2  # of the contexts, which the first round takes in turn, so that half of what it sends is on disk at once
LONGEST = 1 << 10  # symbols that a record may carry
BUCKET = 1 << 20  # occurrences that a bucket is meant to have
MOST = 1 << 21  # occurrences of a context that one task may hold
LARGE = (1 << 32) - 1  # occurrences are told up to this, far beyond what a task may hold
HELD = 1 << 18  # records of whole contexts that a bucket works on at a time
PIECE = 1 << 17  # bytes whose products are in memory at once
_AFTER = 1 << 2 * BITS
_U = np.uint64
_ZSTD = pa.Codec("zstd", compression_level=1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, or with rows of that length, as compressed planes of their bytes."""
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(*a.shape, a.itemsize).swapaxes(-1, -2).tobytes() for a in arrays)
    return arrays[0].shape[-1].to_bytes(4, "little") + _ZSTD.compress(raw, asbytes=True)


def unpack(blob: bytes, *kinds: type, wide: int = 0) -> list[np.ndarray]:
    """The arrays of ``kinds``, and last, if ``wide``, an int32 array of so many rows."""
    n, widths = int.from_bytes(blob[:4], "little"), [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(_ZSTD.decompress(blob[4:], n * (sum(widths) + 4 * wide)), np.uint8) if n else np.empty(0, np.uint8)
    out, at = [], 0
    for k, w in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).reshape(-1).view(k))
        at += n * w
    if wide:
        out.append(np.ascontiguousarray(raw[at:].reshape(wide, 4, n).swapaxes(1, 2)).reshape(wide, 4 * n).view(np.int32))
    return out


def segments(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, text, hash) of all words and separators but single spaces, in order."""
    data, off = textvec.text_bytes(texts)
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return data, none, none, none, none.astype(_U)
    edge = np.diff(textvec.is_word(data).view(np.int8), prepend=np.int8(2)) != 0
    edge[off[:-1][np.diff(off) > 0]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], n)
    h = np.empty(len(start), _U)
    cuts = np.unique(np.append(np.searchsorted(start, np.arange(0, n, PIECE)), len(start)))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        b, e = start[i], end[j - 1]
        value = (data[b:e].astype(_U) + _U(1)) * textvec.powers(textvec.BASE, e - b)
        h[i:j] = np.add.reduceat(value, start[i:j] - b) * textvec.powers(textvec.INV, e - b)[start[i:j] - b]
    h = textvec.mix(h)
    told = (end - start > 1) | (data[start] != 32)
    start, end, h = start[told], end[told], h[told]
    return data, start, end, np.searchsorted(off, start, side="right") - 1, h


def heads(known: np.ndarray) -> np.ndarray:
    """Where the hashes of each value of their first BITS bits begin among the sorted ``known``."""
    return np.searchsorted(known, np.arange(SIZE, dtype=_U) << _U(64 - BITS)).astype(np.int32)


def found_in(known: np.ndarray, head: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``known``, whether it is there) of each hash: few of them share their first bits."""
    if not len(known):
        return np.zeros(len(h), np.int32), np.zeros(len(h), bool)
    last = len(known) - 1
    at = np.minimum(head[(h >> _U(64 - BITS)).astype(np.int32)], last)
    there = known[at]
    hit = there == h
    more = np.flatnonzero((there < h) & (at < last))
    while len(more):
        at[more] += 1
        there = known[at[more]]
        hit[more] = there == h[more]
        more = more[(there < h[more]) & (at[more] < last)]
    return at, hit


def symbols(texts: pa.Array, known: np.ndarray, rank: np.ndarray, head: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, a START before each, and how many each has; ``known``: sorted hashes of the words that are symbols, ``head``: their ``heads``."""
    data, start, end, text, h = segments(texts)
    at, hit = found_in(known, heads(known) if head is None else head, h)
    size = np.where(hit, 1, end - start)
    n = np.bincount(text, size, len(texts)).astype(np.int64)
    out = np.zeros(int(n.sum()) + len(texts), np.int32)
    place = np.cumsum(size) - size + text + 1
    out[place[hit]] = WORD + rank[at[hit]]
    s, e, to = start[~hit], end[~hit], place[~hit]
    inner = np.arange((e - s).sum()) - np.repeat(np.cumsum(e - s) - (e - s), e - s)
    out[np.repeat(to, e - s) + inner] = data[np.repeat(s, e - s) + inner].astype(np.int32) + np.where(inner == 0, FIRST, BYTE)
    return out, n


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(first) else n


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts, held = [np.empty(0, _U)], [np.empty(0, np.int64)], 0

    def out() -> pa.RecordBatch:
        k, n = _merged(keys, counts)
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["word", "n"])

    for whole in batches:
        for b in textvec.chunks(whole, 0):
            k, n = np.unique(segments(b.column(0))[4], return_counts=True)
            keys.append(k)
            counts.append(n)
            held += len(k)
            if held > 1 << 20:
                k, n = _merged(keys, counts)
                keys, counts, held = [k], [n], len(k)
                if held > 1 << 19:
                    yield out()
                    keys, counts, held = [np.empty(0, _U)], [np.empty(0, np.int64)], 0
    yield out()


def dictionary(text: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and ranks by frequency of the words and separators that occur c times or more, c the least number above 1 that leaves at most ``most``."""
    counts = text.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = common.settle(counts.where("n > 1"), "words")
    # counts are told apart to about one part in 64, so that there are a few thousand levels at any size
    level = F.floor(F.log2(F.col("n").cast("double")) * 64)
    levels = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    left, least = most, None
    for r in levels:
        left -= r["count"]
        if left < 0:
            break
        least = r["level"]
    if least is None:
        return np.empty(0, _U), np.empty(0, np.int32)
    found = counts.where(level >= least).select("word", "n").toArrow().combine_chunks()
    word, n = (np.asarray(c.combine_chunks()).astype(np.int64) for c in found.columns)
    order = np.argsort(word.view(_U))
    word, n = word[order].view(_U), n[order]
    rank = np.empty(len(word), np.int32)
    rank[np.argsort(-n, kind="stable")] = np.arange(len(word))
    return word, rank


@dataclass
class Open:
    """Positions of a block that may have longer states: index, length of context so far, probability, occurrences of the context."""

    at: np.ndarray
    depth: np.ndarray
    p: np.ndarray
    n: np.ndarray

    def packed(self) -> bytes:
        return pack(np.diff(self.at.astype(np.int32), prepend=np.int32(0)), self.depth.astype(np.int32), self.p.astype(np.float32), self.n.astype(np.uint32))

    @classmethod
    def of(cls, blob: bytes) -> Open:
        at, *rest = unpack(blob, np.int32, np.int32, np.float32, np.uint32)
        return cls(np.cumsum(at, dtype=np.int32), *rest)


@dataclass
class Records:
    """What a block sends in a round: distinct records in order of bucket, and which record each open position has."""

    at: np.ndarray  # the open positions that it is about, and the length of their contexts so far
    depth: np.ndarray
    bucket: np.ndarray
    group: np.ndarray  # hash of the context so far
    older: np.ndarray  # a row for each of the symbols before it, latest first; but for the first zeros where the context is too common
    next: np.ndarray
    p: np.ndarray
    n: np.ndarray
    of: np.ndarray


@dataclass
class Places:
    """Where the first round sends a symbol's contexts: symbols in order of part and bucket, but for the common ones, which have buckets of their own."""

    place: np.ndarray  # of each symbol in that order; -1 if it is common
    bucket: np.ndarray  # of each place, odd
    edge: np.ndarray  # where the parts begin, and the end
    common: np.ndarray  # symbols that occur more often than one task may hold
    base: np.ndarray  # the first bucket of each, and the end: even, and even more by one for the contexts that stay with one task
    often: np.ndarray  # contexts of two symbols, the later one above the other, that don't stay with one task

    @classmethod
    def of(cls, counts: np.ndarray, left: int, size: int, parts: int, most: int, often: np.ndarray) -> Places:
        """``size``: occurrences that a bucket is meant to have of the ``left`` ones."""
        common, each = np.flatnonzero(counts > most), left / max(1, int(counts.sum())) / (size * parts)
        buckets = max(1, int(np.ceil(left / (size * parts) - each * counts[common].sum())))
        where = textvec.mix(textvec.mix(np.arange(SIZE, dtype=_U) + _U(1)))
        bucket = ((where & _U(0xFFFFFFFF)) % _U(buckets)).astype(np.int64) * 2 + 1
        part = ((where >> _U(32)) % _U(parts)).astype(np.int64)
        order = np.lexsort((bucket, part))
        place = np.empty(SIZE, np.int32)
        place[order] = np.arange(SIZE, dtype=np.int32)
        place[common] = -1
        base = np.cumsum(np.append(buckets, np.maximum(1, np.ceil(each * counts[common])).astype(np.int64))) * 2
        return cls(place, bucket[order].astype(np.int32), np.searchsorted(part[order], np.arange(parts + 1)), common, base, np.sort(often))

    def common_bucket(self, latest: np.ndarray, second: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, part) of the contexts ``second`` and then ``latest``, a common symbol."""
        i = np.searchsorted(self.common, latest)
        where = textvec.mix(((latest.astype(_U) << _U(BITS)) | second.astype(_U)) + _U(1))
        bucket = self.base[i] + 2 * ((where & _U(0xFFFFFFFF)) % ((self.base[i + 1] - self.base[i]) // 2).astype(_U)).astype(np.int64)
        deep = np.ones(len(latest), bool)
        if len(self.often):
            pair = (latest.astype(np.int64) << BITS) | second
            deep = (latest == START) | (self.often[np.minimum(np.searchsorted(self.often, pair), len(self.often) - 1)] != pair)
        return bucket + deep, ((where >> _U(32)) % _U(parts)).astype(np.int64)

    def symbol(self, bucket: int) -> int | None:
        """The common symbol that has the bucket for its own."""
        return int(self.common[np.searchsorted(self.base, bucket, side="right") - 1]) if bucket >= self.base[0] else None

    def width(self, bucket: int, span: int) -> int:
        """How many symbols a record of the bucket carries."""
        return (span - (bucket >= self.base[0])) if bucket & 1 else 1


def _counted(fresh: np.ndarray, order: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a position of each record, its count, the record of each position) from which of the positions in order begin records."""
    first = np.flatnonzero(fresh)
    of = np.empty(len(order), np.int32)
    of[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    return order[first], np.diff(np.append(first, len(order))) * weight, of


def first_records(sym: np.ndarray, places: Places, span: int, weight: int, part: tuple[int, int], whole: bool = True) -> Records:
    """Of the first round, where all contexts are empty; those of common symbols come last and carry that symbol last. Without ``whole`` only what tells which record is whose."""
    k, parts = part
    place = places.place[sym[:-1]]
    at = np.flatnonzero((place >= places.edge[k]) & (place < places.edge[k + 1]) & (sym[1:] != START)).astype(np.int32) + np.int32(1)
    hot = np.flatnonzero((place < 0) & (sym[1:] != START)).astype(np.int32) + np.int32(1)
    place = place[at - 1]
    got = [_first(sym, at, place, places.bucket[place].astype(np.int64), span, weight, whole, True)]
    if len(places.common):
        at = hot
        latest = sym[at - 1]
        # a text's first symbol has no longer context: what matters is that they are spread
        bucket, mine = places.common_bucket(latest, np.where(latest == START, sym[at], sym[np.maximum(at - 2, 0)]), parts)
        mine = np.flatnonzero(mine == k)
        r = _first(sym, at[mine], latest[mine], bucket[mine], span, weight, whole, False)
        r.older, r.of = [*r.older[1:], *r.older[:1]], r.of + np.int32(len(got[0].bucket))
        got.append(r)
    at, depth, bucket, group, next_, p, n, of = (np.concatenate([getattr(r, f) for r in got]) for f in ("at", "depth", "bucket", "group", "next", "p", "n", "of"))
    return Records(at, depth, bucket, group, np.array([np.concatenate(x) for x in zip(*(r.older for r in got), strict=True)]), next_, p, n, of)


def _first(sym: np.ndarray, at: np.ndarray, place: np.ndarray, bucket: np.ndarray, span: int, weight: int, whole: bool, in_order: bool) -> Records:
    """Of the positions ``at``, whose latest symbols have the places ``place``; ``in_order``: which are in order of bucket."""
    after, deep = sym[at], (bucket & 1).astype(np.int32)
    older = [sym[at - 1]]
    for j in range(1, span):
        older.append(np.where(older[-1] != START, sym[np.maximum(at - 1 - j, 0)], START))
        if j == 2 and not deep.all():
            older[2] *= deep
    high, low = older[1].astype(_U), after.astype(_U)
    for j in range(2, span):  # span is 5: two symbols fit beside another one
        if j < 4:
            high = (high << _U(BITS)) | older[j].astype(_U)
        else:
            low |= older[j].astype(_U) << _U((j - 3) * BITS)
    # one key to sort by: the place of the latest symbol, the one before it, and the rest shortened to what a word has left
    rest = (high * _U(textvec.BASE) ^ low) * _U(0xBF58476D1CE4E5B9)
    key = (place.astype(_U) << _U(64 - BITS)) | (older[1].astype(_U) << _U(64 - 2 * BITS)) | (rest >> _U(2 * BITS))
    order = np.argsort(key)  # equal records that other ones come between, which shortened keys allow, are sent twice
    if not in_order:
        order = order[np.argsort(bucket[order].astype(np.uint16 if bucket.max(initial=0) < 1 << 16 else np.int64), kind="stable")]
    fresh = np.ones(len(order), bool)
    fresh[1:] = False
    for k in (place, high, low):
        k = k[order]
        fresh[1:] |= k[1:] != k[:-1]
    one, n, of = _counted(fresh, order, weight)
    zero = np.zeros(len(at), np.int32)
    if not whole:
        return Records(at, zero, bucket[one], one[:0], [], after[:0], one[:0], one[:0], of)
    return Records(at, zero, bucket[one], one[:0], [k[one] for k in older], after[one], one[:0], n, of)


def records(sym: np.ndarray, state: Open, span: int, buckets: int, most: int, weight: int, part: tuple[int, int], whole: bool) -> Records:
    """Of later rounds. Without ``whole`` only what tells which record is whose.

    ``part``: (k, n), only those positions whose context is of the k-th of n parts.
    """
    at, begin = state.at.astype(np.int64), np.maximum.accumulate(np.where(sym == START, np.arange(len(sym)), 0))[state.at]
    end = at - state.depth  # where the context so far begins
    oldest = np.where(end - 1 > begin, sym[end - 1], START)
    sums = np.zeros(len(sym) + 1, _U)
    np.cumsum((sym.astype(_U) + _U(1)) * textvec.powers(textvec.BASE, len(sym)), dtype=_U, out=sums[1:])
    group = textvec.run_hash(sums, end, at)
    where = textvec.mix(group ^ textvec.mix(oldest.astype(_U) + _U(1)))
    if part[1] > 1:
        rows = np.flatnonzero((where >> _U(32)) % _U(part[1]) == _U(part[0]))
        at, begin, end, oldest, group, where = (x[rows] for x in (at, begin, end, oldest, group, where))
        state = Open(*(x[rows] for x in (state.at, state.depth, state.p, state.n)))
    after = sym[at]
    deep = state.n <= most
    bucket = (where & _U(0xFFFFFFFF)) % _U(buckets) * _U(2) + deep

    def older(these: np.ndarray) -> np.ndarray:
        last, first = (end[these] - 1).astype(np.int32), begin[these].astype(np.int32)
        found, step = np.empty((span, len(these)), np.int32), max(1, (1 << 20) // max(1, len(these)))
        for j in range(0, span, step):
            found[j : j + step] = sym[np.maximum(last - np.arange(j, min(span, j + step), dtype=np.int32)[:, None], first)]
        if not deep.all():
            found[1:] *= deep[these]
        return found

    sent = textvec.run_hash(sums, np.maximum(begin, end - np.where(deep, span, 1)), np.maximum(begin, end))
    high, low = textvec.mix(group ^ textvec.mix(sent)), after.astype(_U)
    key = (group & ~_U(0xFFFFFFFF)) | (textvec.mix(high ^ textvec.mix(low)) >> _U(32))
    order = np.argsort(key)
    order = order[np.argsort(bucket[order].astype(np.uint16), kind="stable")] if 2 * buckets < 1 << 16 else order[np.argsort(bucket[order], kind="stable")]
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([k[1:] != k[:-1] for k in (high[order], low[order], bucket[order])], axis=0)
    one, n, of = _counted(fresh, order, weight)
    if not whole:
        return Records(state.at, state.depth, bucket[one].astype(np.int64), group[:0], [], after[:0], state.p[:0], one[:0], of)
    return Records(state.at, state.depth, bucket[one].astype(np.int64), group[one], older(one), after[one], state.p[one], n, of)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 1, by Stirling's series beyond 9."""
    y = x + 8
    low = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - low


def _pure(c: np.ndarray, p: np.ndarray, weight: float) -> np.ndarray:
    """What ``c`` occurrences, two or more, of a symbol of probability ``p`` add to the log Bayes factor."""
    wp, log_p, rise = weight * p, np.log(p), np.empty(len(c))
    few, many = np.flatnonzero(c < 5), np.flatnonzero(c >= 5)
    x, k = wp[few], c[few]
    rise[few] = np.log((x + 1) * np.where(k > 2, x + 2, 1) * np.where(k > 3, x + 3, 1))
    rise[many] = _log_gamma(wp[many] + c[many]) - _log_gamma(wp[many] + 1)
    return np.log(weight) + rise - (c - 1) * log_p


def _norm(n: np.ndarray, weight: float) -> np.ndarray:
    """What ``n`` occurrences, one or more, in all take from it."""
    return np.log(weight) + _log_gamma(weight + n) - _log_gamma(np.array(weight + 1.0))


def tested(key: np.ndarray, n: np.ndarray, p: np.ndarray, critical: float, least: int, weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of each record, first record of each context, whether a longer one may be a state); ``key``: sorted, the context above the symbol after it."""
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.flatnonzero(fresh)
    new = np.concatenate([[True], (key[first][1:] >> _U(BITS)) != (key[first][:-1] >> _U(BITS))])
    of, c, q = np.cumsum(new) - 1, np.add.reduceat(n, first), p[first]
    total = np.add.reduceat(c, np.flatnonzero(new))
    often = np.flatnonzero(c > 1)
    gain = np.log(weight) * np.bincount(of[c == 1], minlength=len(total)) + np.bincount(of[often], _pure(c[often], q[often], weight), len(total))
    some = np.flatnonzero(total >= max(least, 1))
    state = np.zeros(len(total), bool)
    state[some] = gain[some] - _norm(total[some], weight) >= critical
    q = np.where(state[of], (c + weight * q) / (total[of] + weight), q)
    # a longer context has no more of any symbol, and its factor is at most the product of those that each symbol would have alone
    hope = np.bincount(of[often], _pure(c[often], q[often], weight) - _norm(c[often], weight), len(total))
    return q[np.cumsum(fresh) - 1], first[new], (hope >= critical) & (total > least)


def answers(group: np.ndarray | None, older: list[np.ndarray], after: np.ndarray, p: np.ndarray, n: np.ndarray, critical: float, least: int, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """(probability, occurrences of the last context if longer ones may be states, else 0) of each record of a bucket; ``group``: None where all contexts are empty."""
    p, open_ = p.astype(np.float32), np.zeros(len(after), np.uint32)
    at = np.zeros(len(after), _U)
    if group is not None:
        rows = np.argsort(group)
        at[rows[1:]] = np.cumsum(group[rows[1:]] != group[rows[:-1]]).astype(_U)
        del rows
    key = (at << _U(2 * BITS)) | (older[0].astype(_U) << _U(BITS)) | after.astype(_U)
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] >> _U(BITS)) != (key[:-1] >> _U(BITS))])) if len(key) else np.empty(0, np.int64)
    new = np.append(new[np.unique(np.searchsorted(new, np.arange(0, len(key), HELD)).clip(max=max(0, len(new) - 1)))], len(key))
    for i, j in zip(new[:-1], new[1:], strict=True):
        rows = order[i:j]
        p[rows], open_[rows] = _longer(key[i:j], rows, older, after[rows], p[rows].astype(float), n[rows].astype(np.int64), critical, least, weight)
    return p, open_


def _longer(key: np.ndarray, these: np.ndarray, older: list[np.ndarray], after: np.ndarray, p: np.ndarray, n: np.ndarray, critical: float, least: int, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """The same of ``these`` records, which are whole contexts; ``key``: sorted, those contexts with the oldest symbol above the symbol after them."""
    p, first, alive = tested(key, n, p, critical, least, weight)
    alive &= (key[first] >> _U(BITS)) & _U(_MASK) != START
    size = np.diff(np.append(first, len(key)))
    rows = np.flatnonzero(np.repeat(alive, size))
    at = np.repeat(np.arange(len(first)), size)[rows]
    open_ = np.zeros(len(key), np.uint32)
    changed = True
    for column in older[1:]:
        if not len(rows):
            break
        if changed:
            new = np.concatenate([[True], at[1:] != at[:-1]])
            head, at, which = np.flatnonzero(new), np.cumsum(new) - 1, these[rows]
        symbol = column[which]
        low = np.minimum.reduceat(symbol, head)
        split = low != np.maximum.reduceat(symbol, head)
        # contexts all of whose occurrences go on alike are no other than the shorter one; beyond a text's start is nothing
        changed = bool(split.any()) or 4 * np.count_nonzero(low == START) > len(low)
        if not changed:
            continue
        stays = (~split & (low != START))[at]
        r = np.flatnonzero(split[at])
        if len(r):
            key = (at[r].astype(_U) << _U(2 * BITS)) | (symbol[r].astype(_U) << _U(BITS)) | after[rows[r]].astype(_U)
            order = np.argsort(key)
            r, key = r[order], key[order]
            p[rows[r]], first, alive = tested(key, n[rows[r]], p[rows[r]], critical, least, weight)
            alive &= symbol[r[first]] != START
            size = np.diff(np.append(first, len(r)))
            go = np.repeat(alive, size)
            at = np.concatenate([at[stays], np.repeat(np.arange(len(first)), size)[go] + len(head)])
            rows = np.concatenate([rows[stays], rows[r[go]]])
        else:
            rows, at = rows[stays], at[stays]
    goes = older[-1][these[rows]] != START
    rows, at = rows[goes], at[goes]
    if len(rows):
        head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        total = np.minimum(np.add.reduceat(n[rows], head), LARGE)
        open_[rows] = np.repeat(total, np.diff(np.append(head, len(rows)))).astype(np.uint32)
    return p.astype(np.float32), open_


def _pack_blocks(known, weight: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, head = TaskContext.get().partitionId(), 0, heads(known.value[0])
        for whole in batches:
            for b in textvec.chunks(whole, 1, 4 << 20):
                sym, n = symbols(b.column(1), *known.value, head)
                block = (weight << 62) | (part << 32) | at
                at += 1
                ids = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), b.column(0).cast(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([weight], pa.int32()), ids, pa.array([pack(n)], pa.binary()), pa.array([pack(np.zeros(len(n)))], pa.binary()), pa.array([pack(np.arange(len(n), dtype=np.int32))], pa.binary()), pa.array([pack(sym)], pa.binary()), pa.nulls(1, pa.binary()), pa.array([len(sym) - len(n)], pa.int64())],
                    names=["block", "weight", "ids", "n", "bits", "kept", "sym", "open", "left"],
                )

    return run


_BLOCK = "block long, weight int, ids array<long>, n binary, bits binary, kept binary, sym binary, open binary, left long"


def _symbol_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(SIZE, np.int64)
    for b in batches:
        for blob in b.column(0).to_pylist():
            n += np.bincount(unpack(blob, np.int32)[0], minlength=SIZE)
    s = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(n[s])], names=["s", "n"])


def _pair_counts(hot):
    """Of the common symbols: occurrences with each symbol before them, and, a bit above, with each symbol after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        is_common = np.zeros(SIZE, bool)
        is_common[hot.value] = True

        def out() -> pa.RecordBatch:
            k, n = _merged(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], names=["pair", "n"])

        for b in batches:
            for blob in b.column(0).to_pylist():
                (sym,) = unpack(blob, np.int32)
                i = np.flatnonzero(is_common[sym[:-1]] & (sym[1:] != START))
                latest = sym[i].astype(np.int64) << BITS
                for pair in (latest | np.where(sym[i] != START, sym[np.maximum(i - 1, 0)], START), latest | sym[i + 1] | _AFTER):
                    k, n = np.unique(pair, return_counts=True)
                    keys.append(k)
                    counts.append(n)
                    held += len(k)
                if held > 1 << 22:
                    yield out()
                    keys, counts, held = [keys[0][:0]], [counts[0][:0]], 0
        yield out()

    return run


def _followers(root_p, critical: float, least: int, weight: float):
    """(symbol, blob) of a common symbol: the probability of each symbol that follows it, and, at START, what any other one's is multiplied by."""

    def run(t: pa.Table) -> pa.Table:
        pair, n = (np.asarray(t.column(c).combine_chunks()).astype(np.int64) for c in ("pair", "n"))
        order = np.argsort(pair)
        after, n = np.append(START, (pair & _MASK)[order]).astype(np.int32), np.append(0, n[order])
        q = root_p.value[after].astype(float)
        q[0] = 1
        p = tested(after.astype(_U), n, q, critical, least, weight)[0]
        return pa.table({"symbol": t.column("symbol").slice(0, 1), "blob": pa.array([pack(after, p.astype(np.float32))], pa.binary())})

    return run


def score(
    docs: DataFrame, train: DataFrame | None = None, *, words: int = SIZE - WORD, critical: float = 5.0, least: int = 2, weight: float = 1.0, most: int = MOST
) -> DataFrame:
    """(doc_id, n_symbols, bits_per_symbol) of every document under the tree of ``train``, by default of ``docs`` itself.

    ``words``: bound of the words and separators that are symbols; ``critical``: of the log Bayes factor, above 1;
    ``least``: occurrences of a state; ``weight``: of the state below in counts; ``most``: occurrences of a context
    beyond which it goes on by one symbol a round (no result depends on it). Bits are rounded to 4 places. Defined
    cases: null and empty texts, and those of single spaces alone, have 0 symbols and null bits; null ids and repeated rows are
    scored as rows of their own; other columns play no part; an empty table gives an empty result.
    """
    sc = docs.sparkSession.sparkContext

    def slim(df: DataFrame) -> DataFrame:
        return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    learn = slim(docs if train is None else train)
    known = sc.broadcast(dictionary(learn.select("text"), words))
    blocks = learn.mapInArrow(_pack_blocks(known, 1), _BLOCK)
    if train is not None:
        blocks = blocks.union(slim(docs).mapInArrow(_pack_blocks(known, 0), _BLOCK))
    blocks = common.settle(blocks, "blocks")
    counts = np.zeros(SIZE, np.int64)
    found = blocks.where("weight = 1").select("sym").mapInArrow(_symbol_counts, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).toArrow()
    counts[np.asarray(found.column(0).combine_chunks()).astype(np.int64)] = np.asarray(found.column(1).combine_chunks()).astype(np.int64)
    tokens = counts.copy()
    tokens[START] = 0
    root_p = ((tokens + 1) / (tokens.sum() + SIZE)).astype(np.float32)
    total = left = int(tokens.sum()) if train is None else int(blocks.agg(F.sum("left")).first()[0] or 0)
    first, span, parts = True, SPAN, PARTS
    often, tables, root_p = np.empty(0, np.int64), None, sc.broadcast(root_p)
    if left and (counts > most).any():
        pairs = blocks.where("weight = 1").select("sym").mapInArrow(_pair_counts(sc.broadcast(np.flatnonzero(counts > most))), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        pairs = common.settle(pairs.where((F.col("pair") >= _AFTER) | (F.col("n") > most)), "pairs")
        often = np.asarray(pairs.where(F.col("pair") < _AFTER).select("pair").toArrow().column(0).combine_chunks()).astype(np.int64)  # no more than occurrences over ``most``
        after = pairs.where(F.col("pair") >= _AFTER).withColumn("symbol", F.shiftright("pair", BITS).bitwiseAND(_MASK))
        tables = common.settle(after.groupBy("symbol").applyInArrow(_followers(root_p, critical, least, weight), "symbol long, blob binary"), "tables")
        common.release(tables, pairs)
    places = sc.broadcast(Places.of(counts, left, min(most, BUCKET), parts, most, often))
    while left:
        if not first:  # a fourth of the symbols of the first round
            span = max(SPAN, min(LONGEST, SPAN * total // (4 * left)))
        parts = -(-PARTS * left // total)
        small = not first and 4 * left < total  # so that a copy of all that is open doesn't count for the disk
        found = []
        for k in range(parts):
            buckets = max(1, -(-left * span // (min(most, BUCKET) * SPAN * parts)))
            found.append(_answered(blocks, (places, root_p) if first else None, tables, span, buckets, (k, parts), most, critical, least, weight, small))
            common.release(blocks)
        was, blocks = blocks, found.pop() if small else _updated(blocks, found)
        left, first = int(blocks.agg(F.sum("left")).first()[0] or 0), False
        common.release(blocks, was, *found, *([] if tables is None else [tables]))
        tables = None
    return (blocks if train is None else blocks.where("weight = 0")).select("ids", "n", "bits").mapInArrow(_results, "doc_id long, n_symbols long, bits_per_symbol double")


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            (n,), (bits,) = unpack(b.column(1)[i].as_py(), np.int64), unpack(b.column(2)[i].as_py(), np.float64)
            mean = np.where(n > 0, np.round(bits / np.maximum(n, 1), 4) + 0.0, 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1).flatten(), pa.array(n), pa.array(mean, mask=n == 0)], names=["doc_id", "n_symbols", "bits_per_symbol"])


def _answered(blocks: DataFrame, places, tables: DataFrame | None, span: int, buckets: int, part: tuple[int, int], most: int, critical: float, least: int, weight: float, at_once: bool = False) -> DataFrame:
    """(block, bits, open) after a part of a round: what it adds to the bits of each text, and the positions that stay open; ``places``: with the root's probabilities, in the first round; ``tables``: of what follows common symbols.

    ``at_once``: the blocks after a round of a single part instead.
    """
    first = places is not None

    def sent(b: pa.RecordBatch | pa.Table, i: int, whole: bool = True) -> Records:
        (sym,) = unpack(b.column("sym")[i].as_py(), np.int32)
        w = b.column("weight")[i].as_py()
        if first:
            return first_records(sym, places[0].value, span, w, part, whole)
        return records(sym, Open.of(b.column("open")[i].as_py()), span, buckets, most, w, part, whole)

    def width(bucket: int) -> int:
        return places[0].value.width(bucket, span) if first else span if bucket & 1 else 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = sent(b, i)
                edge = np.flatnonzero(np.diff(r.bucket, prepend=-1, append=-1))
                blobs = []
                for s, e in zip(edge[:-1], edge[1:], strict=True):
                    known = () if first else (np.diff(r.group[s:e], prepend=_U(0)), r.p[s:e])
                    blobs.append(pack(r.next[s:e], r.n[s:e].astype(np.uint32), *known, r.older[: width(int(r.bucket[s])), s:e]))
                block = pa.array(np.full(len(blobs), b.column("block")[i].as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(r.bucket[edge[:-1]]), block, pa.array(blobs, pa.binary())], names=["bucket", "block", "blob"])

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tables to the buckets of their symbols, as of block -1."""
        where = places[0].value
        for b in batches:
            for symbol, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                i = int(np.searchsorted(where.common, symbol))
                pairs = where.often[where.often >> BITS == symbol]
                some, of = where.common_bucket(pairs >> BITS, pairs & _MASK, part[1])
                to = np.union1d(np.arange(where.base[i] + 1, where.base[i + 1], 2), some[of == part[0]])
                for bucket in to.tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([-1], pa.int64()), pa.array([blob], pa.binary())], names=["bucket", "block", "blob"])

    def answer(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        symbol = places[0].value.symbol(bucket) if first else None
        if first:
            prior = places[1].value
            if symbol is not None:
                sent_by = np.asarray(t.column("block").combine_chunks())
                follow, p = unpack(t.column("blob")[int(np.flatnonzero(sent_by < 0)[0])].as_py(), np.int32, np.float32)
                prior = (prior * float(p[0])).astype(np.float32)
                prior[follow[1:]] = p[1:]
                t = t.take(pa.array(np.flatnonzero(sent_by >= 0)))
                if not t.num_rows:
                    return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "answer": pa.array([], pa.binary())})
        kinds = [np.int32, np.uint32, *(() if first else (_U, np.float32))]
        blobs, wide = t.column("blob").to_pylist(), width(bucket)
        ends = np.cumsum([int.from_bytes(blob[:4], "little") for blob in blobs])
        columns, older = [np.empty(ends[-1], k) for k in kinds], np.empty((wide, ends[-1]), np.int32)
        for blob, s, e in zip(blobs, np.append(0, ends[:-1]), ends, strict=True):
            *some, older[:, s:e] = unpack(blob, *kinds, wide=wide)
            if not first:
                some[2] = np.cumsum(some[2], dtype=_U)
            for column, x in zip(columns, some, strict=True):
                column[s:e] = x
        after, n, *more = columns
        group, p = (None, prior[after]) if first else more
        blocks_of, buckets_of = t.column("block"), t.column("bucket")
        del columns, more, blobs, t
        if symbol == START:  # nothing is older
            n = np.zeros(len(n), np.uint32)
        else:
            p, n = answers(group, older, after, p, n, critical, least, weight)
        blobs = [pack(p[s:e], n[s:e]) for s, e in zip(np.append(0, ends[:-1]), ends, strict=True)]
        return pa.table({"block": blocks_of, "bucket": buckets_of, "answer": pa.array(blobs, pa.binary())})

    def take(block: pa.Table, got: pa.Table) -> pa.Table:
        names = ["block", "bits", "open"]
        if not got.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.binary())], names=names)
        r = sent(block, 0, False)
        parts = [unpack(x, np.float32, np.uint32) for x in got.sort_by("bucket").column("answer").to_pylist()]
        p, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        cost, go = -np.log2(p.astype(float)), n > 0
        (size,), (kept,) = unpack(block.column("n")[0].as_py(), np.int64), unpack(block.column("kept")[0].as_py(), np.int32)
        open_ = go[r.of]
        over = np.flatnonzero(~open_)
        text = np.repeat(kept, size[kept] + 1)[r.at[over]]
        bits = np.bincount(text, cost[r.of[over]], len(size))
        rows = np.flatnonzero(open_)
        of = r.of[rows]
        left = Open(r.at[rows], r.depth[rows] + np.where(r.bucket[of] & 1, span, 2 if first else 1), p[of], n[of])
        return pa.table([block.column("block"), pa.array([pack(bits)], pa.binary()), pa.array([left.packed()], pa.binary())], names=names)

    live = blocks.where("left > 0")
    slim = live.select("block", "weight", "sym", "open", "n", "kept")
    replies = slim.mapInArrow(send, "bucket long, block long, blob binary")
    if first and tables is not None:
        replies = replies.union(tables.mapInArrow(ship, "bucket long, block long, blob binary"))
    # what was sent is off the disk before blocks are moved
    replies = common.settle(replies.groupBy("bucket").applyInArrow(answer, "block long, bucket long, answer binary"), "replies")
    if at_once:
        over = blocks.where("left = 0")
        done = common.settle(live.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lambda block, got: _joined(block, take(block, got)), _BLOCK).union(over), "blocks")
    else:
        done = common.settle(slim.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(take, "block long, bits binary, open binary"), "found")
    common.release(done, replies)
    return done


def _joined(block: pa.Table, got: pa.Table) -> pa.Table:
    """A block with what the parts of a round found."""
    bits = unpack(block.column("bits")[0].as_py(), np.float64)[0] + sum(unpack(b, np.float64)[0] for b in got.column("bits").to_pylist())
    opens = [Open.of(b) for b in got.column("open").to_pylist()]
    order = np.argsort(np.concatenate([o.at for o in opens])) if opens else None
    opens = Open(*(np.concatenate([getattr(o, f) for o in opens])[order] for f in ("at", "depth", "p", "n"))) if opens else None
    left = len(opens.at) if opens else 0
    made = {"bits": pack(bits), "kept": block.column("kept")[0].as_py(), "sym": block.column("sym")[0].as_py() if left else None, "open": opens.packed() if left else None}
    if left:
        (kept,), (sym,) = unpack(made["kept"], np.int32), unpack(made["sym"], np.int32)
        size = unpack(block.column("n")[0].as_py(), np.int64)[0][kept] + 1
        texts = np.unique(np.searchsorted(np.cumsum(size), opens.at, side="right"))
        if 2 * size[texts].sum() < len(sym):  # texts without open positions are left behind
            stay = np.repeat(np.isin(np.arange(len(kept)), texts), size)
            opens.at = opens.at - np.cumsum(~stay)[opens.at]
            made |= {"kept": pack(kept[texts]), "sym": pack(sym[stay]), "open": opens.packed()}
    for name, value in made.items():
        block = block.set_column(block.column_names.index(name), name, pa.array([value], pa.binary()))
    return block.set_column(block.column_names.index("left"), "left", pa.array([left], pa.int64()))


def _updated(blocks: DataFrame, found: list[DataFrame]) -> DataFrame:
    """Blocks after all parts of a round, settled; those without open positions need their symbols no more."""

    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    return common.settle(blocks.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(_joined, _BLOCK), "blocks")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))


QUERIES = {"op8_lm_scoring": op8_lm_scoring}
ORACLES: dict[str, str] = {}
