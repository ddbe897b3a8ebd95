"""Toxicity: gradient-boosted trees over dense features of the text, calibrated by isotonic regression.

A bounded sample of labelled documents is cut into three parts by a hash of the id. The first gives the
lexicon: words and word beginnings that toxic documents hold far more often than clean ones. The second
trains the trees on dense features (lexicon densities, nearness to second-person words, rates of capitals,
punctuation and obfuscation), the third calibrates their scores. Every document is then scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, textvec

SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes tú ti tus tuyo vosotros os".split()
)
NEAR, STRONG = 5, 2.5
#: Bytes of text that are read at once, whole texts always; each takes some hundred bytes of a worker's memory. No result depends on it.
PIECE = 1 << 19
_LEET = str.maketrans("0134578@$!|", "oieastbasil")
_INNER = re.compile(r"[\w][^\w\s'’-]+[\w]|[^\W\d_]\d+[^\W\d_]")
_RUN = re.compile(r"(.)\1\1+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
FEATURES = ("log_words", "strong_share", "weight_share", "most_weight", "strong_any", "near_share", "near_any", "hidden_share", "hidden_strong", "shout_share", "upper_rate", "punct_rate", "bang_rate", "digit_rate", "top_two")


def terms(token: str) -> tuple[str, str]:
    """The bare word of a token in lower case, and that word with disguises undone ('' if there are none)."""
    word = _EDGE.sub("", token.lower())
    if not _INNER.search(token) and not _RUN.search(word):
        return word, ""
    plain = re.sub(r"[\W_]", "", _RUN.sub(r"\1", word.translate(_LEET)))
    return word, plain if plain != word else ""


_U = np.uint64
_PREFIX = _U(0x5851F42D4C957F2D)
PREFIXES = range(4, 8)
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
_JOINS = np.zeros(256, bool)
_JOINS[[*b"'-_"]] = True


class Lexicon:
    """Weights of words and of word beginnings of 4 to 7 bytes, by their hashes."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], np.asarray(weights, float)[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.hashes >> _U(44)).astype(np.int64)] = True

    @classmethod
    def of(cls, weights: dict[str, float]) -> Lexicon:
        """From words, and beginnings of words that end in ``*``."""
        return cls(np.array([_hash_of(t) for t in weights], _U), np.array(list(weights.values())))

    def __len__(self) -> int:
        return len(self.hashes)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h))
        maybe = np.flatnonzero(self.sieve[(h >> _U(44)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            hit = self.hashes[at] == h[maybe]
            out[maybe[hit]] = self.weights[at[hit]]
        return out


class _Spans:
    """Hashes of byte ranges, equal for equal bytes."""

    def __init__(self, low: np.ndarray):
        self.sums = np.zeros(len(low) + 1, _U)
        value = self.sums[1:]
        value[:] = low
        value += _U(1)
        value *= textvec.powers(textvec.BASE, len(low))
        np.cumsum(value, out=value)
        self.inverse = textvec.powers(textvec.INV, len(low) + 1)

    def _raw(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (self.sums[e] - self.sums[s]) * self.inverse[s]

    def terms(self, s: np.ndarray, e: np.ndarray) -> Iterator[tuple[np.ndarray | slice, np.ndarray]]:
        """(which, hashes): of the words, then of their beginnings, where these are shorter."""
        yield slice(None), textvec.mix(self._raw(s, e))
        for k in PREFIXES:
            which = np.flatnonzero(e - s > k)
            yield which, textvec.mix(self._raw(s[which], s[which] + k) ^ _PREFIX)


def _hash_of(term: str) -> int:
    raw = np.frombuffer(term.rstrip("*").encode(), np.uint8)
    h = _Spans(textvec.folded(raw))._raw(np.array([0]), np.array([len(raw)]))
    return int(textvec.mix(h ^ _PREFIX if term.endswith("*") else h)[0])


@dataclass
class Tokens:
    """What stands between ASCII spaces, text by text, with its bare word and that word with disguises undone."""

    data: np.ndarray
    off: np.ndarray
    doc: np.ndarray
    word: np.ndarray  # which tokens have a word
    start: np.ndarray  # of those: the word's bytes
    end: np.ndarray
    shouted: np.ndarray
    spans: _Spans
    hidden: np.ndarray  # which of the words are disguised
    plain: np.ndarray  # and which plain word each has
    plains: _Spans
    plain_start: np.ndarray
    plain_end: np.ndarray
    digits: np.ndarray  # of the hidden: whether all of it is digits


def tokens(texts: pa.Array) -> Tokens:
    data, off = textvec.text_bytes(texts)
    n = len(data)
    begin, stop = textvec.runs(~_SPACE[data], off) if n else (np.empty(0, np.int64), np.empty(0, np.int64))
    inside = textvec.is_word(data)
    for k in (1, 2):  # general punctuation, and the signs of Latin-1, are no letters
        lead = np.flatnonzero((data[:-1] == 0xE2) & ((data[1:] == 0x80) | (data[1:] == 0x81)) if k == 2 else (data[:-1] == 0xC2) & (data[1:] < 0xC0))
        for j in range(k + 1):
            inside[np.minimum(lead + j, n - 1)] = False

    def count(hit: np.ndarray) -> np.ndarray:
        sums = np.zeros(n + 1, np.int32 if n < 1 << 31 else np.int64)
        np.cumsum(hit, out=sums[1:])
        return sums

    upto, places = count(inside), np.flatnonzero(inside)
    word = np.flatnonzero(upto[stop] > upto[begin])
    b, t = begin[word], stop[word]
    start, end = places[upto[b]], places[upto[t] - 1] + 1
    low = textvec.folded(data)
    upper, lower, digit = low != data, (data >= 97) & (data <= 122), (data >= 48) & (data <= 57)
    small = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x9F) & (data[1:] != 0xB7)) + 1
    lower[small] = True
    ups, lows, digits = count(upper), count(lower), count(digit)
    shouted = (end - start > 2) & (ups[t] > ups[b]) & (lows[t] == lows[b])
    same = np.zeros(n, bool)
    if n > 2:
        same[:-2] = (low[2:] == low[:-2]) & (low[1:-1] == low[:-2])
    for k, lead in ((2, 0xC0), (3, 0xE0), (4, 0xF0)):  # a character of k bytes three times over
        at = np.flatnonzero((data[: max(0, n - 3 * k + 1)] >= lead) & (data[: max(0, n - 3 * k + 1)] < lead + (0x20 if k == 2 else 0x10)))
        for j in range(2 * k):
            at = at[low[at + j] == low[at + j + k]]
        same[at] = True
    odd, runs = count(~inside & ~_JOINS[data]), count(same)
    numbers = digits[end] - digits[start]
    maybe = np.flatnonzero((odd[end] > odd[start]) | ((numbers > 0) & (numbers < end - start)) | (runs[end] > runs[start]))
    seen: dict[bytes, str] = {}
    hidden, plain, distinct = [], [], {}
    raw = data.tobytes()
    for k, i, j in zip(maybe.tolist(), b[maybe].tolist(), t[maybe].tolist(), strict=True):
        token = raw[i:j]
        p = seen.get(token)
        if p is None:
            p = seen[token] = terms(token.decode("utf-8", "replace"))[1]
        if p:
            hidden.append(k)
            plain.append(distinct.setdefault(p, len(distinct)))
    names, bounds = textvec.text_bytes(pa.array(list(distinct), pa.string()))
    at = np.array(hidden, np.int64)
    return Tokens(
        data, off, np.searchsorted(off, begin, side="right") - 1, word, start, end, shouted, _Spans(low), at, np.array(plain, np.int64),
        _Spans(textvec.folded(names)), bounds[:-1], bounds[1:], numbers[at] == (end - start)[at],
    )


def dense(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Features of every text, in the order of FEATURES; those of null and empty texts are 0."""
    t = tokens(texts)
    many = len(texts)
    out = np.zeros((many, len(FEATURES)))
    data, off = t.data, t.off
    size = np.maximum(np.diff(off), 1)
    for k, hit in (
        (10, (data >= 65) & (data <= 90)),
        (11, (data >= 33) & (data <= 126) & ~((data >= 48) & (data <= 57) | (data >= 65) & (data <= 90) | (data >= 97) & (data <= 122))),
        (12, (data == 33) | (data == 63)),
        (13, (data >= 48) & (data <= 57)),
    ):
        sums = np.concatenate([[0], np.cumsum(hit)])
        out[:, k] = (sums[off[1:]] - sums[off[:-1]]) / size
    if not len(t.doc):
        return out
    n = np.bincount(t.doc, minlength=many)
    share = 1 / np.maximum(n, 1)
    out[:, 0] = np.log1p(n)
    weight, you = np.zeros(len(t.word)), np.zeros(len(t.word), bool)
    for which, h in t.spans.terms(t.start, t.end):
        if isinstance(which, slice):
            you = _YOU(h) > 0
        weight[which] = np.maximum(weight[which], lexicon(h))
    bare = np.zeros(len(t.plain_start))
    for which, h in t.plains.terms(t.plain_start, t.plain_end):
        bare[which] = np.maximum(bare[which], lexicon(h))
    weight[t.hidden] = np.maximum(weight[t.hidden], bare[t.plain])
    disguised = np.zeros(len(t.word), bool)
    disguised[t.hidden] = ~t.digits
    doc = t.doc[t.word]
    strong, hit = weight >= STRONG, weight > 0

    def total(rows: np.ndarray, value: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc[rows], None if value is None else value[rows], many)

    place = t.word + doc * (NEAR + 1)  # words of different texts are never near
    near = np.zeros(len(doc), bool)
    near[strong] = _near(place[strong], place[you])
    for k, column in (
        (1, total(strong) * share), (2, total(hit, weight) * share), (4, total(strong)), (5, total(near) * share), (6, total(near)),
        (7, total(disguised) * share), (8, total(disguised & strong)), (9, total(t.shouted) * share),
    ):
        out[:, k] = column
    rows = np.flatnonzero(hit)
    rows = rows[np.lexsort((-weight[rows], doc[rows]))]
    first = np.concatenate([[True], doc[rows][1:] != doc[rows][:-1]]) if len(rows) else np.empty(0, bool)
    second = np.concatenate([[False], first[:-1] & ~first[1:]]) if len(rows) else first
    out[doc[rows[first]], 3] = weight[rows[first]]
    out[:, 14] = out[:, 3]
    out[doc[rows[second]], 14] += weight[rows[second]]
    return out


def _near(places: np.ndarray, you: np.ndarray) -> np.ndarray:
    if not len(places) or not len(you):
        return np.zeros(len(places), bool)
    at = np.searchsorted(you, places)
    left, right = you[np.maximum(at - 1, 0)], you[np.minimum(at, len(you) - 1)]
    return np.minimum(np.abs(places - left), np.abs(right - places)) <= NEAR


_YOU = Lexicon.of(dict.fromkeys(sorted(SECOND_PERSON), 1.0))


class Trees:
    """Boosted trees of fixed depth for the log-odds of a 0/1 label, on features cut at quantiles."""

    def __init__(self, n_trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, penalty: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.penalty = n_trees, depth, rate, bins, penalty

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Trees:
        w = np.ones(len(y)) if weight is None else weight
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        # rare but telling values are beyond all quantiles: the least value above the lowest cut is a cut too
        self.cuts = [np.unique(np.append(q, [(q[0] + v.min()) / 2])) if len(v := c[c > q[0]]) else q for q, c in zip(self.cuts, x.T, strict=True)]
        binned = np.stack([np.searchsorted(q, c) for q, c in zip(self.cuts, x.T, strict=True)], 1)
        p = np.clip(np.average(y, weights=w), 1e-6, 1 - 1e-6)
        self.base = np.log(p / (1 - p))
        score = np.full(len(y), self.base)
        wide = max(len(q) for q in self.cuts) + 1
        inner = 2**self.depth - 1
        self.feature = np.zeros((self.n_trees, inner), np.int64)
        self.cut = np.full((self.n_trees, inner), np.inf)
        self.leaf = np.zeros((self.n_trees, inner + 1))
        for t in range(self.n_trees):
            prob = 1 / (1 + np.exp(-score))
            g, h = w * (y - prob), w * prob * (1 - prob)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                key = (node - first)[:, None] * wide + binned
                best = np.full(n, 1e-9)
                for f in range(x.shape[1]):
                    gs, hs = (np.bincount(key[:, f], v, n * wide).reshape(n, wide).cumsum(1) for v in (g, h))
                    gain = gs**2 / (hs + self.penalty) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + self.penalty) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.penalty)
                    gain = gain[:, : len(self.cuts[f])]
                    if not gain.shape[1]:
                        continue
                    at = gain.argmax(1)
                    top = gain[np.arange(n), at]
                    better = top > best
                    best[better] = top[better]
                    self.feature[t, first : first + n][better] = f
                    self.cut[t, first : first + n][better] = self.cuts[f][at[better]]
                node = 2 * node + 1 + (x[np.arange(len(y)), self.feature[t][node]] > self.cut[t][node])
            at = node - inner
            gs, hs = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
            self.leaf[t] = self.rate * gs / (hs + self.penalty)
            score += self.leaf[t][at]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        return total


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (scores, probabilities) to interpolate between, both non-decreasing."""
    order = np.argsort(score, kind="stable")
    w = np.ones(len(y)) if weight is None else weight
    level: list[list[float]] = []  # sum of labels, of weights, lowest and highest score
    for s, v, n in zip(score[order], (w * y)[order], w[order], strict=True):
        level.append([v, n, s, s])
        while len(level) > 1 and level[-2][0] * level[-1][1] >= level[-1][0] * level[-2][1]:
            v, n, _, high = level.pop()
            level[-1][0] += v
            level[-1][1] += n
            level[-1][3] = high
    at = np.array([x for lv in level for x in lv[2:]])
    return at, np.repeat([lv[0] / lv[1] for lv in level], 2)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    at: np.ndarray
    prob: np.ndarray

    def __call__(self, texts: pa.Array) -> np.ndarray:
        found = [np.empty(0)]
        for b in textvec.chunks(pa.RecordBatch.from_arrays([texts], names=["text"]), 0, PIECE):
            x = dense(b.column(0), self.lexicon)
            found.append(np.where(x[:, 0] > 0, np.interp(self.trees.score(x), self.at, self.prob), 0.0))
        return np.concatenate(found)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, clean): how many texts of either class hold a term, by its hash."""
    for whole in batches:
        for b in textvec.chunks(whole, 1, PIECE):
            t = tokens(b.column(1))
            doc = t.doc[t.word]
            found = [(doc[which], h) for which, h in t.spans.terms(t.start, t.end)]
            found += [(doc[t.hidden], h[t.plain]) if isinstance(which, slice) else (doc[t.hidden][hit := np.isin(t.plain, which)], h[np.searchsorted(which, t.plain[hit])]) for which, h in t.plains.terms(t.plain_start, t.plain_end)]
            d, h = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((d, h))
            d, h = d[order], h[order]
            once = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]) if len(d) else np.empty(0, bool)
            d, h = d[once], h[once]
            toxic = np.asarray(b.column(0))[d] > 0
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
            many = np.diff(np.append(head, len(h)))
            bad = np.add.reduceat(toxic.astype(np.int64), head) if len(head) else many
            yield pa.RecordBatch.from_arrays([pa.array(h[head].view(np.int64)), pa.array(bad), pa.array(many - bad)], names=["term", "toxic", "clean"])


#: Parts of the labelled rows by rank within their class: below 5 for the lexicon, 5 to 7 for the trees, 8 and 9 for calibration.
_FOLDS = (0, 5, 8, 1, 6, 2, 9, 3, 7, 4)


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 12_000, least_docs: int = 4, seed: int = 11) -> Model | None:
    """A model from at most ``sample`` labelled documents: half of it from each class, more from one where the other has fewer.

    Within a class those with the least hashes of their ids are drawn; weights restore the classes' true shares.
    ``least_docs``: toxic documents that a term of the lexicon is in. None if a class has fewer than three documents.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id"))
    known = known.agg((F.max("toxic") > 0).cast("int").alias("toxic")).join(docs.select(F.col("doc_id").cast("long").alias("id")).distinct(), "id", "left_semi")
    known = common.cut(known.withColumn("drawn", F.xxhash64("id", F.lit(seed))))
    there = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if min(there.get(0, 0), there.get(1, 0)) < 3:
        return None
    take = {c: min(there[c], max(sample // 2, sample - there[1 - c])) for c in (0, 1)}
    chosen = known.where("toxic = 1").orderBy("drawn", "id").limit(take[1]).union(known.where("toxic = 0").orderBy("drawn", "id").limit(take[0]))
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy("drawn", "id")) - 1  # of at most ``sample`` rows
    chosen = chosen.select("id", "toxic", F.element_at(F.array(*map(F.lit, _FOLDS)), (rank % 10 + 1)).alias("fold"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = common.cut(texts.join(F.broadcast(chosen), "id").select("toxic", "text", "fold"))  # bounded by ``sample``
    whole = rows.where("fold < 5").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).first()
    counts = rows.where("fold < 5").select("toxic", "text").mapInArrow(_term_counts, "term long, toxic long, clean long")
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (whole["toxic"] + 1)) - F.log((F.col("clean") + 0.5) / (whole["clean"] + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    found = counts.where(F.col("toxic") >= least_docs).select("term", odds.alias("w"), (odds / error).alias("z")).where("z > 3 AND w > 1")
    # bounded by the sample: a term is in ``least_docs`` of its texts or more
    found = found.select("term", F.round("w", 4).alias("w")).toArrow().combine_chunks()
    lexicon = Lexicon(np.asarray(found.column(0).combine_chunks()).astype(np.int64).view(_U), np.asarray(found.column(1).combine_chunks()))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in textvec.chunks(whole, 1, PIECE):
                x = dense(b.column(1), lexicon)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], names=["toxic", "fold", "x"])

    rest = rows.where("fold >= 5").select("toxic", "text", "fold").mapInArrow(featurize, "toxic int, fold int, x array<double>").toArrow()
    y, fold = np.asarray(rest.column(0)).astype(float), np.asarray(rest.column(1))
    x = np.asarray(rest.column(2).combine_chunks().flatten()).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, y, fold))  # the order of rows plays no part
    x, y, fold = x[order], y[order], fold[order]
    weight = np.where(y > 0, there[1] / take[1], there[0] / take[0])
    train, check = fold < 8, fold >= 8
    trees = Trees().fit(x[train], y[train], weight[train])
    return Model(lexicon, trees, *isotonic(trees.score(x[check]), y[check], weight[check]))


def score(docs: DataFrame, labels: DataFrame, *, least: float = 0.5, **how: int) -> DataFrame:
    """(doc_id, toxicity, toxic) of every document: calibrated probability, and whether it is ``least`` or more.

    Defined cases: null, empty and blank texts score 0 and aren't toxic; labels with a null id or value
    don't count, of repeated ones a toxic one wins; with fewer than three labelled documents of a class toxicity is null
    and nothing toxic; null ids and repeated rows are scored as rows of their own; other columns play no
    part; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model.value is None:
                p = pa.nulls(len(b), pa.float64())
            else:
                p = pa.array(np.round(model.value(b.column(1)), 4))
            toxic = pc.fill_null(pc.greater_equal(p, least), False)
            yield pa.RecordBatch.from_arrays([b.column(0), p, toxic], names=["doc_id", "toxicity", "toxic"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, toxicity double, toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, least: float = 0.5, **how: int) -> DataFrame:
    """``docs`` without the rows that are toxic; all columns and all else stay."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        if model.value is None:
            return pa.array(np.ones(len(texts), bool))
        return pa.array(np.round(model.value(texts), 4) < least)

    return docs.where(clean(F.col("text").cast("string")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
