"""Words of a whole batch of texts as numpy arrays.

A word is a run of ASCII letters and digits and of any bytes beyond ASCII, so that accented letters
stay inside their words; letters A-Z and À-Þ are folded to lower case. Hashes are 64-bit polynomials
over the bytes, finished by an avalanche step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INV = pow(BASE, -1, 1 << 64)

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 2 * len(have) if have is not None else 0)
        p = np.full(size, base, _U)
        p[0] = 1
        have = _powers[base] = np.cumprod(p, dtype=_U)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def is_word(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    return _ALNUM[data]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each; null reads as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]] if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, off - off[0]


def chunks(batch: pa.RecordBatch, text: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, at least one row."""
    col = batch.column(text)
    if not len(col):
        return
    if col.null_count == len(col):
        yield batch
        return
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(col):
        limit = (ends[at - 1] if at else 0) + most
        to = max(at + 1, int(np.searchsorted(ends, limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    """Words of consecutive texts: ``hash[bounds[d]:bounds[d + 1]]`` are those of text d, in order."""

    hash: np.ndarray
    start: np.ndarray  # byte offsets in the text that holds the word
    end: np.ndarray
    bounds: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def prefix(self) -> np.ndarray:
        """Sums S so that the n words from i hash to (S[i + n] - S[i]) * INV ** i; see ``gram``."""
        s = np.zeros(len(self.hash) + 1, _U)
        np.cumsum(self.hash * powers(BASE, len(self.hash)), dtype=_U, out=s[1:])
        return s

    def gram(self, n: int, s: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the n words from each position; those that would leave the text are to be masked by ``inside``."""
        s = self.prefix() if s is None else s
        m = max(0, len(self.hash) - n + 1)
        return mix((s[n : n + m] - s[:m]) * powers(INV, m))

    def inside(self, n: int) -> np.ndarray:
        """Which positions begin n words of one text."""
        m = max(0, len(self.hash) - n + 1)
        d = self.doc
        return d[:m] == d[n - 1 : n - 1 + m]


def run_hash(s: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Hash of the words i to j (exclusive) from prefix sums; equal words give equal hashes wherever they are."""
    return mix((s[j] - s[i]) * powers(INV, int(i.max()) + 1 if len(i) else 1)[i] + (j - i).astype(_U))


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z and À-Þ in lower case."""
    low = _FOLD[data]
    upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3) & (data[1:] != 0x97)) + 1
    low[upper] += 0x20
    return low


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of marked bytes; none goes on from one text to the next."""
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    first, last = edge[:-1] == 1, edge[1:] == -1
    begins = off[:-1][np.diff(off) > 0]
    first[begins] = inside[begins]
    inner = begins[begins > 0]
    last[inner - 1] = inside[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(texts: pa.Array) -> Words:
    data, off = text_bytes(texts)
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return Words(np.empty(0, _U), none, none, np.zeros(len(texts) + 1, np.int64))
    is_word = _ALNUM[data]
    low = folded(data)
    start, end = runs(is_word, off)
    value = (low.astype(_U) + _U(1)) * powers(BASE, n)
    value[~is_word] = 0
    h = np.add.reduceat(value, start) * powers(INV, n)[start] if len(start) else np.empty(0, _U)
    bounds = np.searchsorted(start, off)
    base = np.repeat(off[:-1], np.diff(bounds))
    return Words(mix(h), start - base, end - base, bounds)
