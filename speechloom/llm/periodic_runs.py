"""Runs: stretches of consecutive words that repeat with a period, by a harmonic grid of common extensions.

A run of period p and at least 2p words holds two neighbours jp and (j+1)p of p's grid. For those two, the longest common extension
forward and backward gives the whole run, so that a text of n words takes n ln n queries. Extensions come from a suffix array of the words and one of
the reversed words, each with the lengths common to neighbouring suffixes and a range-minimum table over them. Before that, grid pairs are
dropped that no run of the least length can hold: one of the sides next to the pair must agree for some words. Texts without
such a pair, which are most, need no suffix array.

A text is one task's work; its arrays take about 60 + 8 log2(n) bytes a word where it has such pairs.

Cases: null and blank texts have no words and no runs; words are compared byte for byte; a null doc_id is carried; repeated rows each give
the same row; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the shortest run.
MIN_LENGTH = 12
#: Grid pairs looked at together.
PAIRS = 1 << 20
#: Bytes of a text split into words together.
SLICE = 1 << 20
#: Entries of a block of the range-minimum table.
BLOCK = 16


class Words:
    """The words of a text as codes by first occurrence; the text itself is split slice by slice."""

    def __init__(self, text: str | None):
        data = (text or "").encode()
        known: dict[bytes, int] = {}
        codes, at = [], 0
        while at < len(data):
            end = at + SLICE
            while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":  # slices end between words
                end += 1
            codes.append(np.array([known.setdefault(w, len(known)) for w in data[at:end].split()], np.int32))  # bytes split at the six blanks
            at = end
        self.codes = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        self.known = list(known)

    def joined(self, keep: np.ndarray | None) -> str:
        codes = self.codes if keep is None else self.codes[keep]
        return b" ".join(map(self.known.__getitem__, codes.tolist())).decode()


class Extensions:
    """Longest common extensions of two places of a sequence, by suffix array and range minima."""

    def __init__(self, codes: np.ndarray):
        n = self.n = len(codes)
        rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        levels, width = [rank.astype(np.int32)], 1
        while True:  # doubling: ranks of the first ``width`` words
            after = np.zeros(n, np.int64)
            after[: max(n - width, 0)] = rank[width:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            new = np.empty(n, bool)
            new[:1] = True
            new[1:] = sorted_key[1:] != sorted_key[:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            if new.all():
                break
            width *= 2
            levels.append(rank.astype(np.int32))
        self.rank = rank
        a, b = order[:-1], order[1:]  # what neighbouring suffixes have in common, by the levels
        common = np.zeros(max(n - 1, 0), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            level = np.append(levels[k], np.int32(-1))
            x, y = np.minimum(a + common, n), np.minimum(b + common, n)
            common += (level[x] == level[y]).astype(np.int64) << k
        self._table(common)

    def _table(self, low: np.ndarray) -> None:
        blocks = -(-len(low) // BLOCK) or 1
        self.low = np.full(blocks * BLOCK, self.n, np.int64)
        self.low[: len(low)] = low
        self.minima = [self.low.reshape(blocks, BLOCK).min(axis=1)]
        while 2 ** len(self.minima) <= blocks:
            last, half = self.minima[-1], 2 ** (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def _least(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Minima of low[i..j], both included."""
        first, last = i // BLOCK, j // BLOCK
        out = np.full(len(i), self.n, np.int64)
        for k in range(BLOCK):
            x, y = i + k, j - k
            out = np.minimum(out, self.low[np.minimum(x, j)])
            out = np.minimum(out, self.low[np.maximum(y, i)])
        span = last - first - 1  # whole blocks between
        between = np.flatnonzero(span > 0)
        if len(between):
            f, s = first[between] + 1, span[between]
            level = np.frexp(s)[1] - 1
            for k in np.unique(level).tolist():
                at = level == k
                m, g = self.minima[k], f[at]
                least = np.minimum(m[g], m[g + s[at] - 2**k])
                out[between[at]] = np.minimum(out[between[at]], least)
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words from i and j on; places outside the sequence have none. i and j differ."""
        out = np.zeros(len(i), np.int64)
        ok = np.flatnonzero((i >= 0) & (j >= 0) & (i < self.n) & (j < self.n))
        if len(ok):
            x, y = self.rank[i[ok]], self.rank[j[ok]]
            out[ok] = self._least(np.minimum(x, y), np.maximum(x, y) - 1)
        return out


def side(min_length: int) -> int:
    """Words that agree on one side of some grid pair in every run: a run holds at least half of min_length agreeing neighbours, the pair among them."""
    return -(-((min_length + 1) // 2 - 1) // 2) + 1


def grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, place) of all pairs place, place + period of the grids of periods up to n / 2."""
    if n < 2:
        return
    periods = np.arange(1, n // 2 + 1)
    counts = (n - 1) // periods
    ends = np.cumsum(counts)
    for lo in range(0, int(ends[-1]), PAIRS):
        hi = min(lo + PAIRS, int(ends[-1]))
        a, b = np.searchsorted(ends, lo, side="right"), np.searchsorted(ends, hi, side="left")
        starts = ends[a : b + 1] - counts[a : b + 1]
        here = np.minimum(ends[a : b + 1], hi) - np.maximum(starts, lo)
        p = np.repeat(periods[a : b + 1], here)
        yield p, (np.arange(lo, hi) - np.repeat(starts, here)) * p


def find_runs(codes: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """start, length, period of every run of the codes, by start and period."""
    n, w = len(codes), side(min_length)
    none = np.zeros((0, 3), np.int64)
    if n < min_length:
        return none
    mixed = np.zeros(n, np.uint64)  # equal for equal stretches of w words; others seldom collide, and then cost a query
    padded = np.concatenate([codes.astype(np.uint64) + np.uint64(1), np.zeros(w, np.uint64)])
    for k in range(w):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + n]
        mixed ^= mixed >> np.uint64(29)
    held = []
    for p, i in grid(n):
        to = i - (w - 1)
        left = np.flatnonzero((mixed[to] == mixed[to + p]) & (to >= 0))
        right = np.flatnonzero(mixed[i] == mixed[i + p])
        both = np.union1d(left, right)
        if len(both):
            held.append((p[both], i[both]))
    if not held:
        return none
    forward, backward = Extensions(codes), Extensions(codes[::-1])
    found = []
    for p, i in held:
        start = i - backward(n - i, n - i - p)
        end = i + p + forward(i, i + p)
        ok = np.flatnonzero(end - start >= np.maximum(min_length, 2 * p))
        found.append(np.stack([start[ok], end[ok], p[ok]], axis=1))
    r = np.concatenate(found)
    r = r[np.lexsort((r[:, 2], r[:, 1], r[:, 0]))]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:, :2] != r[:-1, :2]).any(axis=1)  # a stretch has its smallest period; others are multiples of it
    r = r[new]
    r = np.stack([r[:, 0], r[:, 1] - r[:, 0], r[:, 2]], axis=1)
    return r[np.lexsort((r[:, 2], r[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray | None:
    """Which words stay: those in no run, or in the first period of every run that holds them. None if all do."""
    if not len(runs):
        return None
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:n]) == 0


def _of_texts(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            texts, n, sizes, runs = [], [], [0], []
            for text in batch["text"]:
                words = Words(text.as_py())
                found = find_runs(words.codes, min_length)
                texts.append(words.joined(kept_words(len(words.codes), found)))
                n.append(len(words.codes))
                sizes.append(sizes[-1] + len(found))
                runs.append(found)
            flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], fields=list(row))
            yield pa.record_batch([batch["doc_id"], pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat), pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the text without the repetitions, of every row of docs."""
    return docs.select("doc_id", "text").mapInArrow(_of_texts(min_length), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def longest(found):
    """The longest run of a column of runs; ties by start, then period; null if there is none."""
    return F.aggregate(found, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best))
