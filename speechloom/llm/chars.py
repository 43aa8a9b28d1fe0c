"""Character n-grams of words as numbers: packed codes of whole batches, counts over the corpus, tables to look them up.

Every character counts, of whatever script: it is a 16-bit code (characters beyond the basic plane share codes), and four of them
make a 64-bit key, so that the context and the lower orders of an n-gram are parts of its key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Codes before a word and after it; as characters they are signs of control, which words do not hold.
PAD, STOP = 1, 2
BITS = 16
STRIP = ".,;:!?\"'()[]{}…«»„“”|*#$%&<>-_+=/\\~^`"


def fold(part: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod."""
    return F.crc32(part.cast("string").cast("binary")) % mod


def lower(key: np.ndarray, order: int) -> np.ndarray:
    """The last characters of each key, order of them."""
    return key & ((1 << BITS * order) - 1)


def grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the n-grams that end on each letter and on the stop of each word, and the index of the word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + order) - lengths - 1
    c = np.full(int((lengths + order).sum()), PAD, np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) & ((1 << BITS) - 1)
    c[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(letters))] = letters
    c[starts + lengths] = STOP
    g = c.copy()
    for k in range(1, order):
        g[k:] |= c[:-k] << (BITS * k)
    ends = lengths + 1
    at = np.repeat(starts - (np.cumsum(ends) - ends), ends) + np.arange(int(ends.sum()))
    return g[at], np.repeat(np.arange(len(words)), ends)


def gram_counts(rows: DataFrame, order: int) -> DataFrame:
    """label (a long), gram, n of every n-gram over all rows (text, label), from a written table.

    Each task sums what it reads, so hot n-grams and labels are aggregated before they are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Counter] = {}
        for b in batches:
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums.setdefault(k, Counter()).update(clean_words(t or ""))
            if sum(map(len, sums.values())) > 200_000:
                yield from flush(sums)
        yield from flush(sums)

    def flush(sums: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
        for k, n in sums.items():
            words = list(n)
            if words:
                g, i = grams(words, order)
                u, inv = np.unique(g, return_inverse=True)
                total = np.bincount(inv, weights=np.fromiter(n.values(), np.float64, len(words))[i]).astype(np.int64)
                yield pa.record_batch([pa.array([k] * len(u), pa.int64()), pa.array(u), pa.array(total)], names=["label", "gram", "n"])
        sums.clear()

    made = rows.select(F.col("text").cast("string"), F.col("label").cast("long")).mapInArrow(count, "label long, gram long, n long")
    return written(rows.sparkSession, made.groupBy("label", "gram").agg(F.sum("n").alias("n")))


def common(sums: DataFrame, share: float) -> DataFrame:
    """The rows of gram_counts that are at least share of their label's, so at most 1 / share a label."""
    total = sums.groupBy("label").agg((F.sum("n") * F.lit(share)).alias("__least"))  # a row a label
    return sums.join(F.broadcast(total), "label").where(F.col("n") >= F.col("__least")).drop("__least")


class Lookup:
    """Values by key, in sorted arrays; keys that are not held have a value of their own."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, other: float):
        order = np.argsort(keys)
        self.keys, self.values, self.other = keys[order], values[order].astype(np.float32), other

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys are held."""
        if not len(self.keys):
            return np.full(len(keys), self.other, np.float32), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        held = self.keys[at] == keys
        return np.where(held, self.values[at], np.float32(self.other)), held


def clean_words(text: str) -> list[str]:
    """Lower-cased words without the signs around them."""
    return [w for w in (x.strip(STRIP) for x in text.lower().split()) if w]
