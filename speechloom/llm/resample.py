"""Quality by importance resampling: generative models of hashed words and word pairs for target and raw text, sampled by Gumbel top-k.

The target is the text labelled good; the raw model is counted over all documents. A document's log weight is the sum over its
hashed words and word pairs of log p_target - log p_raw. Adding Gumbel noise (from a hash of the id) and taking the k largest samples k documents
without replacement in proportion to their weights. k is a share of all documents: the share of good ones among those labelled.

The k-th largest key is found exactly by narrowing histograms of 65,536 cells; no ranking passes through one task.

Cases: null and empty texts have log weight 0; null labels are not counted; without labels the weight is 0 and k is all rows; rows that
tie with the k-th (in 2^-20 of a unit and 12 bits of a hash) are all selected; repeated rows count as often as they occur; an empty table gives no rows;
very long texts are weighed whole; other columns play no part, a clashing column of labels included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import written

BUCKETS = 1 << 14
SMOOTHING = 1.0
CACHE = 300_000


class Hasher:
    """Bucket counts of a text: its words, lower-cased, and its pairs of neighbours."""

    def __init__(self) -> None:
        self.seen: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().encode("utf-8", "surrogatepass").split()
        seen = self.seen
        if len(seen) > CACHE:
            seen.clear()
        for w in [w for w in set(words) if w not in seen]:  # a difference with a view would go through all that is remembered
            seen[w] = xxhash.xxh64_intdigest(w) & 0x7FFFFFFF
        h = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        pairs = (h[:-1] * 1_000_003 + h[1:] * 7_919) >> 7
        return np.concatenate([h % (BUCKETS // 2), BUCKETS // 2 + pairs % (BUCKETS // 2)])


def bucket_counts(rows: DataFrame) -> DataFrame:
    """label, bucket, n over all rows (text, label): each task sums what it reads, so a row for each bucket and task is shuffled at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sums = Hasher(), {}
        for b in batches:
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k not in sums:
                    sums[k] = np.zeros(BUCKETS, np.int64)
                sums[k] += np.bincount(hasher(t or ""), minlength=BUCKETS)
        for k, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([k] * len(at), pa.int32()), pa.array(at), pa.array(n[at])], names=["label", "bucket", "n"])

    made = rows.select("text", F.col("label").cast("int")).mapInArrow(count, "label int, bucket long, n long")
    return made.groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def log_ratio(spark: SparkSession, docs: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of each bucket, from rows (id, text, label): label 1 is the target, all rows are raw."""
    n = {1: np.zeros(BUCKETS), 0: np.zeros(BUCKETS)}
    for r in bucket_counts(docs.select("text", F.coalesce((F.col("label") == 1).cast("int"), F.lit(0)).alias("label"))).collect():  # two rows a bucket at most
        n[r["label"]][r["bucket"]] = r["n"]
    if not n[1].any():
        return np.zeros(BUCKETS)
    p, q = n[1] + SMOOTHING, n[0] + n[1] + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def kth_largest(keyed: DataFrame, k: int) -> int | None:
    """The k-th largest of the long column ``key``: four rounds of histograms of 16 bits each, the high ones first."""
    if k <= 0:
        return None
    prefix, rest = 0, k
    for shift in (48, 32, 16, 0):
        digit: Column = F.shiftrightunsigned(F.col("key"), shift).bitwiseAND(0xFFFF)
        rows = keyed if shift == 48 else keyed.where(F.shiftrightunsigned(F.col("key"), shift + 16) == prefix)
        for r in sorted(rows.groupBy(digit.alias("d")).count().collect(), reverse=True):  # 65,536 rows at most
            if rest <= r["count"]:
                prefix = (prefix << 16) | r["d"]
                break
            rest -= r["count"]
        else:
            return None
    return prefix


def resample(spark: SparkSession, docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """doc_id, log_weight, key, selected of every document."""
    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    marks = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality").cast("int")).alias("label"))
    joined = d.join(marks.hint("merge"), "id", "left")  # labels grow with the corpus: never broadcast
    ratio = spark.sparkContext.broadcast(log_ratio(spark, joined))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            w = [float(ratio.value[hasher(t or "")].sum()) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(w, pa.float64())], names=["id", "w"])

    u = (F.shiftrightunsigned(F.xxhash64("id", F.lit("gumbel")), 11).cast("double") + 0.5) / float(1 << 53)
    scored = d.mapInArrow(weigh, "id long, w double").withColumn("score", F.col("w") - F.log(-F.log(u)))
    # an order-preserving integer: steps of 2^-20 of a unit of log weight, then 12 bits of a hash
    steps = F.greatest(F.lit(-float(1 << 50)), F.least(F.lit(float(1 << 50)), F.col("score") * float(1 << 20))).cast("long")
    keyed = written(spark, scored.withColumn("key", F.shiftleft(steps + F.lit(1 << 50), 12) + F.xxhash64("id", F.lit("tie")).bitwiseAND(4095)))
    if share is None:
        n, good = marks.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        share = good / n if n else 1.0
    k = round(share * keyed.count())
    least = kth_largest(keyed, k)
    chosen = F.lit(False) if least is None else F.col("key") >= least
    return keyed.select(F.col("id").alias("doc_id"), F.col("w").alias("log_weight"), F.col("score").alias("gumbel_key"), chosen.alias("selected"))
