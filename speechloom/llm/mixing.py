"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Each source has a target number of words and a piecewise-linear weight over training time t in [0, 1]. Its weight is
integrated; a document's place in its source (cumulative words, in an order fixed by a hash) is put through the inverse
of that integral, which gives the training position; documents are range-sorted by position. A source whose target
exceeds its size is read again from the start, so a document is taken at most ``MAX_EPOCHS`` times. The document on which a
target ends is taken in part.

Cases: null text has size 0 and is never taken; null source is a source of its own, last in rank; null doc_id is allowed;
ties in the hash order are broken by doc_id, size and a hash of the text (equal rows change places freely); an empty table gives
no rows; a very long text is counted whole, and cut by an expression without recursion; other columns play no part. Prefix sums go over three levels of hash buckets, so that no task holds a source.
The tables of sources and of their 256 buckets are the only ones sorted whole; they have a row or 256 rows per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quality_rules import words_of
from .storage import written

WEIGHTS = (5, 2, 1)
#: Words of the mix against words of all sources.
SHARE = 1.5
MAX_EPOCHS = 2
#: Relative weight at the start, middle and end of training, by rank of the source; each integrates to 1 over time.
CURRICULUM = ((1.25, 1.0, 0.75), (1.0, 1.0, 1.0), (0.75, 1.0, 1.25))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """src, source_size, rank, target: weights dealt to the sources by code point (null last); excess over the cap reshared.

    The fixed point of resharing is min(cap, level * weight) with one level for all: sources are sorted by cap / weight, and the
    level is the first that does not exceed its own source's ratio. ``src`` is a struct (is_null, name).
    """
    every = W.partitionBy(F.lit(0))
    d = sizes.withColumn("rank", F.row_number().over(every.orderBy("src")) - 1)
    d = d.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    d = d.withColumn("cap", F.col("source_size") * float(MAX_EPOCHS)).withColumn("ratio", F.col("cap") / F.col("w"))
    order = every.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(order), F.lit(0.0))
    d = d.withColumn("level", (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order), F.lit(0.0))) / left)
    d = d.withColumn("fit", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every)["level"])
    return d.select("src", "source_size", "rank", F.least(F.col("cap"), F.coalesce("fit", F.lit(0.0)) * F.col("w")).alias("target"))


def position(u: Column, knots: Column) -> Column:
    """The time t at which the integral of the piecewise-linear weight with these equally spaced knots reaches share u of its whole."""
    n = F.size(knots) - 1
    area = lambda i: (F.get(knots, i) + F.get(knots, i + 1)) / (2.0 * n)
    whole = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + area(i))

    def step(acc: Column, i: Column) -> Column:
        # within a piece from weight a to b: a s + (b - a) s^2 / 2 = rest * n, solved for s in [0, 1]
        a, b, rest = F.get(knots, i), F.get(knots, i + 1), u * whole - acc["done"]
        root = F.sqrt(F.greatest(F.lit(0.0), a * a + 2.0 * (b - a) * rest * n))
        s = F.try_divide(2.0 * rest * n, a + root)
        here = acc["t"].isNull() & ((rest <= area(i)) | (i == n - 1))
        t = F.when(here, (i + F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(s, F.lit(0.0))))) / n).otherwise(acc["t"])
        return F.struct(t.alias("t"), (acc["done"] + area(i)).alias("done"))

    start = F.struct(F.lit(None).cast("double").alias("t"), F.lit(0.0).alias("done"))
    return F.aggregate(F.sequence(F.lit(0), n - 1), start, step)["t"]


def placed(spark: SparkSession, docs: DataFrame, keep: Column | None = None, curriculum: tuple = CURRICULUM) -> DataFrame:
    """Every document with its place: doc_id, source, size, source_size, target, first (words before it in its source), taken, knots; and keep."""
    src = F.struct(F.col("source").isNull().alias("is_null"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"))
    src = src.cast("struct<is_null:boolean,name:string>")  # as it is read back: with another nullability the window would shuffle the texts anew after the join
    key = F.xxhash64("doc_id", "size")
    d = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.size(words_of(F.col("text").cast("string"))).cast("long").alias("size"), F.xxhash64(F.col("text").cast("string")).alias("tie"), *([keep.alias("keep")] if keep is not None else []))
    d = d.withColumn("src", src).withColumn("key", key).withColumn("b1", F.col("key").bitwiseAND(255)).withColumn("b2", F.shiftright("key", 8).bitwiseAND(255))
    small = d.select("src", "b1", "b2", "size")
    if keep is None:  # a few numbers a row: worth keeping, so that the texts are read once
        d = written(spark, d)
        small = d.select("src", "b1", "b2", "size")
    l2 = written(spark, small.groupBy("src", "b1", "b2").agg(F.sum("size").alias("s")))
    l1 = l2.groupBy("src", "b1").agg(F.sum("s").alias("s1"))
    whole = targets(l1.groupBy("src").agg(F.sum("s1").alias("source_size")))
    before = lambda c, *by: F.coalesce(F.sum(c).over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    l1 = l1.withColumn("o1", before("s1", "src", "b1")).join(whole, "src").drop("s1")
    l2 = l2.withColumn("o2", before("s", "src", "b1", "b2")).join(l1, ["src", "b1"])
    l2 = l2.select("src", "b1", "b2", (F.col("o1") + F.col("o2")).alias("o"), "source_size", "rank", "target")
    d = d.join(l2.hint("merge"), ["src", "b1", "b2"])  # sums grow with the sources: the same plan at every size
    inside = W.partitionBy("src", "b1", "b2").orderBy("key", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("first", F.col("o") + F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    goal = F.round("target").cast("long")
    zero = F.lit(0).cast("long")
    part = lambda k: F.greatest(zero, F.least(F.col("size"), goal - F.col("first") - k * F.col("source_size")))
    knots = F.get(F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in curriculum]), (F.col("rank") % len(curriculum)).cast("int"))
    d = d.withColumn("parts", F.array(*[part(k) for k in range(MAX_EPOCHS)])).withColumn("taken", sum((part(k) for k in range(1, MAX_EPOCHS)), part(0)))
    return d.select("doc_id", "source", "size", "source_size", "target", "first", "taken", "parts", knots.alias("knots"), *(["keep"] if keep is not None else []))


def first_position(d: DataFrame) -> DataFrame:
    """With the training position of each document's first reading; null if it is never read."""
    return d.withColumn("position", F.when(F.col("taken") > 0, position(F.try_divide("first", "target"), F.col("knots"))))


def mix_sizes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, position; in the order of training, unread ones last."""
    d = first_position(placed(spark, docs))
    rest = 1.0 + F.coalesce(F.try_divide("first", "source_size"), F.lit(0.0))
    return d.orderBy(F.coalesce("position", rest)).select("doc_id", "size", "source_size", "target", "taken", "source", "position")


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mixed corpus in the columns of docs, a row for each reading of a document, range-sorted by training position.

    A reading that a target cuts keeps the text up to its last word taken (and n_chars, if there, follows).
    """
    d = placed(spark, docs, keep=F.struct(*[docs[c] for c in docs.columns]))
    d = d.withColumn("read", F.explode(F.filter(F.transform("parts", lambda n, k: F.struct(n.alias("n"), k.alias("k"))), lambda x: x["n"] > 0)))
    at = F.try_divide(F.col("first") + F.col("read.k") * F.col("source_size"), F.col("target"))
    d = d.withColumn("position", position(at, F.col("knots"))).orderBy("position")
    # the prefix of n words: a possessive loop runs without recursion, whatever n is
    cut = F.call_function("regexp_extract", F.col("keep.text"), F.concat(F.lit("\\A(?:[ \\t-\\r]*+[^ \\t-\\r]++){"), F.col("read.n").cast("string"), F.lit("}+")), F.lit(0))
    d = d.select("keep", F.when(F.col("read.n") < F.col("size"), cut).otherwise(F.col("keep.text")).alias("cut"))
    new = {"text": F.col("cut")} | ({"n_chars": F.length("cut").cast("long")} if "n_chars" in docs.columns else {})
    return d.select(*[new.get(c, F.col("keep").getField(c)).alias(c) for c in docs.columns])
