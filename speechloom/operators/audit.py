"""Audits: histograms, percentiles, integrity and leakage counts, metric history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

PERCENTS = (0.25, 0.50, 0.75, 0.90, 0.99)


def percentiles(df: DataFrame, value: str, by: str) -> DataFrame:
    """sorted[min(n - 1, floor(n p))] per group and the maximum, from a histogram of values: no group is gathered as rows."""
    h = df.groupBy(by, value).agg(F.count("*").alias("c"))
    w = W.partitionBy(by)
    h = h.withColumn("n", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy(value)))
    at = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p)))
    return h.groupBy(by).agg(*[F.min(F.when(F.col("upto") > at(p), F.col(value))).alias(f"p{int(p * 100)}") for p in PERCENTS], F.max(value).alias("max"), F.first("n").alias("n"))


def top_k(df: DataFrame, field: str, pos: str, k: int) -> DataFrame:
    """The k most frequent values; ties go to the one seen first."""
    return df.groupBy(field).agg(F.count("*").alias("n"), F.min(pos).alias("first")).orderBy(F.desc("n"), "first").limit(k).drop("first")


def leakage(split: DataFrame, key: Column) -> DataFrame:
    """Distinct keys that each two splits share."""
    k = split.select("split", key.alias("k")).distinct()
    a, b = k.select(F.col("split").alias("a"), "k"), k.select(F.col("split").alias("b"), "k")
    return a.join(b, "k").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def overfit(history: DataFrame, step: str, value: str, drop: float = 0.05) -> DataFrame:
    """evals, peak, last and whether the last value fell more than drop below the peak (three evaluations at least)."""
    d = history.agg(F.count("*").alias("evals"), F.max(value).alias("peak"), F.max_by(value, step).alias("last"))
    return d.withColumn("overfit", (F.col("evals") >= 3) & (F.col("last") < F.col("peak") - drop))


#: What an audited value looks like in any text: fixed values.
AUDITED = (
    r"(?i)\b[0-9]+(?:[.,][0-9]+)?\b",
    r"(?i)\b(?:mon|tue|wed|thu|fri|sat|sun)\w*day\b",
    r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\b",
    r"(?i)\b[0-9]{1,2}:[0-9]{2}\s*(?:am|pm)?\b",
    r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b",
)
#: Accented Latin letters: parts of words, but of none of the classes above.
ACCENTED = "[À-ÖØ-öø-ɏ]"


def eps_inferred(said: Column, answer: Column) -> Column:
    """(n, lost): values found in the input without any declaration, and how many of them miss a word in the answer."""
    plain = lambda c: F.regexp_replace(c, ACCENTED, "_")
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9']+"), F.lit(0))
    found = F.flatten(F.array(*[F.regexp_extract_all(plain(said), F.lit(p), F.lit(0)) for p in AUDITED]))
    values = F.array_distinct(F.transform(found, lambda v: F.trim(F.lower(v))))
    lost = T.let(words(plain(answer)), lambda out: F.size(F.filter(values, lambda v: F.size(F.array_except(words(v), out)) > 0)))
    return F.struct(F.size(values).alias("n"), lost.alias("lost"))
