"""Scores of predictions, failure buckets and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

BUCKETS = ("repetition", "information_deletion", "verbosity", "punctuation_only", "partial_rewrite")
METRICS = ("exact_match", "normalized_match", "wer", "token_ratio", "artifact", "token_recall")


def scored(preds: DataFrame) -> DataFrame:
    """Per-row metrics of (output, actual); word arrays are made once."""
    e, a = T.words(F.col("output")), T.words(F.col("actual"))
    d = preds.withColumn("e", e).withColumn("a", a).withColumn("ne", T.normalize_ascii(F.col("output"))).withColumn("na", T.normalize_ascii(F.col("actual")))
    return d.select(
        *preds.columns,
        (F.col("output") == F.col("actual")).alias("exact_match"),
        (F.col("ne") == F.col("na")).alias("normalized_match"),
        T.error_rate(T.word_errors(F.col("e"), F.col("a")), F.size("e"), F.size("a") == 0).alias("wer"),
        (F.size("a") / F.greatest(F.lit(1), F.size("e"))).alias("token_ratio"),
        T.has_artifact(F.col("na")).alias("artifact"),
        T.token_recall(T.content_tokens(F.col("ne")), T.content_tokens(F.col("na"))).alias("token_recall"),
        F.array_except(T.duplications(T.words(F.col("na"))), T.duplications(T.words(F.col("ne")))).alias("new_dups"),
        (F.regexp_replace("ne", "[^a-z0-9]", "") == F.regexp_replace("na", "[^a-z0-9]", "")).alias("same_alnum"),
    )


def verbose(ratio: Column) -> Column:
    return ~ratio.between(0.5, 1.5)


def bucket(s: DataFrame) -> DataFrame:
    """First failure that applies, in order; null for a correct row."""
    kind = (
        F.when(F.col("exact_match"), None)
        .when(F.size("new_dups") > 0, "repetition")
        .when(F.col("token_recall") < 0.8, "information_deletion")
        .when(verbose(F.col("token_ratio")), "verbosity")
        .when(F.col("same_alnum"), "punctuation_only")
        .otherwise("partial_rewrite")
    )
    return s.withColumn("bucket", kind)


def means(s: DataFrame, metrics: tuple = METRICS) -> list[Column]:
    return [F.count("*").alias("n"), *[F.round(F.avg(F.col(m).cast("double")), 6).alias(m) for m in metrics]]


def report(s: DataFrame) -> DataFrame:
    """Means overall, by category, level and combo in one pass."""
    d = s.groupingSets([[], ["category"], ["level"], ["combo"]], "category", "level", "combo")
    out = d.agg(F.grouping_id().alias("gid"), *means(s))
    dim = F.when(F.col("gid") == 7, "overall").when(F.col("gid") == 3, "category").when(F.col("gid") == 5, "level").otherwise("combo")
    return out.select(dim.alias("dimension"), F.coalesce("category", "level", "combo").alias("value"), "n", *METRICS)
