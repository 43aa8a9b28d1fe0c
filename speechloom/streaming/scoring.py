"""Prediction files as a stream: stateless scores, and windowed means that a watermark bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics

SCHEMA = "utt_id string, output string, actual string, ts timestamp"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path)


def scores(stream: DataFrame) -> DataFrame:
    return metrics.scored(stream)


def windowed(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Means by window of event time; rows later than the watermark are dropped, so the state is bounded."""
    s = scores(stream.withWatermark("ts", late))
    return s.groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.avg(F.col("exact_match").cast("double")).alias("exact_match"), F.avg("wer").alias("wer"))
