"""Streams of predictions and references: rows once, sessions, joins by time, and a sink that a repeated batch does not double.

Watermarks bound the state of every function here; rows later than the watermark are dropped. Rows with a null key or time: ``once``
treats null keys as one key; ``matched`` gives a prediction with a null id or time as unmatched, if it is not late.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def once(stream: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key; its repetitions are known as long as the watermark may still let one in."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, key: str, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key, ended by a gap without rows: start, end, rows, share of exact answers."""
    s = stream.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("s"))
    exact = (F.col("output") == F.col("actual")).cast("double")
    return s.agg(F.count("*").alias("n"), F.avg(exact).alias("exact_match")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "exact_match")


def matched(predictions: DataFrame, references: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Predictions (utt_id, actual, ts) with the reference (utt_id, output, ts) that came up to so long before them, or with null.

    Both sides are held only as long as a partner can still come: the condition bounds the distance of their times.
    """
    p = predictions.select("utt_id", "actual", "ts").withWatermark("ts", late)
    r = references.select(F.col("utt_id").alias("ref_id"), "output", F.col("ts").alias("ref_ts")).withWatermark("ref_ts", late)
    near = F.expr(f"utt_id = ref_id AND ref_ts <= ts AND ref_ts >= ts - interval {within}")
    return p.join(r, near, "left_outer").select("utt_id", "ts", "output", "actual")


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: a batch owns the folder of its id, so that a batch run again replaces what it left."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def sink(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Appends the stream to path, each row once however often the query is stopped and started again from its checkpoint."""
    return stream.writeStream.foreachBatch(write_batch(path)).option("checkpointLocation", checkpoint).outputMode("append")


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the sink wrote, with the id of the batch."""
    return spark.read.schema(f"{schema}, batch_id long").parquet(path)
