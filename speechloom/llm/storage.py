"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import gc
import pickle
import uuid
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What splits words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_RE = "[ \\t-\\r]+"
WORD_RE = "[^ \\t-\\r]+"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of the warehouse, which executors share as well."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get() if held.isDefined() else spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def release(spark: SparkSession) -> None:
    """Shuffle files of plans that nothing refers to any more are deleted now, not when the driver's memory next runs short."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts are kept to so many rows: their size in memory follows it in the JVM and in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class Table:
    """A DataFrame written as Parquet and read back; ``drop`` removes the files."""

    def __init__(self, spark: SparkSession, df: DataFrame):
        self.spark, self.path = spark, f"{shared_dir(spark)}/loom/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The rows of df from a written table: later reads neither repeat its work nor depend on executors' disks."""
    return Table(spark, df).df


class Sent:
    """A value on every executor, its classes with it, so that executors need no copy of the package."""

    def __init__(self, spark: SparkSession, value: Any):
        self.held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self) -> Any:
        return pickle.loads(self.held.value)


def with_groups(spark: SparkSession, rows: DataFrame, key: str, spread: list[str], aggregates: list, keep: str) -> DataFrame:
    """rows with the aggregates of their group by the long column key, where keep holds; no key gathers many rows in one task.

    Groups are aggregated before they are shuffled. Keys with more than one in 10,000 of the rows of kept groups (so 10,000 keys at
    most) are joined by broadcast, and their rows are spread by the columns given instead of the key.
    """
    groups = written(spark, rows.groupBy(key).agg(F.count("*").alias("__n"), *aggregates).where(keep))
    release(spark)
    return with_rows(rows, groups, key, spread)


def with_rows(rows: DataFrame, groups: DataFrame, key: str, spread: list[str]) -> DataFrame:
    """rows with the columns of their row in groups: a written table of the long column key, __n (the rows that have it) and others.

    Rows whose key is not in groups go. Keys with more than one in 10,000 of the rows of groups are joined by broadcast, as above.
    """
    names = [c for c in groups.columns if c not in (key, "__n")]
    total = groups.agg(F.sum("__n")).first()[0] or 0
    hot = groups.where(F.col("__n") > max(1000, total // 10_000)).select(F.col(key).alias("__hot"), F.struct(*names).alias("__h"))
    cold = groups.where(F.col("__n") <= max(1000, total // 10_000)).select(F.col(key).alias("__key"), F.struct(*names).alias("__c"))
    r = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    r = r.withColumn("__at", F.when(F.col("__hot").isNull(), F.col(key)).otherwise(F.xxhash64(*spread)))
    r = r.join(cold.hint("merge"), F.col("__at") == F.col("__key"), "left").withColumn("__g", F.coalesce("__h", "__c")).where("__g is not null")
    return r.select(*rows.columns, *[F.col("__g").getField(c).alias(c) for c in names])
