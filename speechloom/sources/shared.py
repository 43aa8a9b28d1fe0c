"""Checkpoints of plans that are read more than once, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set where it is missing."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """The rows of df from Parquet files in the checkpoint folder: later reads repeat none of its work and take only the columns they need."""
    path = f"{_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from a checkpoint in spark.checkpoint.dir: nothing before it is planned or computed again, and lost executors cost nothing.

    Where the setting is missing, a local session uses a folder of the warehouse; on a cluster that is an error, since executors might not share it.
    """
    _folder(df.sparkSession)
    return df.checkpoint()
