"""Readers and writers: JSON lines with a schema, splits with manifest and statistics, failure reviews, predictions, configuration."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A training record.
RECORD = (
    "id string, input string, output string, category string, transformations array<string>, num_transformations int, difficulty string, domain string, "
    "entities struct<names:array<string>,dates:array<string>,times:array<string>,numbers:array<string>,locations:array<string>,tech:array<string>,items:array<string>>, "
    "corrections array<struct<abandoned:string,kept:string,kind:string,marker:string,span:array<int>>>, reformulations array<struct<mode:string,abandoned:string,kept:string>>, "
    "formatting struct<type:string,items:array<string>>, preservation_case boolean, preserved array<string>, combo string, template_id string, seed decimal(20,0), generator_version string, bucket string, source string"
)
#: A recipe of transformations.
RECIPE = "recipe_id string, transformations array<struct<type:string,abandoned:string,retained:string,field:string,marker:string,location:string,target:string,kind:string,format_type:string,abandoned_phrase:string,count:int>>, composition_label string, version string, notes string"


def read_records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines with nulls written out and non-ASCII text kept."""
    df.write.option("ignoreNullFields", "false").json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Records with what a model answered; no answer is an empty one."""
    return read_records(spark, path, RECORD + ", actual string").withColumn("actual", F.coalesce("actual", F.lit("")))


def read_splits(spark: SparkSession, root: str) -> DataFrame:
    """All rows below root/split=<name>, with the split as a column."""
    return spark.read.option("basePath", root).schema(RECORD + ", split string").json(root)


def write_splits(df: DataFrame, root: str) -> dict:
    """root/split=<name> as JSON lines; returns the manifest: rows by split and kind (a few numbers)."""
    df.write.partitionBy("split").option("ignoreNullFields", "false").json(root)
    made: dict = {}
    for r in df.groupBy("split", "kind").agg(F.count("*").alias("n")).collect():
        made.setdefault(r["split"], {})[r["kind"]] = r["n"]
    return made


def review(bucketed: DataFrame, order: str, most: int = 20) -> DataFrame:
    """The first ``most`` rows of every bucket by order; rows without a bucket are no failures. Tasks drop what cannot rank before the shuffle."""
    ranked = bucketed.where("bucket is not null").withColumn("__rank", F.row_number().over(W.partitionBy("bucket").orderBy(order)))
    return ranked.where(F.col("__rank") <= most).drop("__rank")


def write_review(bucketed: DataFrame, path: str, order: str = "utt_id", most: int = 20) -> None:
    """At most 20 failures a bucket as CSV, every value quoted."""
    review(bucketed, order, most).write.option("header", "true").option("quoteAll", "true").csv(path)


def recipes_to_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def recipes_from_json(df: DataFrame) -> DataFrame:
    return df.select(F.from_json("value", RECIPE).alias("r")).select("r.*")


@dataclass
class BuildConfig:
    """Knobs of the compile job; unknown keys are refused, values given later win."""

    total: int = 15_000
    real_ratio: float = 0.85
    test: float = 0.05
    validation: float = 0.10
    seed: int = 42
    max_uses: int = 3

    def __post_init__(self) -> None:
        if not (0 <= self.real_ratio <= 1 and 0 <= self.test and 0 <= self.validation and self.test + self.validation < 1 and self.total > 0):
            raise ValueError("ratios must lie in [0, 1] and leave rows to train on")


def load_config(text: str, overrides: list[str] = ()) -> BuildConfig:
    """A JSON object with ``key:value`` overrides, whose values are JSON or else plain strings."""
    values = json.loads(text or "{}")
    for item in overrides:
        key, _, raw = item.partition(":")
        try:
            values[key] = json.loads(raw)
        except ValueError:
            values[key] = raw
    if unknown := values.keys() - {f.name for f in fields(BuildConfig)}:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    return BuildConfig(**values)
