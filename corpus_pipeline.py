"""Raw documents to packed training sequences, in five stages. Each stage's result is written as Parquet and reread.

Cases, in every stage: a null text counts as empty and quality drops it; rows without a doc_id count as any other; repeated rows and copies
leave one of them, that of the smallest doc_id, where there is one; a very long text is read whole, and cut in pieces only by pack; ties fall as
each operator states; an empty table gives an empty result; other columns than text (and n_chars, which follows it) are carried as they are, whatever their
names.

STAGES: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
ORACLE_SQL is None: the packing and the extraction of personal data are not expressible in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from speechloom.llm import mixing, packing, pii, quality_rules, simhash_dedup
from speechloom.llm.queries import tokenizer_path
from speechloom.llm.storage import small_batches, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash_dedup.dedup(spark, docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pii.redact(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(spark, docs, tokenizer_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
