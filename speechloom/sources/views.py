"""The given tables as the engine's inputs, each with its SQL (``SQL`` holds them as common table expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import CATEGORIES, COMBOS

LEVELS = ("easy", "medium", "hard", "extreme")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn("text", F.trim("raw")).drop("raw")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible single lines: capital first letter, 3 to 60 words, first occurrence of a text."""
    u = lines(spark, sf_dir).withColumn("words", F.size(T.words(F.col("text"))))
    u = u.where("text rlike '^[A-Z]' and words between 3 and 60")
    first = u.groupBy("text").agg(F.min(F.struct("doc_id", "line_no", "lang", "source", "words")).alias("f"))  # summed before the shuffle, however common a line is
    u = first.select("f.doc_id", "f.lang", "f.source", "f.line_no", "text", "f.words")
    return u.withColumn("utt_id", F.concat_ws("-", "doc_id", "line_no"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances as prediction rows: labels and one of five faults by hash draws."""
    u, k = utterances(spark, sf_dir), F.col("utt_id")
    u = u.select("utt_id", "lang", F.col("text").alias("output"), T.pick(k, "category", CATEGORIES).alias("category"), T.pick(k, "level", LEVELS).alias("level"), T.pick(k, "combo", COMBOS).alias("c"), F.pmod(T.draw(k, "fault"), F.lit(5)).alias("fault"))
    first = F.substring_index("output", " ", 1)
    rest = F.regexp_replace("output", " [^ ]+$", "")
    actual = F.when(F.col("fault") == 0, F.col("output")).when(F.col("fault") == 1, F.concat(first, F.lit(" "), F.col("output"))).when(F.col("fault") == 2, rest).when(F.col("fault") == 3, F.lower("output")).otherwise(F.concat(F.lit("Here is "), F.col("output")))
    return u.select("utt_id", "lang", "category", "level", F.when(F.col("category") == "mixed", F.col("c")).alias("combo"), F.concat(F.lit("um, "), first, F.lit(" "), F.col("output")).alias("input"), "output", actual.alias("actual"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("output"))
    return c.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("input"), "output")


def _choose(key: str, site: str, values: tuple) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"[{items}][1 + {sql_draw(key, site)} % {len(values)}]"


def sql_draw(key: str, site: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key} || ':{site}'), 1, 15))::BIGINT"


SQL = {
    "lines": "lines AS (SELECT doc_id, lang, source, line_no, trim(raw) AS text FROM (SELECT doc_id, lang, source, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS raw FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents)))",
}
SQL["utt"] = SQL["lines"] + (
    ", utt AS (SELECT *, doc_id || '-' || line_no AS utt_id FROM (SELECT *, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS words, row_number() OVER (PARTITION BY text ORDER BY doc_id, line_no) AS rn"
    " FROM lines WHERE regexp_matches(text, '^[A-Z]') AND len(list_filter(string_split(text, ' '), lambda x: x <> '')) BETWEEN 3 AND 60) WHERE rn = 1)"
)
SQL["preds"] = SQL["utt"] + (
    f", lab AS (SELECT utt_id, lang, text AS output, {_choose('utt_id', 'category', CATEGORIES)} AS category, {_choose('utt_id', 'level', LEVELS)} AS level, {_choose('utt_id', 'combo', COMBOS)} AS c, {sql_draw('utt_id', 'fault')} % 5 AS fault FROM utt)"
    ", preds AS (SELECT utt_id, lang, category, level, CASE WHEN category = 'mixed' THEN c END AS combo, 'um, ' || split_part(output, ' ', 1) || ' ' || output AS input, output,"
    " CASE fault WHEN 0 THEN output WHEN 1 THEN split_part(output, ' ', 1) || ' ' || output WHEN 2 THEN regexp_replace(output, ' [^ ]+$', '') WHEN 3 THEN lower(output) ELSE 'Here is ' || output END AS actual FROM lab)"
)
SQL["turns"] = "turns AS (SELECT conv_id, turn, text AS input, output FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS output FROM conversations) WHERE role = 'user' AND next_role = 'assistant')"
