"""The engine in SQL text: its inputs as temporary views, its text functions by name, a table function for entity spans."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .operators import entities as E
from .sources import views

#: Functions in SQL: name and parameters, result, body.
FUNCTIONS = (
    ("entity_share(expected ARRAY<STRING>, actual ARRAY<STRING>)", "DOUBLE", "CASE WHEN size(expected) = 0 THEN 1.0D ELSE size(array_intersect(expected, actual)) / size(expected) END"),
    ("entity_canonical(raw STRING)", "STRING", "lower(regexp_replace(trim(raw), '\\\\s+', ' '))"),
)
VIEWS = {"utterances": views.utterances, "predictions": views.predictions, "turns": views.turns, "lines": views.lines}


def register(spark: SparkSession, sf_dir: str) -> None:
    """Views over the tables of sf_dir, utterance_spans (the resolved spans of each), entity_candidates(text), entity_spans(spans) as a table, and FUNCTIONS, for this session; again is harmless."""
    for name, made in VIEWS.items():
        made(spark, sf_dir).createOrReplaceTempView(name)
    spark.udf.register("entity_candidates", E.candidates)
    for head, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {result} RETURN {body}")
    found = views.utterances(spark, sf_dir).select("utt_id", E.resolve(E.candidates("text")).alias("spans"))
    found.createOrReplaceTempView("utterance_spans")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION entity_spans(found ARRAY<STRUCT<start: INT, end: INT, kind: STRING, raw: STRING>>) RETURNS TABLE(start INT, end INT, kind STRING, raw STRING) RETURN SELECT s.start, s.end, s.kind, s.raw FROM (SELECT explode(found) AS s)")
