"""Queries over entity spans: values of a lexicon found in utterances, overlaps resolved, both with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities as E
from ..operators.dictionary import dictionary
from ..registry import query
from ..sources.views import SQL, table, utterances


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What benchmark texts say: words of five letters or more in any case, pairs of words, capitalised words as they are written."""
    runs = F.expr("regexp_extract_all(text, '[A-Za-z]+', 0)")
    w = table(spark, sf_dir, "benchmark").select(runs.alias("w"))
    words = w.select(F.explode("w").alias("v")).where("length(v) >= 5")
    pairs = w.where("size(w) > 1").select(F.explode(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b))).alias("v"))
    entry = lambda d, kind, rank, cased, v: d.select(F.lit(kind).alias("kind"), v.alias("value"), F.lit(rank).alias("rank"), F.lit(cased).alias("cased"))
    v = F.col("v")
    return entry(pairs, "pair", 0, False, F.lower(v)).union(entry(words.where("v rlike '^[A-Z]'"), "title", 1, True, v)).union(entry(words, "word", 2, False, F.lower(v))).distinct()


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """utt_id, found: every occurrence of every value of the lexicon in every utterance."""
    find = dictionary(lexicon(spark, sf_dir))
    return utterances(spark, sf_dir).select("utt_id", find(F.col("text")).alias("found"))


_RUN = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+"
_SPANS = (
    f"{SQL['utt']}, b AS (SELECT regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark),"
    " lw AS (SELECT DISTINCT v FROM (SELECT unnest(w) AS v FROM b) WHERE length(v) >= 5),"
    " lex AS (SELECT DISTINCT * FROM (SELECT 'word' AS kind, lower(v) AS value, 2 AS rank FROM lw UNION ALL SELECT 'title', v, 1 FROM lw WHERE regexp_matches(v, '^[A-Z]') UNION ALL"
    " SELECT 'pair', lower(unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))), 0 FROM b)),"
    f" runs AS (SELECT utt_id, regexp_extract_all(text, '{_RUN}') AS r FROM utt), places AS (SELECT utt_id, r, unnest(range(1, len(r) + 1)) AS i FROM runs),"
    " units AS (SELECT utt_id, length(array_to_string(r[1:i - 1], '')) AS start, r[i] AS one, CASE WHEN r[i + 1] = ' ' THEN r[i] || ' ' || r[i + 2] END AS two FROM places),"
    " spans AS (SELECT utt_id, start::INT AS start, (start + length(value))::INT AS \"end\", kind, CASE WHEN kind = 'pair' THEN two ELSE one END AS raw, rank FROM units JOIN lex ON value = CASE kind WHEN 'pair' THEN lower(two) WHEN 'word' THEN lower(one) ELSE one END)"
)


@query(f"WITH {_SPANS} SELECT * FROM spans")
def q_dictionary_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence, overlapping ones too, with its place in the utterance."""
    return spans(spark, sf_dir).select("utt_id", F.explode("found").alias("s")).select("utt_id", "s.*")


@query(
    f"WITH RECURSIVE {_SPANS}, c AS (SELECT utt_id, list({{'start': start, 'end': \"end\", 'kind': kind, 'raw': raw}} ORDER BY \"end\" - start DESC, start, rank) AS s FROM spans GROUP BY utt_id),"
    " kept AS (SELECT utt_id, s, 1 AS i, s[1:0] AS k FROM c UNION ALL"
    " SELECT utt_id, s, i + 1, CASE WHEN len(list_filter(k, lambda x: x.start < s[i].\"end\" AND s[i].start < x.\"end\")) > 0 THEN k ELSE list_append(k, s[i]) END FROM kept WHERE i <= len(s)),"
    " done AS (SELECT utt_id, unnest(k) AS x FROM kept WHERE i = len(s) + 1) SELECT utt_id, x.start AS start, x.\"end\" AS \"end\", x.kind AS kind, x.raw AS raw FROM done"
)
def q_span_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The disjoint spans that stay: longest first, then leftmost, then by rank."""
    return spans(spark, sf_dir).select("utt_id", F.explode(E.resolve(F.col("found"))).alias("s")).select("utt_id", "s.*")
