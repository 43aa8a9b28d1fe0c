"""Queries that score predictions: error rates, reports, buckets, model comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics
from ..registry import query
from ..sources import io
from ..sources.views import LEVELS, SQL, predictions, table, turns

_W = "list_filter(string_split({t}, ' '), lambda x: x <> '')"
_TOK = "regexp_extract_all({t}, '[a-z0-9'']+')"
_NORMAL = "regexp_replace(trim(lower({t})), '[ \\t]+', ' ', 'g')"
_PICK = "array_to_string(list_transform({x}, lambda w: chr((list_position(known, w) + 31)::INTEGER)), '')"
_ART = " OR ".join(f"starts_with(na, '{p.replace(chr(39), chr(39) * 2)}') OR ends_with(na, '{p.replace(chr(39), chr(39) * 2)}')" for p in T.ARTIFACTS)
_DUPS = "list_distinct(list_concat([{w}[i] for i in range(1, len({w})) if {w}[i] = {w}[i+1]], [{w}[i] || ' ' || {w}[i+1] for i in range(1, len({w}) - 2) if {w}[i] = {w}[i+2] AND {w}[i+1] = {w}[i+3]]))"
_RECALL = "CASE WHEN len(te) = 0 THEN 1.0 ELSE list_sum(list_transform(list_distinct(te), lambda x: least(len(list_filter(te, lambda y: y = x)), len(list_filter(ta, lambda y: y = x)))))::DOUBLE / len(te) END"
#: Scores in SQL; words and characters become ASCII signs by their rank, since DuckDB's levenshtein counts bytes.
_SCORED = (
    SQL["preds"]
    + f", p0 AS (SELECT *, {_W.format(t='output')} AS e, {_W.format(t='actual')} AS a, {_NORMAL.format(t='output')} AS ne, {_NORMAL.format(t='actual')} AS na FROM preds)"
    + f", p1 AS (SELECT *, list_distinct(list_concat(e, a)) AS known, {_TOK.format(t='ne')} AS te, {_TOK.format(t='na')} AS ta, {_W.format(t='ne')} AS we, {_W.format(t='na')} AS wa FROM p0)"
    + f", scored AS (SELECT utt_id, lang, category, level, combo, output, actual, output = actual AS exact_match, ne = na AS normalized_match,"
    + f" CASE WHEN len(e) = 0 THEN CASE WHEN len(a) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein({_PICK.format(x='e')}, {_PICK.format(x='a')})::DOUBLE / len(e) END AS wer, len(a)::DOUBLE / greatest(1, len(e)) AS token_ratio,"
    + f" ({_ART}) AS artifact, {_RECALL} AS token_recall, list_filter({_DUPS.format(w='wa')}, lambda x: NOT list_contains({_DUPS.format(w='we')}, x)) AS new_dups, regexp_replace(ne, '[^a-z0-9]', '', 'g') = regexp_replace(na, '[^a-z0-9]', '', 'g') AS same_alnum FROM p1)"
    + ", bucketed AS (SELECT *, CASE WHEN exact_match THEN NULL WHEN len(new_dups) > 0 THEN 'repetition' WHEN token_recall < 0.8 THEN 'information_deletion' WHEN token_ratio < 0.5 OR token_ratio > 1.5 THEN 'verbosity' WHEN same_alnum THEN 'punctuation_only' ELSE 'partial_rewrite' END AS bucket FROM scored)"
)
_MEANS = "count(*) AS n, " + ", ".join(f"round(avg({m}::INTEGER::DOUBLE), 6) AS {m}" if m in ("exact_match", "normalized_match", "artifact") else f"round(avg({m}), 6) AS {m}" for m in metrics.METRICS)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.scored(predictions(spark, sf_dir))


@query(f"WITH {_SCORED} SELECT utt_id, round(wer, 6) AS wer FROM scored")
def q_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("utt_id", F.round("wer", 6).alias("wer"))


_CHARS = "list_distinct(list_concat(string_split(output, ''), string_split(actual, '')))"
_CODED = "array_to_string(list_transform(string_split({x}, ''), lambda c: chr((list_position(known, c) + 31)::INTEGER)), '')"


@query(
    f"WITH {SQL['preds']}, k AS (SELECT utt_id, output, actual, {_CHARS} AS known FROM preds) SELECT utt_id, round(levenshtein({_CODED.format(x='output')}, {_CODED.format(x='actual')})::DOUBLE / length(output), 6) AS cer,"
    f" round(levenshtein({_CODED.format(x='trim(output)')}, {_CODED.format(x='trim(actual)')})::DOUBLE / length(trim(output)), 6) AS ned FROM k"
)
def q_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    rate = lambda a, b: F.round(T.error_rate(T.edit_distance(a, b), F.length(a), F.length(b) == 0), 6)
    d = p.select("utt_id", "output", "actual", rate(F.col("output"), F.col("actual")).alias("cer"))
    same = (F.col("output") == F.trim("output")) & (F.col("actual") == F.trim("actual"))  # nothing to trim: the distance is known
    return d.select("utt_id", "cer", F.when(same, F.col("cer")).otherwise(rate(F.trim("output"), F.trim("actual"))).alias("ned"))


@query(f"WITH {SQL['turns']}, t AS (SELECT conv_id, turn, {_TOK.format(t='lower(input)')} AS te, {_TOK.format(t='lower(output)')} AS ta FROM turns) SELECT conv_id, turn, round({_RECALL}, 6) AS recall FROM t")
def q_token_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    return t.select("conv_id", "turn", F.round(T.token_recall(T.content_tokens(F.lower("input")), T.content_tokens(F.lower("output"))), 6).alias("recall"))


@query(f"WITH {_SCORED} SELECT utt_id, round(token_ratio, 6) AS token_ratio, token_ratio < 0.5 OR token_ratio > 1.5 AS verbose, artifact FROM scored")
def q_verbosity_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("utt_id", F.round("token_ratio", 6).alias("token_ratio"), metrics.verbose(F.col("token_ratio")).alias("verbose"), "artifact")


@query(f"WITH {_SCORED} SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(level) = 0 THEN 'level' WHEN grouping(combo) = 0 THEN 'combo' ELSE 'overall' END AS dimension, coalesce(category, level, combo) AS value, {_MEANS} FROM scored GROUP BY GROUPING SETS ((), (category), (level), (combo))")
def q_metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.report(_scored(spark, sf_dir))


@query(f"WITH {_SCORED}, dim AS (SELECT unnest({[*LEVELS, 'unseen']!r}) AS level) SELECT dim.level, count(scored.utt_id) AS n, round(avg(exact_match::INTEGER::DOUBLE), 6) AS exact_match, round(avg(wer), 6) AS wer FROM dim LEFT JOIN scored USING (level) GROUP BY dim.level")
def q_level_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = spark.createDataFrame([(x,) for x in (*LEVELS, "unseen")], "level string")
    s = _scored(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg(F.col("exact_match").cast("double")), 6).alias("exact_match"), F.round(F.avg("wer"), 6).alias("wer"))
    return dim.join(s, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"), "exact_match", "wer")


@query(f"WITH {_SCORED} SELECT combo, count(*) AS n, round(avg((len(new_dups) = 0 AND token_recall >= 0.8 AND NOT artifact)::INTEGER::DOUBLE), 6) AS compositional FROM scored WHERE category = 'mixed' GROUP BY ROLLUP (combo)")
def q_compositional(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = (F.size("new_dups") == 0) & (F.col("token_recall") >= 0.8) & ~F.col("artifact")
    return _scored(spark, sf_dir).where("category = 'mixed'").rollup("combo").agg(F.count("*").alias("n"), F.round(F.avg(ok.cast("double")), 6).alias("compositional"))


@query(f"WITH {_SCORED}, dim AS (SELECT unnest({list(metrics.BUCKETS)!r}) AS bucket), t AS (SELECT count(*) AS total FROM bucketed) SELECT dim.bucket, count(b.utt_id) AS n, round(count(b.utt_id)::DOUBLE / max(total), 6) AS rate FROM dim CROSS JOIN t LEFT JOIN bucketed b ON b.bucket = dim.bucket GROUP BY dim.bucket")
def q_failure_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = metrics.bucket(_scored(spark, sf_dir)).groupBy("bucket").agg(F.count("*").alias("n"))
    counts = counts.withColumn("total", F.sum("n").over(W.partitionBy(F.lit(0))))  # six rows
    dim = spark.createDataFrame([(x,) for x in metrics.BUCKETS], "bucket string")
    total = counts.agg(F.first("total").alias("t"))
    return dim.join(counts, "bucket", "left").join(F.broadcast(total)).select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.col("t"), 6).alias("rate"))


@query(f"WITH {_SCORED} SELECT bucket, utt_id, actual FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY utt_id) AS rn FROM bucketed WHERE bucket IS NOT NULL) WHERE rn <= 20")
def q_failure_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.review(metrics.bucket(_scored(spark, sf_dir)), "utt_id").select("bucket", "utt_id", "actual")


@query(f"WITH {_SCORED}, m AS (SELECT *, 'model_' || ({{d}} % 3) AS model FROM scored) SELECT model, {_MEANS} FROM m GROUP BY model".replace("{d}", "('0x' || substr(md5('42:' || utt_id || ':model'), 1, 15))::BIGINT"))
def q_model_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    model = F.concat(F.lit("model_"), F.pmod(T.draw(F.col("utt_id"), "model"), F.lit(3)).cast("string"))
    return s.groupBy(model.alias("model")).agg(*metrics.means(s))


@query(f"WITH {SQL['preds']}, h AS (SELECT utt_id, output FROM preds WHERE {{d}} % 2 = 0), r AS (SELECT utt_id, actual FROM preds) SELECT count(*) AS rows, count(h.utt_id) AS joined, sum(CASE WHEN h.output = r.actual THEN 1 ELSE 0 END)::BIGINT AS exact FROM r LEFT JOIN h USING (utt_id)".replace("{d}", "('0x' || substr(md5('42:' || utt_id || ':hold'), 1, 15))::BIGINT"))
def q_holdout_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions joined with the hold-out by id; rows of unknown ids are counted, not dropped in silence."""
    p = predictions(spark, sf_dir)
    hold = p.where(F.pmod(T.draw(F.col("utt_id"), "hold"), F.lit(2)) == 0).select("utt_id", "output", F.lit(1).alias("known"))
    j = p.select("utt_id", "actual").join(hold, "utt_id", "left")
    return j.agg(F.count("*").alias("rows"), F.count("known").alias("joined"), F.sum(F.when(F.col("output") == F.col("actual"), 1).otherwise(0)).alias("exact"))
