"""Queries over plans: quotas and combinations, and real texts assigned to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bank
from ..operators.bank import DOMAINS
from ..operators.pools import Pools
from ..registry import query
from ..sources.io import RECORD
from ..sources.shared import cut, stored
from ..sources.views import SQL, sql_draw, table, utterances
from . import allocate, generate, reuse
from .quota import RATIOS
from .template_queries import quoted


def _segments(shares: str) -> str:
    return f"seg AS (SELECT *, (sum(n) OVER (ORDER BY no) - n)::BIGINT AS first FROM ({shares}))"


def _level(weights: str) -> str:
    u = f"{sql_draw('key', 'level')} % 100"
    return f"CASE WHEN {u} < {weights}[1] THEN 'easy' WHEN {u} < {weights}[1] + {weights}[2] THEN 'medium' ELSE 'hard' END"


def _half_even(x: str) -> str:
    """Python's round of a positive number."""
    return f"CASE WHEN {x} - floor({x}) = 0.5 THEN 2 * round({x} / 2) ELSE round({x}) END::BIGINT"


_TOTAL = "(SELECT count(*) FROM {t})"
_NUMBERED = "rows AS (SELECT {id} AS id, row_number() OVER (ORDER BY md5({id}::VARCHAR), {id}) - 1 AS i FROM {t})"
_KEYED = "keyed AS (SELECT *, 'plan:42:' || lpad(i::VARCHAR, 6, '0') AS key FROM rows), placed AS (SELECT k.*, s.*, k.i - s.first AS place FROM keyed k JOIN seg s ON k.i >= s.first AND k.i < s.first + s.n)"


def _category_sql(t: str) -> str:
    total = _TOTAL.format(t=t)
    share = dict(allocate.CATEGORY_SHARES)
    n = {c: f"({_half_even(f'{total} * {p}::DOUBLE')})" for c, p in share.items()}
    n["mixed"] = f"({total} - " + " - ".join(v for c, v in n.items() if c != "mixed") + ")"
    same = _half_even(f"{n['basic']} * {allocate.IDENTITY}::DOUBLE")
    rows = [("basic", f"({same})", "[['noop', '']]", "basic", True, False, False), ("basic", f"({n['basic']} - ({same}))", "[['filler', 'filler'], ['filler', 'filler'], ['repetition', 'repetition']]", None, False, False, False), ("filler", n["filler"], "[['filler', 'filler']]", "filler", False, False, False)]
    for c, x in (("repetition", "repetition"), ("correction", "self_correction"), ("reformulation", "reformulation")):
        own = _half_even(f"{n[c]} * {1 - allocate.PRESERVED}::DOUBLE")
        rows += [(c, f"({own})", f"[['{x}', '{x}']]", c, False, False, False), (c, f"({n[c]} - ({own}))", "[['filler', 'filler']]", None, False, True, False)]
    rows.append(("formatting", n["formatting"], "[['formatting', 'formatting']]", "formatting", False, False, False))
    rows.append(("long", n["long"], "[['filler', 'filler'], ['filler', 'filler'], ['filler+repetition', 'filler,repetition']]", "long", False, False, True))
    for i, c in enumerate(allocate.COMBOS):
        rows.append(("mixed", f"({n['mixed']} // 10 + ({n['mixed']} % 10 > {i})::INT)", f"[['{c}', '{','.join(allocate.combo_transforms(c))}']]", "mixed", False, False, c.endswith("+long")))
    levels = lambda c: list(allocate.CATEGORY_LEVELS[c]) if c else [100, 0, 0]
    return " UNION ALL ".join(f"SELECT {i} AS no, '{c}' AS category, {k} AS n, {turns} AS turns, {levels(lv)} AS levels, {a} AS identity, {b} AS preservation, {e} AS longform" for i, (c, k, turns, lv, a, b, e) in enumerate(rows))


@query(
    f"WITH {_segments(_category_sql('orders'))}, {_NUMBERED.format(id='o_orderkey', t='orders')}, {_KEYED}, t AS (SELECT *, turns[1 + place % len(turns)] AS turn FROM placed)"
    f" SELECT category, turn[1] AS kind, turn[2] AS transforms, CASE WHEN category = 'mixed' THEN turn[1] END AS combo, identity, preservation, longform, {_level('levels')} AS difficulty, {quoted(DOMAINS)}[1 + i % {len(DOMAINS)}] AS domain, count(*) AS n, min(id) AS first_id FROM t GROUP BY ALL"
)
def q_category_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a plan by the shares of categories and the matrix of combinations; plans by what they hold."""
    rows = allocate.numbered(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id")
    p = allocate.assign(rows, allocate.by_category(rows.count()))
    return p.groupBy("category", "kind", F.array_join("transforms", ",").alias("transforms"), "combo", "identity", "preservation", "longform", "difficulty", "domain").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def _bucket_sql(t: str) -> str:
    total = _TOTAL.format(t=t)
    n = {b: f"({_half_even(f'{total} * {p}::DOUBLE')})" for b, p in RATIOS}
    n["noop"] = f"({total} - " + " - ".join(v for b, v in n.items() if b != "noop") + ")"
    turns = {"noop": "[['noop', '']]", "simple": "[['filler', 'filler'], ['repetition', 'repetition']]", "correction": "[['self_correction', 'self_correction'], ['reformulation', 'reformulation']]", "formatting": "[['formatting', 'formatting']]"}
    turns["compositional"] = "[" + ", ".join(f"['{c}', '{','.join(allocate.combo_transforms(c))}']" for c, _ in allocate.BUCKET_COMBOS) + "]"
    real = lambda b: "0" if b == "formatting" else f"floor({n[b]} * {allocate.REAL}::DOUBLE)::BIGINT"
    return " UNION ALL ".join(f"SELECT {i} AS no, '{b}' AS bucket, {n[b]} AS n, {turns[b]} AS turns, {list(allocate.BUCKET_LEVELS[b])} AS levels, {real(b)} AS real" for i, b in enumerate(n))


_U = f"{sql_draw('key', 'combo')} % 100"
_COMBO = f"CASE WHEN {_U} < 30 THEN 1 WHEN {_U} < 60 THEN 2 WHEN {_U} < 85 THEN 3 ELSE 4 END"
_BUCKETS = (
    f"{_segments(_bucket_sql('documents'))}, {_NUMBERED.format(id='doc_id', t='documents')}, {_KEYED}, plans AS (SELECT id, i, key, bucket, place, turn[1] AS kind, CASE WHEN turn[2] = '' THEN []::VARCHAR[] ELSE string_split(turn[2], ',') END AS transforms, {_level('levels')} AS difficulty,"
    f" CASE WHEN place < real THEN 'real' ELSE 'template' END AS source, CASE bucket WHEN 'noop' THEN 'basic' WHEN 'compositional' THEN 'mixed' ELSE CASE turn[1] WHEN 'self_correction' THEN 'correction' ELSE turn[1] END END AS category FROM (SELECT *, turns[CASE WHEN bucket = 'compositional' THEN {_COMBO} ELSE 1 + place % len(turns) END] AS turn FROM placed))"
)


def bucket_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a plan by the shares of buckets."""
    rows = allocate.numbered(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "id")
    return allocate.assign(rows, allocate.by_bucket(rows.count()))


@query(f"WITH {_BUCKETS} SELECT id AS doc_id, bucket, category, kind, array_to_string(transforms, ',') AS transforms, difficulty, source, place FROM plans")
def q_bucket_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bucket_plans(spark, sf_dir)
    return p.select(F.col("id").alias("doc_id"), "bucket", "category", "kind", F.array_join("transforms", ",").alias("transforms"), "difficulty", "source", "place")


def matched(spark: SparkSession, sf_dir: str, said: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Real plans with their texts (said, or all utterances), and the texts; a number in a text stands for its value."""
    said = utterances(spark, sf_dir) if said is None else said
    texts = said.select(F.col("utt_id").alias("text_id"), "words", F.when(F.col("text").rlike("[0-9]"), 1).otherwise(0).alias("kinds"))
    p = bucket_plans(spark, sf_dir).where("source = 'real'").select("id", "key", "identity", F.array_contains("transforms", "self_correction").alias("needs_value"))
    p = p.withColumnsRenamed({"key": "order", "id": "key"})  # ids are unique, keys are not beyond a million plans
    return reuse.match(p, texts, order="order").withColumnRenamed("key", "id"), texts


_MATCHED = (
    f"{SQL['utt']}, {_BUCKETS}, need AS (SELECT id, key, bucket = 'noop' AS same, list_contains(transforms, 'self_correction') AS needs FROM plans WHERE source = 'real'),"
    " pr AS (SELECT *, row_number() OVER (PARTITION BY same, NOT same AND needs ORDER BY md5(key), key) - 1 AS rank FROM need), slot AS (SELECT utt_id, use_no, regexp_matches(text, '[0-9]') AS value, use_no || ':' || utt_id AS name FROM utt, range(3) u(use_no) WHERE words <= 60),"
    " same_slot AS (SELECT utt_id, 0 AS use_no, row_number() OVER (ORDER BY md5(utt_id), utt_id) - 1 AS rank FROM utt WHERE words <= 30), value_slot AS (SELECT *, row_number() OVER (ORDER BY use_no, md5(name), name) - 1 AS rank FROM slot WHERE value),"
    " first AS (SELECT p.id, v.utt_id, v.use_no, v.name FROM pr p JOIN value_slot v ON v.rank = p.rank WHERE NOT p.same AND p.needs), left_slot AS (SELECT *, row_number() OVER (ORDER BY use_no, md5(name), name) - 1 AS rank FROM slot WHERE name NOT IN (SELECT name FROM first)),"
    " taken AS (SELECT p.id, s.utt_id, s.use_no FROM pr p JOIN same_slot s ON s.rank = p.rank WHERE p.same UNION ALL SELECT id, utt_id, use_no FROM first UNION ALL SELECT p.id, s.utt_id, s.use_no FROM pr p JOIN left_slot s ON s.rank = p.rank WHERE NOT p.same AND NOT p.needs)"
)


@query(f"WITH {_MATCHED} SELECT n.id AS doc_id, same AS identity, needs AS needs_value, utt_id, use_no::INT AS use_no FROM need n LEFT JOIN taken t ON t.id = n.id")
def q_plan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that every real plan takes: none for more than three plans and one identity plan."""
    m, _ = matched(spark, sf_dir)
    return m.select(F.col("id").alias("doc_id"), "identity", "needs_value", F.col("text_id").alias("utt_id"), "use_no")


@query(
    f"WITH {_MATCHED}, s AS (SELECT true AS identity, count(*) FILTER (WHERE words <= 30) AS slots FROM utt UNION ALL SELECT false, 3 * count(*) FILTER (WHERE words <= 60) FROM utt), p AS (SELECT same AS identity, count(*) AS plans, count(utt_id) AS matched FROM need LEFT JOIN taken USING (id) GROUP BY same)"
    " SELECT identity, coalesce(plans, 0) AS plans, coalesce(matched, 0) AS matched, slots, slots - coalesce(matched, 0) AS unused FROM s LEFT JOIN p USING (identity)"
)
def q_text_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.usage(*matched(spark, sf_dir))


@query(
    f"WITH {_segments(_bucket_sql('orders'))}, {_NUMBERED.format(id='o_orderkey', t='orders')}, {_KEYED} SELECT bucket, CASE WHEN place < real THEN 'real' ELSE 'template' END AS source, count(*) AS n, min(i) AS first FROM placed GROUP BY ALL"
)
def q_quota_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of every order by bucket and source."""
    rows = allocate.numbered(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id")
    return allocate.assign(rows, allocate.by_bucket(rows.count())).groupBy("bucket", "source").agg(F.count("*").alias("n"), F.min("i").alias("first"))


@query(
    f"WITH {SQL['utt']}, slots AS (SELECT utt_id, use_no, row_number() OVER (ORDER BY use_no, md5(use_no || ':' || utt_id), utt_id) - 1 AS place FROM utt, range(3) u(use_no)), plans AS (SELECT o_orderkey AS i, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) - 1 AS place FROM orders)"
    " SELECT i, utt_id, use_no::INT AS use_no FROM plans LEFT JOIN slots USING (place)"
)
def q_plan_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A use of a text for every order as a plan, while there are any."""
    texts = utterances(spark, sf_dir).select(F.col("utt_id").alias("text_id"), "words", F.lit(0).alias("kinds"))
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit(False).alias("identity"), F.lit(False).alias("needs_value"))
    return reuse.match(p, texts).select(F.col("key").alias("i"), F.col("text_id").alias("utt_id"), "use_no")


def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the benchmark as outputs that no record may have."""
    return table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("t")).select(F.trim("t").alias("output"))


def compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every document as a plan: real ones say utterances, others templates and formatting commands. Near duplicates are made again once, then dropped."""
    texts = stored(utterances(spark, sf_dir).select("utt_id", "text", "words"))
    real, _ = matched(spark, sf_dir, texts)
    plans = bucket_plans(spark, sf_dir).join(real.select("id", F.col("text_id").alias("utt_id")), "id", "left").join(texts.drop("words"), "utt_id", "left").withColumn("key", allocate.plan_key(F.col("i"))).drop("id", "i", "utt_id", "place")
    return generate.compile_records(plans, bank.template_table(spark), Pools(bank.lexicon_table(spark)), holdout(spark, sf_dir), rounds=1)


@query()
def q_compile_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records in their schema, with split and key; tests check the gates, q_compile_summary the counts."""
    names = [c.name for c in spark.createDataFrame([], RECORD).schema]
    return compiled(spark, sf_dir).select(*names, "split", "plan")


@query(
    f"WITH {_BUCKETS} SELECT bucket, count(*) AS planned, count(*) FILTER (WHERE source = 'real') AS planned_real, true AS most_made, true AS split_by_rule, true AS once, true AS not_held_out, true AS real_within_plans FROM plans GROUP BY bucket"
)
def q_compile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans by bucket, and what must hold of their records: nine in ten made, splits of the stated sizes, no pair of input and output twice, none held out, real texts for real plans only."""
    p = bucket_plans(spark, sf_dir)
    planned = p.groupBy("bucket").agg(F.count("*").alias("planned"), F.count(F.when(F.col("source") == "real", 1)).alias("planned_real"))
    r = cut(compiled(spark, sf_dir).select("bucket", "source", "split", "output", generate.pair_key().alias("pair")))
    hits = r.join(holdout(spark, sf_dir).distinct(), "output", "left_semi").groupBy("bucket").agg(F.count("*").alias("hits"))
    pairs = r.groupBy("bucket", "pair").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max("n").alias("most"))
    of = lambda name: F.count(F.when(F.col("split") == name, 1)).alias(name)
    got = r.groupBy("bucket").agg(F.count("*").alias("made"), F.count(F.when(F.col("source") == "real", 1)).alias("made_real"), of("test"), of("validation"))
    d = planned.join(got, "bucket", "left").join(hits, "bucket", "left").join(pairs, "bucket", "left")
    sized = (F.col("test") == F.greatest(F.lit(1.0), F.bround(F.col("made") * 0.05, 0))) & (F.col("validation") == F.bround(F.col("made") * 0.10, 0))
    return d.select("bucket", "planned", "planned_real", (F.col("made") >= 0.9 * F.col("planned")).alias("most_made"), sized.alias("split_by_rule"), (F.col("most") == 1).alias("once"), F.col("hits").isNull().alias("not_held_out"), (F.col("made_real") <= F.col("planned_real")).alias("real_within_plans"))
