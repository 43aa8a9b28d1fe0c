"""Queries over whole records: the metrics of each, the bucket of its failure, the gate of augmented pairs, correction and entity issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import FILLERS
from ..operators import augmented_gate, record_metrics
from ..registry import query
from ..sources.views import SQL, predictions, sql_draw
from .score_queries import _ART, _CHARS, _CODED, _DUPS, _NORMAL, _PICK, _RECALL, _TOK, _W

FORMATS = ("bullet_list", "heading", "polite_message")
STEPS = {"filler": ("filler",), "repetition": ("repetition",), "correction": ("self_correction",), "reformulation": ("reformulation",), "formatting": ("formatting",), "mixed": ("filler", "self_correction")}
#: Long words stand in for entities, so that SQL can extract them too.
LONG_WORD = "[a-z]{9,}"


def _canon(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(T.normalize_ascii(text), F.lit(f"({LONG_WORD})"), F.lit(1))))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as whole records: transformations by category, and one correction, reformulation and format where they belong."""
    p, k = predictions(spark, sf_dir), F.col("utt_id")
    kinds = F.expr("cast(array() as array<string>)")
    for c, steps in STEPS.items():
        kinds = F.when(F.col("category") == c, F.array(*[F.lit(x) for x in steps])).otherwise(kinds)
    first = F.substring_index("output", " ", 1)
    return p.select(
        *p.columns,
        kinds.alias("transformations"),
        F.when(F.col("category").isin("correction", "mixed"), F.array(F.struct(F.lit("Here is").alias("abandoned"), first.alias("kept")))).alias("corrections"),
        F.when(F.col("category") == "reformulation", F.array(F.struct(F.when(F.pmod(T.draw(k, "mode"), F.lit(2)) == 0, "restart").otherwise("hedge").alias("mode"), first.alias("abandoned")))).alias("reformulations"),
        F.when(F.col("category") == "formatting", F.struct(T.pick(k, "format", FORMATS).alias("type"))).alias("formatting"),
        F.array(first).alias("preserved"),
        (F.pmod(T.draw(k, "keep"), F.lit(5)) == 0).alias("preservation_case"),
        _canon(F.col("output")).alias("expected_canon"),
        _canon(F.col("actual")).alias("actual_canon"),
    )


def _choice(site: str, values: tuple) -> str:
    return f"[{', '.join(map(repr, values))}][1 + {sql_draw('utt_id', site)} % {len(values)}]"


_LINES = "list_filter(string_split({t}, chr(10)), lambda x: trim(x) <> '')"
_ITEM = "regexp_matches({x}, '^(-|[0-9]+\\.)\\s')"
_MARKED = "len(list_filter(string_split({t}, chr(10)), lambda x: regexp_matches(x, '^(\\s*(-|[0-9]+\\.)\\s|#{{1,3}}\\s)')))"
_FILL = "list_distinct(regexp_extract_all(regexp_replace({t}, '[ß-öø-ÿĀ-ɏ]', 'x', 'g'), '\\b(?:" + "|".join(sorted(FILLERS, key=len, reverse=True)) + ")\\b'))"
_WITHOUT = "list_filter({x}, lambda z: NOT list_contains({y}, z))"
_PRESENT = "(list_contains(ac, {v}) OR (length({v}) >= 3 AND NOT regexp_matches({v}, '^[0-9]+$') AND contains(na, {v})))"
_CANON = "list_sort(list_distinct(regexp_extract_all({t}, '" + LONG_WORD.replace("{", "{{").replace("}", "}}") + "')))"
_KINDS = "CASE category " + " ".join(f"WHEN '{c}' THEN {list(s)!r}" for c, s in STEPS.items()) + " ELSE []::VARCHAR[] END"
_RECORDS = (
    SQL["preds"]
    + f", r0 AS (SELECT *, {_KINDS} AS tr, split_part(output, ' ', 1) AS first, category IN ('correction', 'mixed') AS corrected, CASE WHEN category = 'reformulation' THEN CASE WHEN {sql_draw('utt_id', 'mode')} % 2 = 0 THEN 'restart' ELSE 'hedge' END END AS mode,"
    + f" CASE WHEN category = 'formatting' THEN {_choice('format', FORMATS)} END AS fmt, {sql_draw('utt_id', 'keep')} % 5 = 0 AS keep, {_NORMAL.format(t='output')} AS ne, {_NORMAL.format(t='actual')} AS na, {_W.format(t='output')} AS e, {_W.format(t='actual')} AS a FROM preds)"
    + f", r1 AS (SELECT *, {_CANON.format(t='ne')} AS ec, {_CANON.format(t='na')} AS ac, {_NORMAL.format(t='first')} AS k, 'here is' AS ab, {_TOK.format(t='ne')} AS te, {_TOK.format(t='na')} AS ta, {_W.format(t='lower(output)')} AS we, {_W.format(t='lower(actual)')} AS wa FROM r0)"
    + f", r2 AS (SELECT *, CASE WHEN corrected THEN list_filter([CASE WHEN NOT {_PRESENT.format(v='k')} THEN 'kept-missing:' || k END, CASE WHEN NOT list_contains(ec, ab) AND NOT contains(ne, ab) AND {_PRESENT.format(v='ab')} THEN 'abandoned-retained:' || ab END], lambda x: x IS NOT NULL) ELSE [] END AS fails,"
    + f" list_filter({_WITHOUT.format(x='ac', y='ec')}, lambda z: NOT (corrected AND z = ab)) AS made_up, ({_ART}) AS artifact_flag, len(a)::DOUBLE / greatest(1, len(e)) AS token_ratio, CASE WHEN len(ec) = 0 THEN 1.0 ELSE len({_WITHOUT.format(x='ec', y=_WITHOUT.format(x='ec', y='ac'))})::DOUBLE / len(ec) END AS entity_preservation,"
    + f" CASE fmt WHEN 'bullet_list' THEN len({_LINES.format(t='actual')}) >= 2 AND len(list_filter({_LINES.format(t='actual')}, lambda z: NOT {_ITEM.format(x='z')})) = 0 WHEN 'heading' THEN len({_LINES.format(t='actual')}) = 1 AND regexp_matches(({_LINES.format(t='actual')})[1], '^#{{1,3}}\\s') WHEN 'polite_message' THEN {_MARKED.format(t='actual')} = 0 ELSE true END AS formatting_ok,"
    + f" contains(na, k) AS preservation_ok, {_WITHOUT.format(x=_DUPS.format(w='wa'), y=_DUPS.format(w='we'))} AS new_dups, {_RECALL} AS token_recall, len({_WITHOUT.format(x=_FILL.format(t='na'), y=_FILL.format(t='ne'))}) AS new_fillers,"
    + " CASE WHEN mode IS NULL OR k = '' THEN true WHEN mode = 'restart' THEN (length(na) - length(replace(na, k, '')))::DOUBLE / length(k) <= 1 ELSE NOT contains(na, k) END AS reformulation_ok, category = 'long' OR coalesce(combo LIKE '%long', false) AS is_long FROM r1)"
    + f", r3 AS (SELECT *, list_distinct(list_concat(e, a)) AS known FROM r2), r4 AS (SELECT * EXCLUDE (known), CASE WHEN len(e) = 0 THEN CASE WHEN len(a) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein({_PICK.format(x='e')}, {_PICK.format(x='a')})::DOUBLE / len(e) END AS wer, {_CHARS} AS known FROM r3)"
    + f", rec AS (SELECT *, levenshtein({_CODED.format(x='output')}, {_CODED.format(x='actual')})::DOUBLE / length(output) AS cer, output = actual AS exact_match, ne = na AS normalized_match, len(fails) = 0 AS correction_resolution, len(made_up) > 0 AS hallucination_flag, NOT (token_ratio BETWEEN 0.5 AND 1.5) AS verbosity_flag,"
    + " CASE WHEN len(tr) = 0 THEN ne = na ELSE NOT (list_contains(tr, 'filler') AND new_fillers > 0) AND NOT (list_contains(tr, 'repetition') AND len(new_dups) > 0) AND NOT (list_contains(tr, 'self_correction') AND len(fails) > 0) AND NOT (list_contains(tr, 'reformulation') AND NOT reformulation_ok)"
    + " AND NOT (list_contains(tr, 'formatting') AND NOT formatting_ok) AND NOT (is_long AND NOT (entity_preservation = 1.0 AND token_ratio >= 0.5)) END AS compositional_pass FROM r4)"
)
_ALNUM = "regexp_replace(lower({t}), '[^a-z0-9]', '', 'g')"
_NEAR = f"len({_WITHOUT.format(x='ec', y='ac')}) > 0 AND len(list_filter({_WITHOUT.format(x='ec', y='ac')}, lambda m: len(list_filter(ac, lambda y: levenshtein(m, y) <= 2)) = 0)) = 0"
_BUCKET = (
    "CASE WHEN NOT correction_resolution THEN 'correction_resolution' WHEN (list_contains(tr, 'repetition') AND len(new_dups) > 0) OR (keep AND NOT preservation_ok) THEN 'repetition_removal' WHEN hallucination_flag THEN 'hallucination' WHEN fmt IS NOT NULL AND NOT formatting_ok THEN 'formatting_failure'"
    f" WHEN {_NEAR} THEN 'entity_corruption' WHEN token_recall < 0.8 AND NOT list_contains(tr, 'self_correction') AND NOT list_contains(tr, 'repetition') THEN 'information_deletion' WHEN is_long AND (token_ratio < 0.5 OR entity_preservation < 1.0) THEN 'long_context_failure'"
    f" WHEN artifact_flag OR token_ratio > 1.5 THEN 'verbosity' WHEN ne <> na AND {_ALNUM.format(t='output')} = {_ALNUM.format(t='actual')} THEN 'punctuation_only' WHEN ne <> na AND token_recall >= 0.9 THEN 'partial_rewrite' END"
)
_MEANS = ", ".join(f"round(avg({m}::DOUBLE), 6) AS {m}" if m in ("wer", "cer", "token_ratio", "entity_preservation") else f"round(avg({m}::INTEGER::DOUBLE), 6) AS {m}" for m in record_metrics.METRICS)


@query(f"WITH {_RECORDS} SELECT category, count(*) AS n, {_MEANS} FROM rec GROUP BY ROLLUP (category)")
def q_record_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of all metrics of a record, by category and over all."""
    s = record_metrics.scored(records(spark, sf_dir))
    return s.rollup("category").agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(m).cast("double")), 6).alias(m) for m in record_metrics.METRICS])


@query(f"WITH {_RECORDS} SELECT utt_id, {_BUCKET} AS bucket, array_to_string(fails, ',') AS failures, array_to_string(list_sort(made_up), ',') AS hallucinated FROM rec")
def q_record_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failure bucket of every record, in order of priority, with what failed."""
    b = record_metrics.bucket(record_metrics.scored(records(spark, sf_dir)))
    return b.select("utt_id", "bucket", F.array_join("correction_failures", ",").alias("failures"), F.array_join("hallucinated", ",").alias("hallucinated"))


@query(
    f"WITH {_RECORDS}, k AS (SELECT {_BUCKET} AS bucket FROM rec), c AS (SELECT bucket, count(*) AS n FROM k GROUP BY bucket), t AS (SELECT count(*) AS records, count(bucket) AS failures FROM k),"
    f" b(place, name, text) AS (VALUES {', '.join(map(str, zip(range(10), record_metrics.BUCKETS, record_metrics.ADVICE, strict=True)))})"
    " SELECT place, name AS bucket, coalesce(n, 0) AS n, round(coalesce(n, 0) / records, 6) AS share, records, failures, round(failures / records, 6) AS failure_rate, CASE WHEN n > 0 THEN text END AS advice FROM b CROSS JOIN t LEFT JOIN c ON c.bucket = b.name"
)
def q_failure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the ten buckets, zeros included, with shares and advice."""
    r = record_metrics.failure_report(record_metrics.bucket(record_metrics.scored(records(spark, sf_dir))))
    return r.withColumns({"share": F.round("share", 6), "failure_rate": F.round("failure_rate", 6)})


#: Kinds of pairs that the gate query makes of utterances, one for each reason code and one that passes.
MADE = ("good", "no_input", "short_output", "modified", "entity_lost", "changed", "unrealized", "unexpected", "incomplete", "identical", "missing", "too_long", "expanded", "one_item", "not_a_list", "not_a_heading")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Augmented pairs of utterances: each kind of MADE by a draw."""
    u, k = predictions(spark, sf_dir).select("utt_id", F.col("output").alias("t")), F.col("utt_id")
    u = u.withColumn("made", T.pick(k, "made", MADE)).withColumn("said", F.concat(F.lit("um, "), F.col("t")))
    made = lambda *names: F.col("made").isin(*names)
    step = lambda kind, a=None, r=None, f=None: F.array(F.struct(F.lit(kind).alias("type"), F.lit(a).cast("string").alias("abandoned"), F.lit(r).cast("string").alias("retained"), F.lit(f).cast("string").alias("format_type")))
    inp = F.when(made("no_input"), "").when(made("unrealized"), F.col("t")).when(made("unexpected"), F.concat(F.col("said"), F.lit(" extraordinary"))).when(made("too_long"), F.repeat(F.concat(F.col("t"), F.lit(" ")), 6)).when(made("expanded"), F.lit("a b c d e f g")).otherwise(F.col("said"))
    out = F.when(made("short_output"), "x").when(made("modified"), F.concat(F.col("t"), F.lit(" now"))).when(made("entity_lost"), F.regexp_replace("t", LONG_WORD, "it")).when(made("expanded"), F.repeat(F.concat(F.col("t"), F.lit(" ")), 20)).when(made("one_item"), F.concat(F.lit("- "), F.col("t"))).when(made("not_a_list"), F.concat(F.col("t"), F.lit("\n- "), F.col("t"))).otherwise(F.col("t"))
    recipe = F.when(made("changed"), F.expr(augmented_gate.NO_RECIPE)).when(made("incomplete"), step("self_correction", "", "x")).when(made("identical"), step("entity_correction", "um", "um")).when(made("missing"), step("phrase_correction", "zebra crossing", "x"))
    recipe = recipe.when(made("one_item", "not_a_list"), step("formatting_command", f="bullet_list")).when(made("not_a_heading"), step("formatting_command", f="heading")).otherwise(step("filler"))
    clean = F.when(made("modified", "entity_lost"), F.col("t"))
    d = u.select("utt_id", "made", inp.alias("input"), out.alias("output"), clean.alias("original_clean"), recipe.alias("recipe"))
    return d.select("*", _canon(F.col("input")).alias("input_canon"), _canon(F.col("output")).alias("output_canon"), _canon(F.coalesce("original_clean", "output")).alias("clean_canon"))


_PAIRS = (
    SQL["preds"]
    + f", m AS (SELECT utt_id, output AS t, 'um, ' || output AS said, {_choice('made', MADE)} AS made FROM preds)"
    + ", p0 AS (SELECT utt_id, made, CASE made WHEN 'no_input' THEN '' WHEN 'unrealized' THEN t WHEN 'unexpected' THEN said || ' extraordinary' WHEN 'too_long' THEN repeat(t || ' ', 6) WHEN 'expanded' THEN 'a b c d e f g' ELSE said END AS input,"
    + f" CASE made WHEN 'short_output' THEN 'x' WHEN 'modified' THEN t || ' now' WHEN 'entity_lost' THEN regexp_replace(t, '{LONG_WORD}', 'it', 'g') WHEN 'expanded' THEN repeat(t || ' ', 20) WHEN 'one_item' THEN '- ' || t WHEN 'not_a_list' THEN t || chr(10) || '- ' || t ELSE t END AS output,"
    + " CASE WHEN made IN ('modified', 'entity_lost') THEN t END AS clean FROM m)"
    + f", p1 AS (SELECT *, {_NORMAL.format(t='input')} AS ni, {_NORMAL.format(t='output')} AS no FROM p0), p2 AS (SELECT *, {_CANON.format(t='ni')} AS ic, {_CANON.format(t='no')} AS oc, {_CANON.format(t=_NORMAL.format(t='coalesce(clean, output)'))} AS cc, len({_W.format(t='input')}) AS wi, len({_W.format(t="replace(output, chr(10), ' ')")}) AS wo, {_LINES.format(t='output')} AS ls FROM p1)"
    + f", reason AS (SELECT *, CASE WHEN input = '' OR output = '' THEN ['MISSING_FIELDS'] WHEN length(trim(input)) < 3 THEN ['EMPTY_INPUT'] WHEN length(trim(output)) < 3 THEN ['EMPTY_OUTPUT'] ELSE list_filter([CASE WHEN clean IS NOT NULL AND trim(output) <> trim(clean) THEN 'TARGET_MODIFIED' END, CASE WHEN len({_WITHOUT.format(x='cc', y='oc')}) > 0 THEN 'ENTITY_LOST' END,"
    + " CASE WHEN made = 'changed' AND ni <> no THEN 'UNEXPECTED_CHANGE' WHEN made <> 'changed' AND ni = no THEN 'TRANSFORMATION_NOT_REALIZED' END,"
    + f" CASE WHEN len(list_filter({_WITHOUT.format(x='ic', y='oc')}, lambda z: NOT ((made = 'identical' AND z = 'um') OR (made = 'missing' AND z = 'zebra crossing')))) > 0 THEN 'UNEXPECTED_ENTITIES' END,"
    + " CASE made WHEN 'incomplete' THEN 'INCOMPLETE_CORRECTION' WHEN 'identical' THEN 'IDENTICAL_CORRECTION' WHEN 'missing' THEN CASE WHEN NOT contains(lower(input), 'zebra crossing') THEN 'ABANDONED_MISSING' END END, CASE WHEN wi > 5 * wo AND wo > 5 THEN 'EXCESSIVE_LENGTH' WHEN wo > 2 * wi AND wi > 5 THEN 'OUTPUT_EXPANDED' END,"
    + f" CASE WHEN made IN ('one_item', 'not_a_list') THEN CASE WHEN len(ls) < 2 THEN 'INVALID_LIST' WHEN len(list_filter(ls, lambda z: NOT {_ITEM.format(x='z')})) > 0 THEN 'INVALID_LIST_FORMAT' END WHEN made = 'not_a_heading' THEN CASE WHEN len(ls) <> 1 OR NOT regexp_matches(ls[1], '^#{{1,3}}\\s') THEN 'INVALID_HEADING' END END], lambda x: x IS NOT NULL) END AS reasons FROM p2)"
)


@query(f"WITH {_PAIRS} SELECT utt_id, made, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS passed, len(list_filter(reasons, lambda x: x IN {augmented_gate.CRITICAL!r})) > 0 AS critical FROM reason")
def q_augmented_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reason codes of the deterministic gate, each made to occur."""
    return augmented_gate.report(pairs(spark, sf_dir)).select("utt_id", "made", F.array_join("reasons", ",").alias("reasons"), "passed", "critical")


@query(
    f"WITH {_RECORDS}, i AS (SELECT *, {_CANON.format(t=_NORMAL.format(t='input'))} AS ic, list_sort(list_distinct(list_concat(ec, CASE WHEN keep THEN ['declared'] ELSE [] END))) AS declared FROM rec), v AS (SELECT *, CASE WHEN len(ec) > 0 THEN coalesce(ac[1], 'none') END AS a4, ec[1] AS k4 FROM i)"
    " SELECT utt_id, CASE WHEN a4 IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN a4 = k4 THEN 'same:' || a4 END, CASE WHEN NOT list_contains(ic, a4) THEN 'not-in-input:' || a4 END, CASE WHEN NOT list_contains(ac, k4) THEN 'not-in-output:' || k4 END, CASE WHEN list_contains(ac, a4) THEN 'leaked:' || a4 END], lambda x: x IS NOT NULL), ',') END AS corrections,"
    f" array_to_string(list_concat(list_transform({_WITHOUT.format(x='declared', y='ac')}, lambda z: 'only-declared:' || z), list_transform({_WITHOUT.format(x='ac', y='declared')}, lambda z: 'only-extracted:' || z)), ',') AS entities FROM v"
)
def q_gate_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correction invariant and entity preservation: the answer as the output, its first long word as what was abandoned for the record's first."""
    r = records(spark, sf_dir).withColumn("input_canon", _canon(F.col("input")))
    none = F.expr("cast(array() as array<struct<abandoned:string,kept:string>>)")
    pair = F.when(F.size("expected_canon") > 0, F.array(F.struct(F.coalesce(F.get("actual_canon", F.lit(0)), F.lit("none")).alias("abandoned"), F.get("expected_canon", F.lit(0)).alias("kept")))).otherwise(none)
    declared = F.when(F.col("preservation_case"), F.array_union("expected_canon", F.array(F.lit("declared")))).otherwise(F.col("expected_canon"))
    return r.select("utt_id", F.array_join(augmented_gate.correction_issues(pair, F.col("input_canon"), F.col("actual_canon")), ",").alias("corrections"), F.array_join(augmented_gate.entity_issues(declared, F.col("actual_canon")), ",").alias("entities"))
