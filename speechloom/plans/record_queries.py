"""Queries over records: gates, plans, noise, entities, corrections, the compile job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import DISTRACT_MARKERS, DISTRACTORS, FILLERS, HEDGES, LABELS, MARKERS_EASY, MARKERS_HARD, MARKERS_MEDIUM, RESTARTS, TRANSFORMS
from ..operators import entities as E
from ..operators import audit, gates, inject
from ..registry import query
from ..sources.views import CATEGORIES, COMBOS, SQL, predictions, table, turns, utterances

_W = "list_filter(string_split({t}, ' '), lambda x: x <> '')"
_D = "('0x' || substr(md5('42:' || utt_id || ':{s}'), 1, 15))::BIGINT"
_MD = "len(list_filter(string_split({t}, chr(10)), lambda x: regexp_matches(x, '^(\\s*(-|[0-9]+\\.)\\s|#{{1,3}}\\s)')))"


def _pick(site: str, values: tuple) -> str:
    items = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{items}][1 + {_D.format(s=site)} % {len(values)}]"


@query(f"WITH {SQL['turns']} SELECT conv_id, turn, len({_W.format(t='input')}) < 3 OR input <> trim(input) OR regexp_matches(input, '^[a-z]') AS bad_input, len({_W.format(t='output')}) < 3 OR output <> trim(output) OR regexp_matches(output, '^[a-z]') AS bad_output FROM turns")
def q_gate_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", gates.shape_issue(F.col("input")).alias("bad_input"), gates.shape_issue(F.col("output")).alias("bad_output"))


@query(f"WITH {SQL['preds']} SELECT utt_id, category, CASE WHEN category = 'long' THEN NOT (n BETWEEN 50 AND 300) WHEN output = actual THEN n > 30 ELSE n > 60 END AS bad FROM (SELECT *, len({_W.format(t='output')}) AS n FROM preds)")
def q_gate_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return p.select("utt_id", "category", gates.length_issue(F.size(T.words(F.col("output"))), F.col("category"), F.col("output") == F.col("actual")).alias("bad"))


_STRUCT = f"{SQL['preds']}, r AS (SELECT *, CASE WHEN {_D.format(s='n')} % 7 = 0 THEN 2 ELSE 1 END AS n, CASE WHEN {_D.format(s='c')} % 9 = 0 THEN 'filler+long' ELSE combo END AS kombo FROM preds)"


@query(
    f"WITH {_STRUCT} SELECT utt_id, array_to_string(list_filter([CASE WHEN category NOT IN {CATEGORIES!r} THEN 'category' END, CASE WHEN n <> 1 THEN 'count' END, CASE WHEN category NOT IN {TRANSFORMS!r} THEN 'transform' END,"
    f" CASE WHEN (category = 'mixed') <> (kombo IS NOT NULL) THEN 'combo' END, CASE WHEN kombo IS NOT NULL AND kombo NOT IN {COMBOS!r} THEN 'unknown_combo' END], lambda x: x IS NOT NULL), ',') AS issues FROM r"
)
def q_gate_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("utt_id")
    r = predictions(spark, sf_dir).withColumn("n", F.when(F.pmod(T.draw(k, "n"), F.lit(7)) == 0, 2).otherwise(1)).withColumn("kombo", F.when(F.pmod(T.draw(k, "c"), F.lit(9)) == 0, "filler+long").otherwise(F.col("combo")))
    issues = gates.structure_issues(F.col("category"), F.array("category"), F.col("n"), F.col("kombo"), CATEGORIES, TRANSFORMS, COMBOS)
    return r.select("utt_id", F.array_join(issues, ",").alias("issues"))


@query(
    f"WITH {SQL['utt']}, f AS (SELECT utt_id, w, {_pick('fmt', ('bullet_list', 'numbered_list', 'heading', 'none'))} AS made, {_pick('want', ('bullet_list', 'heading', 'none'))} AS want FROM (SELECT utt_id, {_W.format(t='text')}[1:4] AS w FROM utt)),"
    " t AS (SELECT *, CASE made WHEN 'bullet_list' THEN array_to_string(list_transform(w, lambda x: '- ' || x), chr(10)) WHEN 'numbered_list' THEN array_to_string(list_transform(w, lambda x, i: i || '. ' || x), chr(10)) ELSE '# ' || upper(w[1][1]) || w[1][2:] END AS t FROM f),"
    " p AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS ls FROM t)"
    f" SELECT utt_id, made, want, CASE want WHEN 'bullet_list' THEN NOT (len(ls) >= 2 AND len(list_filter(ls, lambda x: NOT regexp_matches(x, '^(-|[0-9]+\\.)\\s'))) = 0) WHEN 'heading' THEN NOT (regexp_matches(t, '^#{{1,3}}\\s') AND NOT contains(t, chr(10))) ELSE {_MD.format(t='t')} > 0 END AS bad FROM p"
)
def q_gate_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("utt_id")
    u = utterances(spark, sf_dir).select("utt_id", F.slice(T.words(F.col("text")), 1, 4).alias("w"), T.pick(k, "fmt", ("bullet_list", "numbered_list", "heading", "none")).alias("made"), T.pick(k, "want", ("bullet_list", "heading", "none")).alias("want"))
    u = u.withColumn("t", inject.formatted(F.col("w"), F.col("made")))
    return u.select("utt_id", "made", "want", gates.formatting_issue(F.col("t"), F.col("want")).alias("bad"))


@query(f"WITH {SQL['preds']}, p AS (SELECT utt_id, category = 'clean' AS flag, {_W.format(t='output')}[1:2] AS kept, actual FROM preds) SELECT utt_id, flag AND (len(kept) = 0 OR len(list_filter(kept, lambda x: NOT contains(actual, x))) > 0) AS bad FROM p")
def q_gate_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return p.select("utt_id", gates.preservation_issue(F.col("category") == "clean", F.slice(T.words(F.col("output")), 1, 2), F.col("actual")).alias("bad"))


_BOUNDS = f"len({_W.format(t='input')}) AS ni, len({_W.format(t='output')}) AS no"
_REASON = "CASE WHEN ni > 5 * no AND no > 5 THEN 'EXCESSIVE_LENGTH' WHEN no > 2 * ni AND ni > 5 THEN 'OUTPUT_EXPANDED' END"


@query(f"WITH {SQL['turns']} SELECT conv_id, turn, {_REASON} AS reason FROM (SELECT *, {_BOUNDS} FROM turns)")
def q_length_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", gates.length_bounds(F.size(T.words(F.col("input"))), F.size(T.words(F.col("output")))).alias("reason"))


@query(
    f"WITH {SQL['turns']}, b AS (SELECT *, {_BOUNDS} FROM turns), r AS (SELECT *, CASE WHEN length(trim(input)) < 3 THEN ['EMPTY_INPUT'] WHEN length(trim(output)) < 3 THEN ['EMPTY_OUTPUT'] ELSE list_filter([{_REASON},"
    f" CASE WHEN input = output THEN 'TRANSFORMATION_NOT_REALIZED' END, CASE WHEN {_MD.format(t='output')} = 1 THEN 'INVALID_LIST' END], lambda x: x IS NOT NULL) END AS reasons FROM b)"
    " SELECT conv_id, turn, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS passed FROM r"
)
def q_gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.report(turns(spark, sf_dir)).select("conv_id", "turn", F.array_join("reasons", ",").alias("reasons"), "passed")


_FILL = (
    f"f AS (SELECT utt_id, {_pick('level', ('easy', 'medium', 'hard', 'extreme'))} AS level, {_W.format(t='text')} AS w FROM utt), o AS (SELECT *, list_transform(list_sort([{{'h': md5('42:' || utt_id || ':gap:' || i), 'i': i}} for i in range(1, len(w))]), lambda x: x.i)"
    "[1:CASE level WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END] AS gaps FROM f),"
    f" noisy AS (SELECT utt_id, array_to_string([CASE WHEN list_contains(gaps, i) THEN w[i] || ', ' || {list(FILLERS)!r}[1 + ('0x' || substr(md5('42:' || utt_id || ':filler:' || i), 1, 8))::BIGINT % {len(FILLERS)}] || ',' ELSE w[i] END for i in range(1, len(w) + 1)], ' ') AS noisy FROM o)"
)


@query(f"WITH {SQL['utt']}, {_FILL} SELECT utt_id, noisy FROM noisy")
def q_inject_filler(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("utt_id")
    return utterances(spark, sf_dir).select("utt_id", inject.filler(F.col("text"), k, T.pick(k, "level", ("easy", "medium", "hard", "extreme"))).alias("noisy"))


_BANK = "|".join(sorted(map(str.lower, FILLERS), key=len, reverse=True))


@query(f"WITH {SQL['utt']}, {_FILL} SELECT utt_id, len(regexp_extract_all(regexp_replace(lower(noisy), '[ß-öø-ÿĀ-ɏ]', 'x', 'g'), '\\b(?:{_BANK})\\b'))::BIGINT AS n FROM noisy")
def q_filler_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fillers in noisy text; an accented letter is part of a word (in SQL it becomes an x for that)."""
    return q_inject_filler(spark, sf_dir).select("utt_id", T.filler_count(F.col("noisy")).cast("long").alias("n"))


@query(
    f"WITH {SQL['utt']}, r AS (SELECT utt_id, {_W.format(t='text')} AS w, CASE WHEN {_D.format(s='rep.kind')} / pow(2, 60) < 0.6 THEN 1 ELSE 2 END AS k FROM utt), a AS (SELECT *, {_D.format(s='rep.at')} % greatest(1, len(w) - k + 1) AS p FROM r)"
    " SELECT utt_id, array_to_string(list_concat(list_concat(w[1:p + k], w[p + 1:p + k]), w[p + k + 1:len(w)]), ' ') AS noisy FROM a"
)
def q_inject_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utterances(spark, sf_dir).select("utt_id", inject.repetition(F.col("text"), F.col("utt_id")).alias("noisy"))


_LEVEL = _pick("level", ("easy", "medium", "hard", "extreme"))
_MARKER = f"CASE {_LEVEL} WHEN 'easy' THEN {_pick('corr.marker', MARKERS_EASY)} WHEN 'medium' THEN {_pick('corr.marker', MARKERS_MEDIUM)} ELSE {_pick('corr.marker', MARKERS_HARD)} END"


@query(
    f"WITH {SQL['utt']}, c AS (SELECT utt_id, split_part(text, ' ', 1) AS kept, substr(text, length(split_part(text, ' ', 1)) + 1) AS rest, {_MARKER} AS drawn FROM utt), m AS (SELECT *, CASE WHEN drawn IN ('not', 'I meant') THEN 'no wait' ELSE drawn END AS marker FROM c)"
    " SELECT utt_id, CASE WHEN marker = 'no wait' THEN 'Thing no wait ' || kept WHEN marker IN ('make that', 'change that to', 'rather', 'I meant') THEN 'Thing, ' || marker || ' ' || kept ELSE 'Thing, ' || marker || ', ' || kept END || rest AS noisy FROM m"
)
def q_inject_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of every utterance said wrong first."""
    k, first = F.col("utt_id"), F.length(F.substring_index("text", " ", 1))
    noisy = inject.correction(F.col("text"), F.lit(0), first, F.lit("Thing"), k, T.pick(k, "level", ("easy", "medium", "hard", "extreme")))
    return utterances(spark, sf_dir).select("utt_id", noisy.alias("noisy"))


@query(
    f"WITH {SQL['utt']}, r AS (SELECT utt_id, lower(text[1]) || text[2:] AS low, {_W.format(t='text')} AS w, {_pick('ref.hedge', HEDGES)} AS hedge FROM utt), n AS (SELECT *, {_D.format(s='ref.n')} % greatest(1, least(4, len(w) - 2)) + 1 AS n FROM r)"
    f" SELECT utt_id, CASE WHEN {_D.format(s='ref.mode')} / pow(2, 60) < 0.6 THEN array_to_string(w[1:n], ' ') || ', ' || {_pick('ref.marker', RESTARTS)} || ', ' || low"
    f" ELSE upper(hedge[1]) || hedge[2:] || ' ' || {_pick('ref.distractor', DISTRACTORS)} || ', ' || {_pick('ref.turn', DISTRACT_MARKERS)} || ', ' || low END AS noisy FROM n"
)
def q_inject_reformulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utterances(spark, sf_dir).select("utt_id", inject.reformulation(F.col("text"), F.col("utt_id")).alias("noisy"))


#: Sentences with entities of every kind, overlaps included (fixed values).
SENTENCES = (
    "Ada left the beach towel at the beach on Friday at 5 pm.",
    "Bruno Silva paid $12.50 for coffee at the station tomorrow.",
    "Deploy Kafka and Postgres on March 3rd at 10:30.",
    "Meet Hana at the library at noon, room 204.",
    "Twenty percent is not 20 percent or 3.14.",
    "",
)


def _fixture(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SENTENCES)), "id long, text string").withColumn("spans", E.resolve(E.candidates("text")))


@query()
def q_entity_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the fixture and of every utterance."""
    u = utterances(spark, sf_dir).select(F.col("utt_id").alias("id"), "text").withColumn("spans", E.resolve(E.candidates("text")))
    both = _fixture(spark).select(F.col("id").cast("string").alias("id"), "spans").union(u.select("id", "spans"))
    return both.select("id", F.explode("spans").alias("s")).select("id", "s.*")


@query()
def q_entity_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical values by kind of the fixture and of every utterance."""
    u = utterances(spark, sf_dir).select(F.col("utt_id").alias("id"), "text").withColumn("spans", E.resolve(E.candidates("text")))
    both = _fixture(spark).select(F.col("id").cast("string").alias("id"), "spans").union(u.select("id", "spans"))
    return both.select("id", F.to_json(E.inventory(F.col("spans"))).alias("inventory"))


_HAS = "contains(lower({t}), lower({v}))"
_KEPT = f"CASE WHEN kept = '' THEN '' WHEN kept = later THEN CASE WHEN {_HAS.format(t='actual', v='kept')} THEN 'superseded-survived' ELSE '' END WHEN NOT {_HAS.format(t='actual', v='kept')} THEN 'kept-missing' ELSE '' END"
_GONE = f"CASE WHEN {_HAS.format(t='actual', v='gone')} AND NOT {_HAS.format(t='output', v='gone')} THEN 'abandoned-survived' ELSE '' END"


@query(
    f"WITH {SQL['preds']}, w AS (SELECT utt_id, actual, output, {_W.format(t='output')} AS w, {_D.format(s='chain')} % 3 AS chain FROM preds),"
    " c AS (SELECT utt_id, actual, output, 0 AS i, 'Here' AS gone, w[1] AS kept, CASE WHEN chain > 0 THEN w[1] END AS later FROM w UNION ALL SELECT utt_id, actual, output, 1, w[1], CASE chain WHEN 1 THEN w[len(w)] ELSE '' END, NULL FROM w WHERE chain > 0),"
    f" f AS (SELECT utt_id, i, {_KEPT} AS a, {_GONE} AS b FROM c)"
    " SELECT utt_id, coalesce(string_agg(v, ',' ORDER BY i, j) FILTER (v <> ''), '') AS failures FROM (SELECT utt_id, i, 0 AS j, a AS v FROM f UNION ALL SELECT utt_id, i, 1, b FROM f) GROUP BY utt_id"
)
def q_corrections_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every prediction: one correction to the first word, in two of three rows taken back for the last word or for nothing."""
    p = predictions(spark, sf_dir).withColumn("w", T.words(F.col("output"))).withColumn("chain", F.pmod(T.draw(F.col("utt_id"), "chain"), F.lit(3)))
    step = lambda gone, kept: F.struct(gone.alias("abandoned"), kept.alias("kept"))
    first = F.get("w", F.lit(0))
    more = F.when(F.col("chain") > 0, F.array(step(first, F.when(F.col("chain") == 1, F.element_at("w", -1)).otherwise("")))).otherwise(F.expr("cast(array() as array<struct<abandoned:string,kept:string>>)"))
    c = p.select("utt_id", "actual", "output", F.concat(F.array(step(F.lit("Here"), first)), more).alias("c"))
    return c.select("utt_id", F.array_join(E.correction_failures(F.col("c"), F.col("actual"), F.col("output")), ",").alias("failures"))


_LONG = "list_distinct(regexp_extract_all(lower({t}), '[a-z]{{6,}}'))"


@query(
    f"WITH {SQL['preds']}, v AS (SELECT utt_id, {_LONG.format(t='output')} AS e, list_distinct(list_transform({_LONG.format(t='actual')}, lambda x: CASE {_D.format(s='typo')} % 3 WHEN 0 THEN x ELSE 'q' || x[2:length(x) - ({_D.format(s='typo')} % 3 - 1)] END)) AS a FROM preds),"
    " m AS (SELECT utt_id, missing, unnest(a) AS found FROM (SELECT utt_id, unnest(list_filter(e, lambda x: NOT list_contains(a, x))) AS missing, a FROM v)),"
    " b AS (SELECT utt_id, min({'distance': levenshtein(missing, found)::INT, 'missing': missing, 'found': found}) AS n FROM m WHERE levenshtein(missing, found) <= 2 GROUP BY utt_id)"
    " SELECT utt_id, n.missing AS missing, n.found AS found, n.distance AS distance FROM v LEFT JOIN b USING (utt_id)"
)
def q_nearest_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words of the expected text as entities; in two of three answers each is spelt wrong, once or twice."""
    wrong = F.pmod(T.draw(F.col("utt_id"), "typo"), F.lit(3)).cast("int")
    long = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{6,}"), 0))
    p = predictions(spark, sf_dir).select("utt_id", long("output").alias("e"), long("actual").alias("a"), wrong.alias("wrong"))
    spelt = F.transform("a", lambda x: F.when(F.col("wrong") == 0, x).otherwise(F.concat(F.lit("q"), F.substring(x, F.lit(2), F.length(x) - F.col("wrong")))))
    return p.select("utt_id", E.nearest(F.col("e"), F.array_distinct(spelt)).alias("n")).select("utt_id", "n.missing", "n.found", "n.distance")


@query(
    f"WITH {SQL['utt']}, r AS (SELECT utt_id, array_to_string(list_sort(list_distinct([{_pick('t1', ('filler', 'repetition', 'self_correction'))}, {_pick('t2', ('filler', 'repetition', 'self_correction'))}])), '+') AS types FROM utt)"
    f" SELECT utt_id, types, coalesce(label, 'unknown:' || types) AS label FROM r LEFT JOIN (VALUES {', '.join(map(repr, LABELS))}) l(types, label) USING (types)"
)
def q_recipe_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kinds = F.col("utt_id"), ("filler", "repetition", "self_correction")
    r = utterances(spark, sf_dir).select("utt_id", F.array_join(F.array_sort(F.array_distinct(F.array(T.pick(k, "t1", kinds), T.pick(k, "t2", kinds)))), "+").alias("types"))
    labels = F.broadcast(spark.createDataFrame(LABELS, "types string, label string"))  # a row for each label
    return r.join(labels, "types", "left").select("utt_id", "types", F.coalesce("label", F.concat(F.lit("unknown:"), F.col("types"))).alias("label"))


@query(f"WITH {SQL['preds']} SELECT category, count(*) AS n, round(avg(len(list_filter(list_distinct({_W.format(t='output')}), lambda x: list_contains({_W.format(t='actual')}, x)))::DOUBLE / len(list_distinct({_W.format(t='output')}))), 6) AS eps FROM preds GROUP BY category")
def q_eps_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of declared values (here: the distinct words) that the answer holds."""
    p = predictions(spark, sf_dir)
    e = F.array_distinct(T.words(F.col("output")))
    return p.select("category", (F.size(F.array_intersect(e, T.words(F.col("actual")))) / F.size(e)).alias("x")).groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("eps"))


_PLAIN = f"regexp_replace({{t}}, '{audit.ACCENTED}', '_', 'g')"
_FOUND = "list_distinct(list_transform(flatten([" + ", ".join(f"regexp_extract_all({_PLAIN.format(t='input')}, '{p}')" for p in audit.AUDITED) + "]), lambda v: trim(lower(v))))"
_LOST = "len(list_filter(vals, lambda v: len(list_filter(regexp_extract_all(v, '[a-z0-9'']+'), lambda w: NOT list_contains(heard, w))) > 0))"


@query(
    f"WITH {SQL['preds']}, f AS (SELECT category, {_FOUND} AS vals, regexp_extract_all(lower({_PLAIN.format(t='actual')}), '[a-z0-9'']+') AS heard FROM preds), l AS (SELECT category, len(vals) AS n, {_LOST} AS lost FROM f)"
    " SELECT category, count(*) AS n, sum(CASE WHEN lost > 0 THEN 1 ELSE 0 END)::BIGINT AS losing, round(avg(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE (n - lost)::DOUBLE / n END), 6) AS eps FROM l GROUP BY category"
)
def q_eps_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the values seen in the input that the answer keeps, over all rows."""
    x = predictions(spark, sf_dir).select("category", audit.eps_inferred(F.col("input"), F.col("actual")).alias("e"))
    share = F.when(F.col("e.n") == 0, 1.0).otherwise((F.col("e.n") - F.col("e.lost")) / F.greatest(F.col("e.n"), F.lit(1)))
    return x.groupBy("category").agg(F.count("*").alias("n"), F.sum(F.when(F.col("e.lost") > 0, 1).otherwise(0)).alias("losing"), F.round(F.avg(share), 6).alias("eps"))


@query(f"WITH {SQL['utt']}, v AS (SELECT DISTINCT w FROM (SELECT unnest({_W.format(t='text')}) AS w FROM utt WHERE source = 'src1')), o AS (SELECT w, count(*) AS n FROM (SELECT unnest(list_distinct({_W.format(t='text')})) AS w FROM utt WHERE source <> 'src1') GROUP BY w) SELECT count(*) AS vocabulary, count(o.w) AS covered, sum(CASE WHEN coalesce(n, 0) < 5 THEN 1 ELSE 0 END)::BIGINT AS below_floor FROM v LEFT JOIN o USING (w)")
def q_vocab_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = utterances(spark, sf_dir).select("source", F.explode(F.array_distinct(T.words(F.col("text")))).alias("w"))
    v = u.where("source = 'src1'").select("w").distinct()
    o = u.where("source <> 'src1'").groupBy("w").agg(F.count("*").alias("n"))
    j = v.join(o, "w", "left")
    return j.agg(F.count("*").alias("vocabulary"), F.count("n").alias("covered"), F.sum(F.when(F.coalesce("n", F.lit(0)) < 5, 1).otherwise(0)).alias("below_floor"))
