"""Metrics of a record (a training record and what a model answered) and the bucket of its failure, as Columns.

Entities come in as arrays of canonical values, so that any extraction can feed them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import FILLERS
from . import metrics

#: Buckets in order of priority: fixed values.
BUCKETS = ("correction_resolution", "repetition_removal", "hallucination", "entity_corruption", "information_deletion", "formatting_failure", "long_context_failure", "verbosity", "partial_rewrite", "punctuation_only")
#: What records to add where a bucket fills.
ADVICE = (
    "corrections of several words and of several entities, with other markers", "repeated phrases and clauses", "records that must stay as they are", "pairs of entities that differ by little",
    "records to preserve, and longer answers", "other wordings of the formatting commands", "long forms", "answers that hold the text alone", "records without a change", "records that change signs only",
)
METRICS = (
    "exact_match", "normalized_match", "wer", "cer", "token_ratio", "entity_preservation", "correction_resolution",
    "hallucination_flag", "verbosity_flag", "artifact_flag", "formatting_ok", "preservation_ok", "compositional_pass",
)


def has(items: Column, value: str) -> Column:
    return F.coalesce(F.array_contains(items, value), F.lit(False))


def value_present(value: Column, text: Column, canon: Column) -> Column:
    """Whether a correction's value is in a normalised text: among its entities, or as a part of it; digits and short values only as entities."""
    return F.array_contains(canon, value) | ((F.length(value) >= 3) & ~value.rlike("^[0-9]+$") & F.contains(text, value))


def correction_failures(corrections: Column, actual: Column, actual_canon: Column, expected: Column, expected_canon: Column) -> Column:
    """kind:value of every failed correction, from (abandoned, kept) and normalised texts.

    A kept value that the next correction abandons must be gone, others must be there; an abandoned value must be gone unless the expected text holds
    it. Corrections that keep nothing are deletions and are not judged.
    """
    low = F.transform(F.coalesce(corrections, F.expr("cast(array() as array<struct<abandoned:string,kept:string>>)")), lambda c: F.struct(T.normalize_ascii(c["abandoned"]).alias("a"), T.normalize_ascii(F.coalesce(c["kept"], F.lit(""))).alias("k")))

    def judged(low: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            chained = F.coalesce(F.get(low, i + 1)["a"] == c["k"], F.lit(False))
            there = value_present(c["k"], actual, actual_canon)
            kept = F.when(chained & there, F.concat(F.lit("superseded-survived:"), c["k"])).when(~chained & ~there, F.concat(F.lit("kept-missing:"), c["k"]))
            legal = F.array_contains(expected_canon, c["a"]) | F.contains(expected, c["a"])
            gone = F.when(~legal & value_present(c["a"], actual, actual_canon), F.concat(F.lit("abandoned-retained:"), c["a"]))
            return F.when(c["k"] == "", F.expr("cast(array() as array<string>)")).otherwise(F.array(kept, gone))

        return F.filter(F.flatten(F.transform(low, one)), lambda x: x.isNotNull())

    return T.let(low, judged)


def formatting_ok(kind: Column, actual: Column) -> Column:
    """Whether a list, a heading or plain text is what it should be; true without formatting."""
    lines = F.filter(F.split(actual, "\n"), lambda x: F.trim(x) != "")
    item = lambda x: x.rlike("^(-|[0-9]+\\.)\\s")
    ok = F.when(kind == "bullet_list", (F.size(lines) >= 2) & F.forall(lines, item))
    ok = ok.when(kind == "heading", (F.size(lines) == 1) & F.get(lines, F.lit(0)).rlike("^#{1,3}\\s")).when(kind == "polite_message", F.size(T.markdown_lines(actual)) == 0)
    return F.coalesce(ok, F.lit(True))


def reformulation_ok(reformulations: Column, actual: Column) -> Column:
    """The abandoned part of a restart is left once at most, that of another reformulation is gone."""

    def one(r: Column) -> Column:
        said = T.normalize_ascii(F.coalesce(r["abandoned"], F.lit("")))
        times = (F.length(actual) - F.length(F.replace(actual, said, F.lit("")))) / F.length(said)
        return F.when(said == "", True).when(r["mode"] == "restart", times <= 1).otherwise(~F.contains(actual, said))

    return F.coalesce(F.forall(reformulations, one), F.lit(True))


def fillers_in(text: Column) -> Column:
    bank = "|".join(sorted(FILLERS, key=len, reverse=True))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(\\b(?:{bank})\\b)"), F.lit(1)))


def is_long(category: Column, combo: Column) -> Column:
    return (category == "long") | F.coalesce(combo.endswith("long"), F.lit(False))


def scored(records: DataFrame) -> DataFrame:
    """records (output, actual, category, combo, transformations, corrections, reformulations, formatting, preserved, expected_canon, actual_canon) with METRICS."""
    c = F.col
    d = records.withColumn("__e", T.words(c("output"))).withColumn("__a", T.words(c("actual"))).withColumn("ne", T.normalize_ascii(c("output"))).withColumn("na", T.normalize_ascii(c("actual")))
    kept = F.array_intersect("expected_canon", "actual_canon")
    abandoned = F.transform(F.coalesce("corrections", F.expr("cast(array() as array<struct<abandoned:string,kept:string>>)")), lambda x: T.normalize_ascii(x["abandoned"]))
    d = d.select(
        *records.columns, "ne", "na",
        (c("output") == c("actual")).alias("exact_match"),
        (c("ne") == c("na")).alias("normalized_match"),
        T.error_rate(T.word_errors(c("__e"), c("__a")), F.size("__e"), F.size("__a") == 0).alias("wer"),
        T.error_rate(T.edit_distance(c("output"), c("actual")), F.length("output"), F.length("actual") == 0).alias("cer"),
        (F.size("__a") / F.greatest(F.lit(1), F.size("__e"))).alias("token_ratio"),
        F.when(F.size("expected_canon") == 0, 1.0).otherwise(F.size(kept) / F.size("expected_canon")).alias("entity_preservation"),
        correction_failures(c("corrections"), c("na"), c("actual_canon"), c("ne"), c("expected_canon")).alias("correction_failures"),
        F.array_sort(F.array_except(F.array_except("actual_canon", "expected_canon"), abandoned)).alias("hallucinated"),
        T.has_artifact(c("na")).alias("artifact_flag"),
        formatting_ok(c("formatting")["type"], c("actual")).alias("formatting_ok"),
        F.coalesce(F.forall("preserved", lambda p: F.contains(c("na"), T.normalize_ascii(p))), F.lit(True)).alias("preservation_ok"),
        F.array_except(T.duplications(T.words(F.lower("actual"))), T.duplications(T.words(F.lower("output")))).alias("new_dups"),
        T.token_recall(T.content_tokens(c("ne")), T.content_tokens(c("na"))).alias("token_recall"),
        F.size(F.array_except(fillers_in(c("na")), fillers_in(c("ne")))).alias("new_fillers"),
    )
    d = d.withColumn("correction_resolution", F.size("correction_failures") == 0).withColumn("hallucination_flag", F.size("hallucinated") > 0).withColumn("verbosity_flag", metrics.verbose(c("token_ratio")))
    t = c("transformations")
    done = ~(has(t, "filler") & (c("new_fillers") > 0)) & ~(has(t, "repetition") & (F.size("new_dups") > 0)) & ~(has(t, "self_correction") & ~c("correction_resolution"))
    done = done & ~(has(t, "reformulation") & ~reformulation_ok(c("reformulations"), c("na"))) & ~(has(t, "formatting") & ~c("formatting_ok"))
    done = done & ~(is_long(c("category"), c("combo")) & ~((c("entity_preservation") == 1.0) & (c("token_ratio") >= 0.5)))
    return d.withColumn("compositional_pass", F.when(F.coalesce(F.size(t), F.lit(0)) <= 0, c("normalized_match")).otherwise(done))


def bucket(s: DataFrame) -> DataFrame:
    """scored rows with the first failure that applies, null for an acceptable answer."""
    c, t = F.col, F.col("transformations")
    missing = F.array_except("expected_canon", "actual_canon")
    near = (F.size(missing) > 0) & F.forall(missing, lambda e: F.exists("actual_canon", lambda a: F.levenshtein(e, a) <= 2))
    alnum = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    kind = (
        F.when(~c("correction_resolution"), "correction_resolution")
        .when((has(t, "repetition") & (F.size("new_dups") > 0)) | (F.coalesce("preservation_case", F.lit(False)) & ~c("preservation_ok")), "repetition_removal")
        .when(c("hallucination_flag"), "hallucination")
        .when(c("formatting").isNotNull() & ~c("formatting_ok"), "formatting_failure")
        .when(near, "entity_corruption")
        .when((c("token_recall") < 0.8) & ~has(t, "self_correction") & ~has(t, "repetition"), "information_deletion")
        .when(is_long(c("category"), c("combo")) & ((c("token_ratio") < 0.5) | (c("entity_preservation") < 1.0)), "long_context_failure")
        .when(c("artifact_flag") | (c("token_ratio") > 1.5), "verbosity")
        .when(~c("normalized_match") & (alnum("output") == alnum("actual")), "punctuation_only")
        .when(~c("normalized_match") & (c("token_recall") >= 0.9), "partial_rewrite")
    )
    return s.withColumn("bucket", kind)


def failure_report(bucketed: DataFrame) -> DataFrame:
    """A row for each of the ten buckets in order, also without failures: n, its share of all records, all failures and their share, advice where n > 0.

    An empty table gives zeros. Only counts by bucket leave the tasks, eleven at most.
    """
    counts = bucketed.groupBy("bucket").agg(F.count("*").alias("n"))
    named = F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", "n")))  # the buckets met, ten at most
    # rows are bucketed once: a join of the counts with the ten names would filter by the bucket and so compute all metrics again
    all_rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.sum(F.when(F.col("bucket").isNotNull(), F.col("n"))), F.lit(0)).alias("failures"), F.map_from_entries(named).alias("by"))
    entry = lambda i, b: F.struct(F.lit(i).alias("place"), F.lit(b).alias("name"), F.lit(ADVICE[i]).alias("text"))
    ten = all_rows.select("records", "failures", "by", F.explode(F.array(*[entry(i, b) for i, b in enumerate(BUCKETS)])).alias("b"))
    n, share = F.coalesce(F.try_element_at("by", F.col("b.name")), F.lit(0)), lambda x: F.when(F.col("records") == 0, 0.0).otherwise(x / F.greatest("records", F.lit(1)))
    return ten.select("b.place", F.col("b.name").alias("bucket"), n.alias("n"), share(n).alias("share"), "records", "failures", share(F.col("failures")).alias("failure_rate"), F.when(n > 0, F.col("b.text")).alias("advice"))
