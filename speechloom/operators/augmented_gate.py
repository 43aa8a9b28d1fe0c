"""The deterministic gate of augmented pairs: nine checks in order, each a Column that gives a reason code or null.

Rows hold id, input, output, original_clean, recipe (transformations of type, abandoned, retained, format_type) and canonical entities of the
three texts (input_canon, output_canon, clean_canon). ``CHECKS`` is the registry; a critical reason ends a row's report.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Reason codes that end a report, and types of recipes that are corrections: fixed values.
CRITICAL = ("MISSING_FIELDS", "EMPTY_INPUT", "EMPTY_OUTPUT")
CORRECTIONS = ("self_correction", "entity_correction", "phrase_correction")
NO_RECIPE = "cast(array() as array<struct<type:string,abandoned:string,retained:string,format_type:string>>)"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _steps() -> Column:
    return F.coalesce(F.col("recipe"), F.expr(NO_RECIPE))


def _corrections() -> Column:
    return F.filter(_steps(), lambda t: t["type"].isin(*CORRECTIONS))


def _first(reasons: Column) -> Column:
    return F.get(F.filter(reasons, lambda x: x.isNotNull()), F.lit(0))


def schema_valid() -> Column:
    return F.when((_text("input") == "") | (_text("output") == ""), "MISSING_FIELDS")


def non_empty() -> Column:
    return F.when(F.length(F.trim(_text("input"))) < 3, "EMPTY_INPUT").when(F.length(F.trim(_text("output"))) < 3, "EMPTY_OUTPUT")


def target_preservation() -> Column:
    clean = F.trim(_text("original_clean"))
    return F.when((clean != "") & (F.trim(_text("output")) != clean), "TARGET_MODIFIED")


def semantic_target() -> Column:
    return F.when(F.size(F.array_except("clean_canon", "output_canon")) > 0, "ENTITY_LOST")


def recipe_realized() -> Column:
    same = T.normalize_ascii(_text("input")) == T.normalize_ascii(_text("output"))
    return F.when(F.size(_steps()) == 0, F.when(~same, "UNEXPECTED_CHANGE")).otherwise(F.when(same, "TRANSFORMATION_NOT_REALIZED"))


def no_entity_introduction() -> Column:
    abandoned = F.transform(_corrections(), lambda t: T.normalize_ascii(F.coalesce(t["abandoned"], F.lit(""))))
    return F.when(F.size(F.array_except(F.array_except("input_canon", "output_canon"), abandoned)) > 0, "UNEXPECTED_ENTITIES")


def correction_metadata() -> Column:
    def one(t: Column) -> Column:
        a, r = F.coalesce(t["abandoned"], F.lit("")), F.coalesce(t["retained"], F.lit(""))
        return F.when((a == "") | (r == ""), "INCOMPLETE_CORRECTION").when(a == r, "IDENTICAL_CORRECTION").when(~F.contains(F.lower(_text("input")), F.lower(a)), "ABANDONED_MISSING")

    return _first(F.transform(_corrections(), one))


def length_bounds() -> Column:
    i, o = F.size(T.unicode_words(_text("input"))), F.size(T.unicode_words(_text("output")))
    return F.when((i > 5 * o) & (o > 5), "EXCESSIVE_LENGTH").when((o > 2 * i) & (i > 5), "OUTPUT_EXPANDED")


def formatting_valid() -> Column:
    lines = F.filter(F.split(_text("output"), "\n"), lambda x: F.trim(x) != "")

    def one(t: Column) -> Column:
        listed = F.when(F.size(lines) < 2, "INVALID_LIST").when(~F.forall(lines, lambda x: x.rlike("^(-|[0-9]+\\.)\\s")), "INVALID_LIST_FORMAT")
        headed = F.when((F.size(lines) != 1) | ~F.coalesce(F.get(lines, F.lit(0)).rlike("^#{1,3}\\s"), F.lit(False)), "INVALID_HEADING")
        return F.when(t["format_type"] == "bullet_list", listed).when(t["format_type"] == "heading", headed)

    return _first(F.transform(F.filter(_steps(), lambda t: t["type"] == "formatting_command"), one))


CHECKS: dict[str, Callable[[], Column]] = {
    f.__name__: f
    for f in (schema_valid, non_empty, target_preservation, semantic_target, recipe_realized, no_entity_introduction, correction_metadata, length_bounds, formatting_valid)
}


def report(rows: DataFrame, checks: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """rows with reasons (in order of the checks), passed and critical."""
    found = F.filter(F.array(*[f() for f in (checks or CHECKS).values()]), lambda x: x.isNotNull())
    stop = lambda r: F.when(F.get(r, F.lit(0)).isin(*CRITICAL), F.slice(r, 1, 1)).otherwise(r)
    return rows.withColumn("reasons", T.let(found, stop)).withColumn("passed", F.size("reasons") == 0).withColumn("critical", F.coalesce(F.get("reasons", F.lit(0)).isin(*CRITICAL), F.lit(False)))


def keep(reported: DataFrame, strict: bool = True) -> DataFrame:
    """The rows that pass; without strict, all but those with a critical reason."""
    return reported.where("passed" if strict else "not critical")


def correction_issues(corrections: Column, input_canon: Column, output_canon: Column) -> Column:
    """V4, an issue for each breach: both values equal, the abandoned one not in the input or still in the output, the kept one not in the output."""

    def one(c: Column) -> Column:
        a, k = T.normalize_ascii(c["abandoned"]), T.normalize_ascii(c["kept"])
        rules = ((a == k, "same:", a), (~F.array_contains(input_canon, a), "not-in-input:", a), (~F.array_contains(output_canon, k), "not-in-output:", k), (F.array_contains(output_canon, a), "leaked:", a))
        return F.array(*[F.when(test, F.concat(F.lit(name), v)) for test, name, v in rules])

    return F.filter(F.flatten(F.transform(corrections, one)), lambda x: x.isNotNull())


def entity_issues(declared: Column, output_canon: Column) -> Column:
    """V5: entities that are only declared, or only in the output."""
    only = lambda name, x, y: F.transform(F.array_sort(F.array_except(x, y)), lambda v: F.concat(F.lit(name), v))
    return F.concat(only("only-declared:", declared, output_canon), only("only-extracted:", output_canon, declared))
