"""Gates: checks on records as Columns, each named; a record is kept if none fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def shape_issue(t: Column) -> Column:
    """V3: fewer than three words, outer white space, lower-case first letter."""
    return (F.size(T.words(t)) < 3) | (t != F.trim(t)) | t.rlike("^[a-z]")


def length_issue(n: Column, category: Column, identity: Column) -> Column:
    """V7: long texts 50-300 words, identities at most 30, others at most 60."""
    return F.when(category == "long", ~n.between(50, 300)).when(identity, n > 30).otherwise(n > 60)


def formatting_issue(t: Column, kind: Column) -> Column:
    """V6: a bullet list has two or more item lines, a heading is one line with 1-3 marks, others hold no markdown."""
    parts = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    bullets = (F.size(parts) >= 2) & F.forall(parts, lambda x: x.rlike("^(-|[0-9]+\\.)\\s"))
    return F.when(kind == "bullet_list", ~bullets).when(kind == "heading", ~(t.rlike("^#{1,3}\\s") & ~t.contains("\n"))).otherwise(F.size(T.markdown_lines(t)) > 0)


def preservation_issue(flag: Column, preserved: Column, output: Column) -> Column:
    """V10: flagged records name what they preserve, and all of it is in the output."""
    return flag & ((F.size(preserved) == 0) | ~F.forall(preserved, lambda p: F.contains(output, p)))


def structure_issues(category: Column, transforms: Column, n: Column, combo: Column, categories: tuple, allowed: tuple, combos: tuple) -> Column:
    """V1: unknown category, count that differs, unknown transforms, combo if and only if mixed."""
    return F.filter(
        F.array(
            F.when(~category.isin(*categories), F.lit("category")),
            F.when(F.size(transforms) != n, F.lit("count")),
            F.when(F.size(F.array_except(transforms, F.array(*[F.lit(a) for a in allowed]))) > 0, F.lit("transform")),
            F.when((category == "mixed") != combo.isNotNull(), F.lit("combo")),
            F.when(combo.isNotNull() & ~combo.isin(*combos), F.lit("unknown_combo")),
        ),
        lambda x: x.isNotNull(),
    )


def length_bounds(n_in: Column, n_out: Column) -> Column:
    """The reason of the length rule: input over 5 times the output, or output over twice the input; null if neither."""
    return F.when((n_in > 5 * n_out) & (n_out > 5), "EXCESSIVE_LENGTH").when((n_out > 2 * n_in) & (n_in > 5), "OUTPUT_EXPANDED")


def report(df: DataFrame, input_col: str = "input", output_col: str = "output") -> DataFrame:
    """Ordered checks of pairs; the ones after an empty side are not evaluated. reasons and passed."""
    i, o = F.col(input_col), F.col(output_col)
    empty = F.when(F.length(F.trim(i)) < 3, "EMPTY_INPUT").when(F.length(F.trim(o)) < 3, "EMPTY_OUTPUT")
    later = F.filter(
        F.array(
            length_bounds(F.size(T.words(i)), F.size(T.words(o))),
            F.when(i == o, F.lit("TRANSFORMATION_NOT_REALIZED")),
            F.when((F.size(T.markdown_lines(o)) == 1), F.lit("INVALID_LIST")),
        ),
        lambda x: x.isNotNull(),
    )
    reasons = F.when(empty.isNotNull(), F.array(empty)).otherwise(later)
    return df.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0).withColumn("critical", empty.isNotNull())


def keep(reported: DataFrame, strict: bool = True) -> DataFrame:
    return reported.where("passed" if strict else "not critical")
