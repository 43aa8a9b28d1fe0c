"""Noise: fillers, repetitions, corrections and reformulations put into clean text by hash draws keyed by record and decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import DISTRACT_MARKERS, DISTRACTORS, FILLERS, HEDGES, MARKERS_EASY, MARKERS_HARD, MARKERS_MEDIUM, RESTARTS

def _n(level: Column, easy: int, medium: int, hard: int) -> Column:
    return F.when(level == "easy", easy).when(level == "medium", medium).otherwise(hard)


def filler(text: Column, key: Column, level: Column) -> Column:
    """1, 2 or 3 fillers after the words whose hash ranks first; never after the last word."""
    return T.let(T.words(text), lambda w: _filler(w, key, level))


def _filler(w: Column, key: Column, level: Column) -> Column:
    order = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.struct(F.md5(F.concat_ws(":", F.lit("42"), key, F.lit("gap"), i.cast("string"))).alias("h"), i.alias("i")))
    chosen = F.transform(F.slice(F.sort_array(order), 1, _n(level, 1, 2, 3)), lambda x: x["i"])
    word = lambda i: F.element_at(F.array(*[F.lit(f) for f in FILLERS]), (F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("42"), key, F.lit("filler"), i.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(len(FILLERS))) + 1).cast("int"))
    return T.let(chosen, lambda gaps: F.array_join(F.transform(w, lambda x, i: F.when(F.array_contains(gaps, i + 1), F.concat(x, F.lit(", "), word(i + 1), F.lit(","))).otherwise(x)), " "))


def repetition(text: Column, key: Column) -> Column:
    """One word said twice, 60 in 100; else a pair of words."""
    w = T.words(text)
    k = F.when(T.uniform(key, "rep.kind") < 0.6, 1).otherwise(2)
    at = F.pmod(T.draw(key, "rep.at"), F.greatest(F.lit(1), F.size(w) - k + 1)).cast("int")
    return F.array_join(F.concat(F.slice(w, 1, at + k), F.slice(w, at + 1, k), F.slice(w, at + k + 1, F.size(w))), " ")


def rendered(wrong: Column, right: Column, marker: Column) -> Column:
    """A correction as it is said with its marker."""
    said = F.when(marker == "no wait", F.concat(wrong, F.lit(" no wait "), right)).when(marker == "not", F.concat(F.lit("not "), wrong, F.lit(", "), right))
    said = said.when(marker.isin("make that", "change that to", "rather", "I meant"), F.concat(wrong, F.lit(", "), marker, F.lit(" "), right))
    return said.otherwise(F.concat(wrong, F.lit(", "), marker, F.lit(", "), right))


def correction(text: Column, start: Column, end: Column, abandoned: Column, key: Column, level: Column) -> Column:
    """The span said wrong first, then right; ``not`` and ``I meant`` do not open a text."""
    pick = F.when(level == "easy", T.pick(key, "corr.marker", MARKERS_EASY)).when(level == "medium", T.pick(key, "corr.marker", MARKERS_MEDIUM)).otherwise(T.pick(key, "corr.marker", MARKERS_HARD))
    marker = F.when((start == 0) & pick.isin("not", "I meant"), "no wait").otherwise(pick)
    kept = F.substr(text, start + 1, end - start)
    return F.concat(F.substr(text, F.lit(1), start), rendered(abandoned, kept, marker), F.substr(text, end + 1))


def reformulation(text: Column, key: Column) -> Column:
    """60 in 100 a restart after one to four words, else a hedge, a distractor and a marker before the text."""
    w = T.words(text)
    n = (F.pmod(T.draw(key, "ref.n"), F.greatest(F.lit(1), F.least(F.lit(4), F.size(w) - 2))) + 1).cast("int")
    restart = F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit(", "), T.pick(key, "ref.marker", RESTARTS), F.lit(", "), T.lower_first(text))
    hedge = F.concat(T.upper_first(T.pick(key, "ref.hedge", HEDGES)), F.lit(" "), T.pick(key, "ref.distractor", DISTRACTORS), F.lit(", "), T.pick(key, "ref.turn", DISTRACT_MARKERS), F.lit(", "), T.lower_first(text))
    return F.when(T.uniform(key, "ref.mode") < 0.6, restart).otherwise(hedge)


def formatted(items: Column, kind: Column) -> Column:
    """A bullet list, a numbered list or a heading of items."""
    bullets = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    numbers = F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return F.when(kind == "bullet_list", bullets).when(kind == "numbered_list", numbers).otherwise(F.concat(F.lit("# "), T.upper_first(F.element_at(items, 1))))
