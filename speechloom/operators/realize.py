"""Clean text said with disfluencies: corrections of extracted entities, a reformulation, repetitions, fillers, in this order, with what was done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import DISTRACT_MARKERS, DISTRACTORS, HEDGES, MARKERS_EASY, MARKERS_HARD, MARKERS_MEDIUM, RESTARTS
from . import disfluency as D
from . import entities as E
from . import inject
from .values import other_value

CORRECTIONS = "array<struct<abandoned:string,kept:string,kind:string,marker:string,span:array<int>>>"
EDITS = "cast(array() as array<struct<at:int,more:int>>)"


def kinds(spans: Column) -> Column:
    """The kinds of entities among spans, sorted."""
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["kind"])))


def pick_spans(spans: Column, key: Column, n: Column) -> Column:
    """Up to two spans of different kinds, by draws, in order of their places."""
    of = lambda held, site: F.get(held, F.pmod(T.draw(key, site), F.greatest(F.size(held), F.lit(1)).cast("long")).cast("int"))
    second = lambda s: T.let(F.filter(spans, lambda x: x["kind"] != s["kind"]), lambda held: of(held, "corr.span2"))
    two = lambda s: F.filter(F.array(s, F.when(n > 1, second(s))), lambda x: x.isNotNull())
    return T.let(of(spans, "corr.span"), lambda s: F.array_sort(F.filter(two(s), lambda x: x.isNotNull())))


def corrected(text: Column, spans: Column, key: Column, level: Column, n: Column) -> Column:
    """struct<text, corrections, edits, wrong>: n entities of different kinds said wrong first. Fewer corrections are made where the text has fewer kinds.

    edits (at, more) are the places of those entities in the text and what was put before them; wrong are the spans of the wrong values.
    """
    bank = F.when(level == "easy", F.array(*map(F.lit, MARKERS_EASY))).when(level == "medium", F.array(*map(F.lit, MARKERS_MEDIUM))).otherwise(F.array(*map(F.lit, MARKERS_HARD)))

    def one(acc: Column, s: Column) -> Column:
        """acc.text is the text up to acc.upto with the corrections before the span."""
        own = F.concat(key, F.lit(":"), s["start"].cast("string"))
        allowed = F.filter(bank, lambda m: (s["start"] > 0) | ~m.isin("not", "I meant"))
        marker = F.get(allowed, F.pmod(T.draw(own, "corr.marker"), F.size(allowed).cast("long")).cast("int"))

        def put(wrong: Column, marker: Column) -> Column:
            phrase, before = inject.rendered(wrong, s["raw"], marker), F.substr(text, acc["upto"] + 1, s["start"] - acc["upto"])
            start = F.length(acc["text"]) + s["start"] - acc["upto"]
            c = F.struct(wrong.alias("abandoned"), s["raw"].alias("kept"), s["kind"].alias("kind"), marker.alias("marker"), F.array(start, start + F.length(phrase)).alias("span"))
            return F.struct(F.concat(acc["text"], before, phrase).alias("text"), s["end"].alias("upto"), F.concat(acc["made"], F.array(c)).alias("made"),
                            F.concat(acc["edits"], F.array(F.struct(s["start"].alias("at"), (F.length(phrase) - F.length(s["raw"])).alias("more")))).alias("edits"), F.concat(acc["wrong"], F.array(T.let(start + F.position(wrong, phrase) - 1, lambda x: F.struct(x.alias("start"), (x + F.length(wrong)).alias("end"))))).alias("wrong"))

        return T.let(other_value(s["kind"], s["raw"], own), lambda w: T.let(marker, lambda m: put(w, m)))

    state = F.struct(F.lit("").alias("text"), F.lit(0).alias("upto"), F.expr(f"cast(array() as {CORRECTIONS})").alias("made"), F.expr(EDITS).alias("edits"), F.expr(D.NO_SPANS).alias("wrong"))
    done = F.aggregate(pick_spans(spans, key, n), state, one)
    return T.let(done, lambda d: F.struct(F.concat(d["text"], F.substr(text, d["upto"] + 1)).alias("text"), d["made"].alias("corrections"), d["edits"], d["wrong"]))


def reformulated(text: Column, key: Column) -> Column:
    """struct<text, mode, abandoned>: a restart after some words, or a hedged distraction before the text."""
    def said(w: Column) -> Column:
        n = (F.pmod(T.draw(key, "ref.n"), F.greatest(F.lit(1), F.least(F.lit(4), F.size(w) - 2)).cast("long")) + 1).cast("int")
        prefix = F.array_join(F.slice(w, 1, n), " ")
        hedge = F.concat(T.upper_first(T.pick(key, "ref.hedge", HEDGES)), F.lit(" "), T.pick(key, "ref.distractor", DISTRACTORS))
        made = lambda mode, gone, marker: F.struct(F.concat(gone, F.lit(", "), marker, F.lit(", "), T.lower_first(text)).alias("text"), F.lit(mode).alias("mode"), gone.alias("abandoned"))
        return F.when(T.uniform(key, "ref.mode") < 0.6, made("restart", prefix, T.pick(key, "ref.marker", RESTARTS))).otherwise(made("distract", hedge, T.pick(key, "ref.turn", DISTRACT_MARKERS)))

    return T.let(T.words(text), said)


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def realize(rows: DataFrame) -> DataFrame:
    """rows (key, said: what is to be made noisy, clean, transforms, corrections: how many, difficulty, other columns) with input, made (corrections), restarts, clean_spans.

    Entities are extracted once, from the clean text and from what is said; their spans move with every change, so that repetitions and fillers never split one. Fewer
    corrections than asked for, for want of entities, show in ``made``.
    """
    key, level = F.col("key"), F.col("difficulty")
    has = lambda t: F.array_contains("transforms", t)
    null = F.lit(None).cast("string")
    r = rows.withColumn("clean_spans", E.resolve(E.candidates("clean"))).withColumn("__s", E.resolve(E.candidates("said")))
    whole = F.struct(F.col("said").alias("text"), F.expr(f"cast(array() as {CORRECTIONS})").alias("corrections"), F.expr(EDITS).alias("edits"), F.expr(D.NO_SPANS).alias("wrong"))
    r = r.withColumn("__c", T.once(F.when(has("self_correction"), corrected(F.col("said"), F.col("__s"), key, level, F.col("corrections"))).otherwise(whole)))
    r = r.withColumn("__ct", T.part("__c", "text"))
    r = r.withColumn("__r", T.once(F.when(has("reformulation"), reformulated(F.col("__ct"), key)).otherwise(F.struct(F.col("__ct").alias("text"), null.alias("mode"), null.alias("abandoned")))))
    r = r.withColumn("__rt", T.part("__r", "text")).withColumn("__front", F.length("__rt") - F.length("__ct"))
    ahead = F.array(F.struct(F.lit(0).alias("at"), F.col("__front").alias("more")))  # a reformulation stands before all
    front = F.when(F.col("__front") > 0, F.array(F.struct(F.lit(0).alias("start"), F.col("__front").alias("end")))).otherwise(F.expr(D.NO_SPANS))
    phrases = F.transform(T.part("__c", "corrections"), lambda c: F.struct(c["span"][0].alias("start"), c["span"][1].alias("end")))
    hard = F.concat(D.moved(D.moved(_plain(F.col("__s")), T.part("__c", "edits")), ahead), D.moved(T.part("__c", "wrong"), ahead), front)
    r = r.withColumn("__hard", F.array_sort(hard)).withColumn("__soft", D.moved(phrases, ahead))
    r = r.withColumn("__rep", T.once(F.when(has("repetition"), D.repeated(F.col("__rt"), key, level, F.concat("__hard", "__soft"))).otherwise(D.unedited(F.col("__rt")))))
    r = r.withColumn("__rept", T.part("__rep", "text")).withColumn("__hard", D.moved(F.col("__hard"), T.part("__rep", "edits"))).withColumn("__soft", D.moved(F.col("__soft"), T.part("__rep", "edits")))
    r = r.withColumn("input", F.when(has("filler"), D.filler(F.col("__rept"), key, level, F.col("__hard"), F.col("__soft"))).otherwise(F.col("__rept")))
    restart = F.struct(T.part("__r", "mode").alias("mode"), T.part("__r", "abandoned").alias("abandoned"), F.col("said").alias("kept"))
    r = r.withColumn("made", T.part("__c", "corrections")).withColumn("restarts", F.filter(F.array(restart), lambda x: x["mode"].isNotNull()))
    return r.drop("__s", "__c", "__ct", "__r", "__rt", "__front", "__hard", "__soft", "__rep", "__rept")
