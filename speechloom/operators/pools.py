"""Draws without replacement over families of pools, by a fold that carries what is used.

Every value has a place in its family: the pools of a family are ranges of places, so a family's members share one set of used places. A draw is a number
below the count of free places of its range, shifted past the used ones: nothing is drawn again, and an exhausted pool gives null. Values of a
lexicon are joined by family and place; made values (times, numbers) are expressions of their place, so they never repeat either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .entities import DAYS, MONTHS, NUMBER_WORDS, PARTS

#: The pools of the lexicon's families, in the order of their places.
FAMILIES = {"name": ("name",), "surname": ("surname",), "location": ("location",), "item": ("item_p", "item_s"), "tech": ("tech_p", "tech_s")}
QUARTERS = ("00", "15", "30", "45")


def _of(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def _div(a: Column, n: int) -> Column:
    return F.floor(a / F.lit(n)).cast("long")


#: kind: forms (share in 100, places, the value of a place).
MADE = {
    "number": ((65, 999, lambda p: (p + 1).cast("string")), (35, len(NUMBER_WORDS), lambda p: _of(NUMBER_WORDS, p))),
    "price": ((100, 9900, lambda p: F.concat(F.lit("$"), _div(p, 100) + 1, F.lit("."), F.lpad((p % 100).cast("string"), 2, "0"))),),
    "percent": ((100, 91, lambda p: F.concat(p + 5, F.lit(" percent"))),),
    "version": ((100, 900, lambda p: F.concat(_div(p, 100) + 1, F.lit("."), _div(p % 100, 10), F.lit("."), p % 10)),),
    "duration": ((100, 18, lambda p: F.concat(5 * (p + 1), F.lit(" minutes"))),),
    "port": ((80, 100, lambda p: (p + 8000).cast("string")), (20, 16384, lambda p: (p + 49152).cast("string"))),
    "id": ((70, 9000, lambda p: (p + 1000).cast("string")), (30, 90000, lambda p: (p + 10000).cast("string"))),
    "time": (
        (25, 24, lambda p: F.concat(_div(p, 2) + 1, F.lit(" "), _of(("AM", "PM"), p % 2))), (25, 96, lambda p: F.concat(_div(p, 8) + 1, F.lit(":"), _of(QUARTERS, _div(p % 8, 2)), F.lit(" "), _of(("AM", "PM"), p % 2))),
        (20, 11, lambda p: F.concat(F.lit("half past "), p + 1)), (15, 24, lambda p: F.concat(_of(("quarter past ", "quarter to "), p % 2), _div(p, 2) + 1)), (10, 12, lambda p: F.concat(p + 1, F.lit(" o'clock"))), (5, 2, lambda p: _of(("noon", "midnight"), p)),
    ),
    "date": (
        (35, 7, lambda p: _of(DAYS, p)), (15, 7, lambda p: F.concat(F.lit("next "), _of(DAYS, p))), (21, 336, lambda p: F.concat(_of(MONTHS, _div(p, 28)), F.lit(" "), T.ordinal(p % 28 + 1))),
        (14, 336, lambda p: F.concat(_of(MONTHS, _div(p, 28)), F.lit(" "), p % 28 + 1)), (15, 28, lambda p: F.concat(_of(DAYS, _div(p, 4)), F.lit(" "), _of(PARTS, p % 4))),
    ),
}


def ranked(df: DataFrame, by: list[str], key: str, name: str, then: list[str] | None = None) -> DataFrame:
    """df with the place from 0 of each row among those of equal ``by``, in the order of md5(key), then key, then the columns given.

    Rows are ranked within 4,096 ranges of the hash and shifted by the counts of the ranges before, so no task holds a group.
    """
    d = df.withColumn("__h", F.md5(F.col(key).cast("string"))).withColumn("__b", F.substring("__h", 1, 3))
    counts = d.groupBy(*by, "__b").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*by, "__b", before.alias("__before"))
    d = d.join(counts, [*by, "__b"])
    return d.withColumn(name, F.row_number().over(W.partitionBy(*by, "__b").orderBy("__h", key, *(then or []))) - 1 + F.col("__before")).drop("__h", "__b", "__before")


class Pools:
    """The ranges of all kinds and the table of a lexicon's values (family, place, value). Sizes are counted: one number a kind."""

    def __init__(self, lexicon: DataFrame):
        kinds = [k for pools in FAMILIES.values() for k in pools]
        own = lexicon.where(F.col("kind").isin(*kinds)).distinct()
        sizes = {r["kind"]: r["n"] for r in own.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        self.ranges: dict[str, list[tuple[int, str, int, int]]] = {}  # kind: (share, family, first place, places)
        first = {}
        for family, pools in FAMILIES.items():
            at = 0
            for k in pools:
                first[k] = at
                self.ranges[k] = [(100, family, at, sizes.get(k, 0))]
                at += sizes.get(k, 0)
            self.ranges[family] = [(100, family, 0, at)]
        for kind, forms in MADE.items():
            at, held = 0, []
            for share, n, _ in forms:
                held.append((share, kind, at, n))
                at += n
            self.ranges[kind] = held
        choose = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("kind"))
        family = choose({k: f for f, pools in FAMILIES.items() for k in pools})
        self.values = ranked(own, ["kind"], "value", "place").select(family.alias("family"), (F.col("place") + choose(first)).cast("long").alias("place"), "value")

    def _range(self, kind: Column, key: Column, i: Column) -> Column:
        """(family, lo, n) of the i-th draw; the form of a made value is a draw of its own."""
        return T.let(F.pmod(draw_at(key, "form", i), F.lit(100)), lambda u: self._form(kind, u))

    def _form(self, kind: Column, u: Column) -> Column:
        out = F.lit(None).cast("struct<family:string,lo:long,n:long>")
        for k, forms in self.ranges.items():
            at, chosen = 100, None
            for share, family, lo, n in reversed(forms):
                held = F.struct(F.lit(family).alias("family"), F.lit(lo).cast("long").alias("lo"), F.lit(n).cast("long").alias("n"))
                chosen = held if chosen is None else F.when(u < at, held).otherwise(chosen)
                at -= share
            out = F.when(kind == k, chosen).otherwise(out)
        return out

    def draws(self, kinds: Column, key: Column) -> Column:
        """array<struct<family, place>> for an array of kinds, in order; place is null where the pool has nothing left or the kind is unknown."""
        ranges = F.transform(kinds, lambda k, i: self._range(k, key, i))
        none = F.expr("cast(array() as array<struct<family:string,place:long>>)")

        def shifted(used: Column, acc: Column, r: Column) -> Column:
            free = r["n"] - F.size(used)
            at = F.when(free > 0, F.pmod(draw_at(key, "draw", F.size(acc)), free))
            return F.aggregate(used, at, lambda p, u: F.when(u <= p, p + 1).otherwise(p))

        def drawn(acc: Column, r: Column) -> Column:
            used = F.sort_array(F.transform(F.filter(acc, lambda u: (u["family"] == r["family"]) & (u["place"] >= r["lo"]) & (u["place"] < r["lo"] + r["n"])), lambda u: u["place"] - r["lo"]))
            return T.let(used, lambda used: shifted(used, acc, r)) + r["lo"]

        one = lambda acc, r: F.concat(acc, F.array(F.struct(r["family"].alias("family"), drawn(acc, r).alias("place"))))
        return F.aggregate(ranges, none, one)


def draw_at(key: Column, site: str, i: Column) -> Column:
    """A draw for a numbered decision of a key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("42"), key, F.lit(site), i.cast("string"))), 1, 15), 16, 10).cast("long")


def made_value(family: Column, place: Column) -> Column:
    """The value of a made kind's place; null for families of the lexicon."""
    out = F.lit(None).cast("string")
    for kind, forms in MADE.items():
        at, value = 0, F.lit(None).cast("string")
        for _, n, f in forms:
            value = F.when((place >= at) & (place < at + n), f(place - at)).otherwise(value)
            at += n
        out = F.when(family == kind, value).otherwise(out)
    return out


def resolved(draws: DataFrame, pools: Pools) -> DataFrame:
    """draws (family, place, other columns) with value; a join by family and place, which Spark broadcasts only if the lexicon is small."""
    j = draws.join(pools.values, ["family", "place"], "left")
    return j.withColumn("value", F.coalesce("value", made_value(F.col("family"), F.col("place"))))


def filled(pattern: Column, values: Column) -> Column:
    """The pattern with its slots replaced: the k-th slot of a kind takes the k-th of the values (kind, value) of that kind. Null if one is missing."""
    def put(pieces: Column, kinds: Column, values: Column) -> Column:
        nth = lambda k, i: F.size(F.filter(F.slice(kinds, 1, i), lambda x: x == k))
        of = lambda k, i: F.get(F.filter(values, lambda v: v["kind"] == k), nth(k, i))["value"]
        return F.concat(F.element_at(pieces, 1), F.aggregate(F.transform(kinds, lambda k, i: F.concat(of(k, i), F.get(pieces, i + 1))), F.lit(""), lambda a, x: F.concat(a, x)))

    return T.let(F.split(pattern, r"\{\w+\}"), lambda p: T.let(slots(pattern), lambda k: T.let(values, lambda v: put(p, k, v))))


def slots(pattern: Column) -> Column:
    """The kinds of a pattern's slots, in order."""
    return F.regexp_extract_all(pattern, F.lit(r"\{(\w+)\}"), F.lit(1))

