"""Entity spans: candidates from one Arrow function, overlaps resolved in Catalyst."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

KINDS = ("time", "date", "name", "item", "location", "tech", "number")
SPANS = ArrayType(StructType().add("start", "integer").add("end", "integer").add("kind", "string").add("raw", "string").add("rank", "integer"))
#: Own word lists (fixed values); larger ones can be given to ``matchers``.
NAMES = ("Ada", "Bruno", "Chidi", "Dana", "Elif", "Farid", "Greta", "Hana", "Igor", "Jun")
ITEMS = ("beach towel", "notebook", "umbrella", "coffee", "charger", "backpack", "lamp", "ticket")
LOCATIONS = ("the beach", "the office", "the station", "the library", "the airport", "the park")
TECH = ("Postgres", "Kafka", "Docker", "Linux", "Spark", "Python")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
RELATIVE = ("today", "tomorrow", "yesterday")
PARTS = ("morning", "afternoon", "evening", "night")
NUMBER_WORDS = ("two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "twenty", "thirty", "fifty")


def _any(values: tuple) -> str:
    return "|".join(re.escape(v) for v in sorted(values, key=len, reverse=True))


def matchers() -> list[tuple[str, re.Pattern]]:
    """Kinds in their order with bounded expressions; names keep their case."""
    i = re.IGNORECASE
    return [
        ("time", re.compile(r"\b\d{1,2}(?::\d{2})?\s?(?:am|pm)\b|\b\d{1,2}:\d{2}\b|\b\d{1,2}\so'clock\b|\b(?:half past|quarter past|quarter to)\s\d{1,2}\b|\b(?:noon|midnight)\b", i)),
        ("date", re.compile(rf"\b(?:{_any(MONTHS)})\s\d{{1,2}}(?:st|nd|rd|th)?\b|\bthe\s\d{{1,2}}(?:st|nd|rd|th)\sof\s(?:{_any(MONTHS)})\b|\b(?:(?:next|this)\s(?:{_any(DAYS)})|(?:{_any(DAYS)})(?:\s(?:{_any(PARTS)}))?)\b|\b(?:{_any(RELATIVE)})\b", i)),
        ("name", re.compile(rf"\b(?:{_any(NAMES)})(?:\s[A-Z][a-z]+)?\b")),
        ("item", re.compile(rf"\b(?:{_any(ITEMS)})s?\b", i)),
        ("location", re.compile(rf"\b(?:{_any(LOCATIONS)})\b", i)),
        ("tech", re.compile(rf"\b(?:{_any(TECH)})\b", i)),
        ("number", re.compile(rf"\$\d+(?:\.\d{{2}})?|\b\d+(?:\.\d+)*(?:\s?percent|%)?\b|\b(?:{_any(NUMBER_WORDS)})\b", i)),
    ]


_BANK = matchers()


@F.pandas_udf(SPANS)
def candidates(text: pd.Series) -> pd.Series:
    """Every match of every kind with its offsets and the rank of its kind."""
    return text.map(lambda t: [{"start": m.start(), "end": m.end(), "kind": k, "raw": m.group(), "rank": i} for i, (k, r) in enumerate(_BANK) for m in r.finditer(t or "")])


def resolve(cands: Column) -> Column:
    """Longest first, then leftmost, then by kind: a span is kept if it is disjoint from all kept ones; sorted by start."""
    order = F.array_sort(F.transform(cands, lambda s: F.struct((s["start"] - s["end"]).alias("neg"), s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["raw"].alias("raw"))))
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:string,raw:string>>)")
    pick = lambda s: F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["raw"].alias("raw")))
    kept = F.aggregate(order, none, lambda acc, s: F.when(F.exists(acc, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), acc).otherwise(F.concat(acc, pick(s))))
    return F.array_sort(kept)


def canonical(spans: Column, kind: str | None = None) -> Column:
    """Sorted distinct canonical values, of one kind or all."""
    own = spans if kind is None else F.filter(spans, lambda s: s["kind"] == kind)
    return F.array_sort(F.array_distinct(F.transform(own, lambda s: F.lower(F.regexp_replace(F.trim(s["raw"]), "\\s+", " ")))))


def inventory(spans: Column) -> Column:
    return F.struct(*[canonical(spans, k).alias(f"{k}s") for k in KINDS])


def preservation(expected: Column, actual: Column) -> Column:
    """Share of expected entities found; 1 if none is expected."""
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(F.array_intersect(expected, actual)) / F.size(expected))


def invented(expected: Column, actual: Column, abandoned: Column) -> Column:
    """Entities of the answer that are neither expected nor abandoned."""
    return F.array_sort(F.array_except(F.array_except(actual, expected), abandoned))


def correction_failures(corrections: Column, actual: Column, expected: Column) -> Column:
    """Failures of a chain of corrections (abandoned, kept): a kept value that the next one abandons must be gone, else present;
    an abandoned value must be gone unless the expected text holds it; an empty kept value is a deletion."""
    has = lambda t, v: F.contains(F.lower(t), F.lower(v))

    def one(c: Column, i: Column) -> Column:
        after = F.get(corrections, i + 1)["abandoned"]
        superseded = F.coalesce(after == c["kept"], F.lit(False))
        kept = F.when(c["kept"] == "", None).when(superseded, F.when(has(actual, c["kept"]), "superseded-survived")).otherwise(F.when(~has(actual, c["kept"]), "kept-missing"))
        gone = F.when(has(actual, c["abandoned"]) & ~has(expected, c["abandoned"]), "abandoned-survived")
        return F.array(kept, gone)

    return F.filter(F.flatten(F.transform(corrections, one)), lambda x: x.isNotNull())


def nearest(expected: Column, actual: Column, most: int = 2) -> Column:
    """(missing, found, distance) of the closest corrupted entity: an expected one absent from the answer within most edits of one there."""
    missing = F.array_except(expected, actual)
    pairs = F.flatten(F.transform(missing, lambda m: F.transform(actual, lambda a: F.struct(F.levenshtein(m, a).alias("distance"), m.alias("missing"), a.alias("found")))))
    return F.array_min(F.filter(pairs, lambda p: p["distance"] <= most))
