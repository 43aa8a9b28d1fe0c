"""Values of large lexicons in texts: one automaton over all of them, so a text is read once however many values there are.

A value is found where no letter, digit or underscore stands right before or after it, every occurrence of every value, overlapping
ones too; ``entities.resolve`` makes them disjoint. Values match in any case unless they are cased.

Cases: a null or empty text has no spans, an empty or null value matches nothing, values repeated under a kind (cased and not, too) count once, a value of
several kinds gives a span of each, an empty lexicon finds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .entities import SPANS

#: Code points of values that one automaton holds (about 100 bytes each in memory); a larger lexicon is matched in several.
SLICE_CHARS = 2_000_000


def folded(text: str) -> str:
    """Lower case of the same length: characters that would become several stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


def automaton(values: list[tuple[str, str, int, bool]]) -> ahocorasick.Automaton:
    """Of (kind, value, rank, cased): each folded value with all that it stands for."""
    held: dict[str, set] = {}
    for kind, value, rank, cased in values:
        if value:
            held.setdefault(folded(value), set()).add((kind, rank, value if cased else None))
    made = ahocorasick.Automaton()
    for key, meant in held.items():
        made.add_word(key, (len(key), sorted(meant, key=lambda m: (m[1], m[0], m[2] or ""))))
    made.make_automaton()
    return made


def found(made: ahocorasick.Automaton, text: str | None) -> list[dict]:
    """The spans of one text, sorted by start, end, rank and kind; a kind meets a place once."""
    if not text or not len(made):
        return []
    inner = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
    spans = []
    for last, (n, meant) in made.iter(folded(text)):
        start, end = last + 1 - n, last + 1
        if not inner(start - 1) and not inner(end):
            raw = text[start:end]
            spans += [{"start": start, "end": end, "kind": kind, "raw": raw, "rank": rank} for kind, rank in {(kind, rank) for kind, rank, exact in meant if exact is None or exact == raw}]
    return sorted(spans, key=lambda s: (s["start"], s["end"], s["rank"], s["kind"]))


def dictionary(lexicon: DataFrame, slice_chars: int = SLICE_CHARS) -> Callable[[Column], Column]:
    """A function from a text column to its spans, for a lexicon of kind, value, rank (int, of the kind), cased (boolean).

    The lexicon is dealt by hash into as many slices as its measured size asks for. The driver holds one at a time and every worker
    makes its automaton once; a slice is bounded, so executors' memory does not depend on a single value or kind.
    """
    spark = lexicon.sparkSession
    values = lexicon.where("value <> ''").select("kind", "value", F.col("rank").cast("int"), F.col("cased").cast("boolean")).distinct()
    chars = values.agg(F.sum(F.length("value"))).first()[0] or 0
    slices = -(-chars // slice_chars)
    parts = []
    for i in range(slices):
        rows = values.where(F.pmod(F.xxhash64(F.lower("value")), F.lit(slices)) == i).collect()  # one slice, bounded above
        parts.append(_matcher(spark.sparkContext.broadcast([tuple(r) for r in rows])))
    none = F.array().cast(SPANS)
    if len(parts) < 2:
        return parts[0] if parts else lambda text: none
    return lambda text: F.array_distinct(F.concat(*[p(text) for p in parts]))  # forms of one value may be in two slices


def _matcher(rows) -> Callable[[Column], Column]:  # noqa: ANN001
    made: list = []

    @F.pandas_udf(SPANS)
    def spans(text: pd.Series) -> pd.Series:
        if not made:
            made.append(automaton(rows.value))
        return text.map(lambda t: found(made[0], t))

    return spans
