"""Text expressions of the engine, as Column helpers inside Catalyst; one Arrow function for NFKC, used on non-ASCII text only."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .constants import ARTIFACTS, FILLERS, INSTRUCTION

def let(value: Column, body) -> Column:
    """body(value) with value computed once: an expression inside a lambda is otherwise computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(value: Column) -> Column:
    """A struct as a column that later steps read by ``part``: fields of a plain struct are computed again for every step that reads one."""
    return F.array(value)


def part(column: str, field: str) -> Column:
    return F.element_at(F.col(column), 1)[field]


def words(text: Column) -> Column:
    """Words between single spaces; empty ones are dropped, null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), " "), "")


def unicode_words(text: Column) -> Column:
    """Words between any Unicode white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "(?U)\\s+"), "")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def unquoted(text: Column) -> Column:
    """Trimmed, with one pair of double quotes around it taken away."""
    t = F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")
    quoted = (F.length(t) >= 2) & t.startswith('"') & t.endswith('"')
    return F.when(quoted, F.regexp_replace(t, '(?s)^"(.*)"$', "$1")).otherwise(t)


def normalize_ascii(text: Column) -> Column:
    """normalize for text that NFKC does not change."""
    return F.regexp_replace(F.regexp_replace(F.lower(unquoted(text)), "(?U)^\\s+|\\s+$", ""), "(?U)\\s+", " ")


def normalize(text: Column) -> Column:
    """NFKC, trimmed, one pair of quotes dropped, lower case, single spaces."""
    return normalize_ascii(F.when(text.rlike("[^\\x00-\\x7F]"), _nfkc(text)).otherwise(text))


def normalize_verbatim(text: Column) -> Column:
    """Drop [tags] and the asterisks of cut-off words; collapse white space."""
    t = F.regexp_replace(F.regexp_replace(text, "\\[[A-Za-z_]+\\]", " "), "(?U)(\\w)\\*", "$1")
    return F.trim(F.regexp_replace(t, "(?U)\\s+", " "))


def lower_first(t: Column) -> Column:
    return F.concat(F.lower(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))


def upper_first(t: Column) -> Column:
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))


def strip_terminator(t: Column) -> Column:
    return F.rtrim(F.regexp_replace(t, "[.!?]+$", ""))


def shingles(w: Column, n: int = 3) -> Column:
    """Distinct n-grams of words; none for fewer words."""
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    return let(w, lambda w: F.when(F.size(w) >= n, F.array_distinct(grams(w))).otherwise(F.expr("cast(array() as array<string>)")))


def markdown_lines(t: Column) -> Column:
    return F.filter(F.split(t, "\n"), lambda x: x.rlike("^(\\s*(-|[0-9]+\\.)\\s|#{1,3}\\s)"))


def duplications(w: Column) -> Column:
    """Distinct adjacent equal words and word pairs, sorted."""
    return let(w, _duplications)


def _duplications(w: Column) -> Column:
    one = F.filter(F.transform(w, lambda x, i: F.when(F.get(w, i + 1) == x, x)), lambda x: x.isNotNull())
    pair = lambda i: F.array_join(F.slice(w, i + 1, 2), " ")
    two = F.filter(F.transform(w, lambda x, i: F.when((i + 4 <= F.size(w)) & (pair(i) == F.array_join(F.slice(w, i + 3, 2), " ")), pair(i))), lambda x: x.isNotNull())
    return F.array_sort(F.array_union(one, two))


def filler_count(t: Column) -> Column:
    """Fillers in lower-cased text, longer ones first; the list is lower-cased too, so that those with a capital count."""
    bank = "|".join(sorted(map(str.lower, FILLERS), key=len, reverse=True))
    return F.regexp_count(F.lower(t), F.lit(f"\\b(?:{bank})\\b"))


def word_in(word: str, t: Column) -> Column:
    """Whether the word stands in the text with no ASCII letter right before or after it; not in a null text."""
    return F.coalesce(t.rlike(f"(?<![A-Za-z])\\Q{word}\\E(?![A-Za-z])"), F.lit(False))


def marker_between(t: Column, abandoned: Column, kept: Column) -> Column:
    """What stands between the first ``abandoned`` and the next ``kept`` after it, without blanks, commas and hyphens around it; null if either is missing."""
    at = F.position(abandoned, t)
    end = at + F.length(abandoned)
    to = F.position(kept, t, end)
    return F.when((at > 0) & (to > 0), F.btrim(F.substr(t, end, to - end), F.lit(" ,-")))


def has_artifact(normal: Column) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in ARTIFACTS]), lambda p: F.startswith(normal, p) | F.endswith(normal, p))


def token_recall(expected: Column, actual: Column) -> Column:
    """Multiset recall of words: sum of the smaller counts over the number expected; 1 if none is."""
    return let(expected, lambda e: let(actual, lambda a: _recall(e, a)))


def _recall(expected: Column, actual: Column) -> Column:
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    hit = F.aggregate(F.array_distinct(expected), F.lit(0), lambda acc, x: acc + F.least(count(expected, x), count(actual, x)))
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(hit / F.size(expected))


def content_tokens(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit("([a-z0-9']+)"), F.lit(1))


def edit_distance(a: Column, b: Column) -> Column:
    """levenshtein, at the cost of the distance times the length where one text holds the other or few characters differ: the same number otherwise too."""
    few = F.levenshtein(a, b, 16)  # -1 beyond 16, in a band of the table
    other = F.when(few >= 0, few).otherwise(F.levenshtein(a, b))
    return F.when(F.contains(a, b), F.length(a) - F.length(b)).when(F.contains(b, a), F.length(b) - F.length(a)).otherwise(other)


def word_errors(ref: Column, hyp: Column) -> Column:
    """Edit distance of word arrays: words become single characters by their place among the distinct ones, then levenshtein."""
    return let(F.array_distinct(F.concat(ref, hyp)), lambda known: _word_errors(ref, hyp, known))


def _word_errors(ref: Column, hyp: Column, known: Column) -> Column:
    code = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 31), 4, "0")), "UTF-16BE")
    return F.levenshtein(F.array_join(F.transform(ref, code), ""), F.array_join(F.transform(hyp, code), ""))


def error_rate(errors: Column, n: Column, empty_ok: Column) -> Column:
    return F.when(n == 0, F.when(empty_ok, 0.0).otherwise(1.0)).otherwise(errors / n)


def percentile_floor(values: Column, p: float) -> Column:
    """sorted[min(n - 1, floor(n p))] of an array; 0 when empty."""
    n = F.size(values)
    return F.when(n == 0, 0).otherwise(F.element_at(F.array_sort(values), F.least(n - 1, F.floor(n * F.lit(p)).cast("int")) + 1))


def draw(key: Column, site: str, seed: int = 42) -> Column:
    """60 bits from md5(seed:key:site): the same for a key and site in any partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key, F.lit(site))), 1, 15), 16, 10).cast("long")


def uniform(key: Column, site: str, seed: int = 42) -> Column:
    return draw(key, site, seed) / F.lit(float(1 << 60))


def pick(key: Column, site: str, values: tuple, seed: int = 42) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(draw(key, site, seed), F.lit(len(values))) + 1).cast("int"))


def seed_of(key: Column) -> Column:
    """First eight bytes of md5 as an unsigned 64-bit number."""
    return F.conv(F.substring(F.md5(key), 1, 16), 16, 10).cast("decimal(20,0)")


def ordinal(n: Column) -> Column:
    suffix = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def chat(user: Column, answer: Column) -> Column:
    """A training example in ChatML markers."""
    return F.concat(F.lit(f"<|im_start|>system\n{INSTRUCTION}<|im_end|>\n<|im_start|>user\n"), user, F.lit("<|im_end|>\n<|im_start|>assistant\n"), answer, F.lit("<|im_end|>"))


def answer_of(output: Column, raw: Column) -> Column:
    """A model's output without its thoughts and end mark; the raw text if nothing is left."""
    t = F.trim(F.replace(F.regexp_replace(output, "(?s)<think>.*?</think>", ""), F.lit("<|im_end|>"), F.lit("")))
    return F.coalesce(F.nullif(t, F.lit("")), F.trim(raw))


def version_ok(v: Column) -> Column:
    """YYYYMMDD.N with a month of 1-12 and a day of 1-31."""
    return v.rlike("^[0-9]{8}\\.[0-9]+$") & F.substring(v, 5, 2).cast("int").between(1, 12) & F.substring(v, 7, 2).cast("int").between(1, 31)
