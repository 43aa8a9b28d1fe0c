"""Fillers and repetitions by difficulty, never within protected spans: tokens with their places, all in Catalyst.

A span (an entity, a correction said just before) is a struct with start and end. A gap between two tokens is closed if a span reaches from one to the other; a token is
closed if a span overlaps it. Every choice is a draw by the record's key; picks are a fold that carries the tokens in use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import FILLERS
from .longform import in_hash_order
from .pools import draw_at

#: Fillers and repetitions by difficulty (least, most).
FILLER_COUNTS = {"easy": (1, 1), "medium": (1, 2), "hard": (2, 4)}
REPEAT_COUNTS = {"easy": (1, 1), "medium": (1, 2), "hard": (2, 3)}
NO_SPANS = "cast(array() as array<struct<start:int,end:int>>)"


def tokens(text: Column) -> Column:
    """array<struct<token, start, end>>: what stands between white space, with its places."""
    t = F.coalesce(text, F.lit(""))
    found = lambda pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))

    def add(ends: Column, piece: Column) -> Column:
        return F.concat(ends, F.array(F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0)) + F.length(piece)))

    ends = F.aggregate(found("(?U)\\s*\\S+"), F.expr("cast(array() as array<int>)"), add)  # of tokens with the space before them: one for each
    held = F.arrays_zip(found("(?U)\\S+").alias("token"), ends.alias("end"))
    return F.transform(held, lambda x: F.struct(x["token"].alias("token"), (x["end"] - F.length(x["token"])).alias("start"), x["end"].alias("end")))


def count(key: Column, level: Column, site: str, bounds: dict[str, tuple[int, int]]) -> Column:
    """A draw between the bounds of a difficulty; unknown ones count as hard."""
    of = lambda lo, hi: (F.pmod(T.draw(key, site), F.lit(hi - lo + 1)) + lo).cast("int")
    return F.when(level == "easy", of(*bounds["easy"])).when(level == "medium", of(*bounds["medium"])).otherwise(of(*bounds["hard"]))


def _said(c: Column) -> Column:
    return c.rlike("(?U)^[\\p{L}\\p{N}]")


def unedited(text: Column) -> Column:
    return F.struct(text.alias("text"), F.expr("cast(array() as array<struct<at:int,more:int>>)").alias("edits"))


def open_gaps(toks: Column, spans: Column, soft: Column, level: Column) -> Column:
    """Numbers of the tokens after which a filler may stand: the next one is a word, and no span reaches over. Soft spans do not count at the hard level."""
    hit = lambda held, a, b: F.exists(held, lambda s: (a["end"] >= s["start"]) & (b["start"] <= s["end"]))
    ok = lambda i: T.let(F.get(toks, i), lambda a: T.let(F.get(toks, i + 1), lambda b: _said(b["token"]) & ~hit(spans, a, b) & ((level == "hard") | ~hit(soft, a, b))))
    return F.filter(F.when(F.size(toks) > 1, F.sequence(F.lit(0), F.size(toks) - 2)).otherwise(F.expr("cast(array() as array<int>)")), ok)


def filler(text: Column, key: Column, level: Column, spans: Column, soft: Column | None = None, toks: Column | None = None) -> Column:
    """Text with one to four fillers in open gaps, or one before the text if no gap is open; toks are the text's tokens, where they are known."""
    soft = F.expr(NO_SPANS) if soft is None else soft
    said = F.slice(in_hash_order(F.array(*map(F.lit, FILLERS)), key, "fill.word"), 1, count(key, level, "fill.n", FILLER_COUNTS))

    def put(toks: Column, gaps: Column, said: Column) -> Column:
        chosen = F.slice(in_hash_order(F.transform(gaps, lambda g: g.cast("string")), key, "fill.gap"), 1, F.size(said))
        pairs = F.array_sort(F.transform(chosen, lambda g, i: F.struct((-F.get(toks, g.cast("int"))["end"]).alias("at"), F.get(said, i).alias("word"))))
        inside = F.aggregate(pairs, text, lambda t, p: F.concat(F.substr(t, F.lit(1), -p["at"]), F.lit(", "), p["word"], F.lit(","), F.substr(t, 1 - p["at"])))
        first = F.lower(F.get(said, F.lit(0)))
        return F.when(F.size(gaps) > 0, inside).otherwise(F.concat(T.upper_first(first), F.lit(", "), T.lower_first(text)))

    gaps = lambda toks: T.let(spans, lambda spans: T.let(soft, lambda soft: open_gaps(toks, spans, soft, level)))
    return T.let(tokens(text) if toks is None else toks, lambda toks: T.let(gaps(toks), lambda gaps: T.let(said, lambda said: put(toks, gaps, said))))


_PICK = "struct<first:int,k:int,form:string>"


def _pick(toks: Column, free: Column, used: Column, key: Column, i: Column) -> Column:
    """(first token, tokens, form) of the i-th repetition: a word, a phrase, a stutter or an echoed clause; null if no word is free."""
    n, form = F.size(toks), F.pmod(draw_at(key, "rep.form", i), F.lit(100))
    at = lambda c: F.get(c, F.pmod(draw_at(key, "rep.at", i), F.greatest(F.size(c), F.lit(1)).cast("long")).cast("int"))
    one = lambda x, k, form: F.struct(x.cast("int").alias("first"), F.lit(k).alias("k"), F.lit(form).alias("form"))

    def runs(words: Column, k: int, upto: Column, form: str) -> Column:
        """The places where k tokens in a row are free, up to a last token: words ascend, so the k-th from here is k - 1 further on."""
        inside = F.filter(words, lambda x, i: (x + k <= upto) & (F.get(words, i + (k - 1)) == x + (k - 1)))
        return F.transform(inside, lambda x: one(x, k, form))

    def choose(words: Column, u: Column) -> Column:
        phrases = F.concat(runs(words, 3, n, "phrase"), runs(words, 2, n, "phrase"))
        clauses = F.concat(*[runs(words, k, n - 2, "clause") for k in (4, 3, 2)])
        parts = F.transform(F.filter(words, lambda x: T.let(F.get(toks, x)["token"], lambda t: (F.length(t) >= 4) & t.rlike("(?U)^\\p{L}+$"))), lambda x: one(x, 1, "stutter"))
        word = at(F.transform(words, lambda x: one(x, 1, "word")))
        other = lambda found, ok: F.coalesce(F.when(ok, T.let(found, at)), word)
        some = F.when((u < 40) | (F.size(words) < 2), word).when((u < 65) & (n >= 4), other(phrases, F.lit(True))).when(u < 85, other(parts, F.lit(True))).otherwise(other(clauses, n >= 6))
        return F.when(F.size(words) > 0, some)

    return T.let(F.filter(free, lambda x: ~F.array_contains(used, x)), lambda words: T.let(form, lambda u: choose(words, u)))


def moved(spans: Column, edits: Column) -> Column:
    """Spans (start, end) after edits (at, more): what starts at an edit or after it moves on by what the edit adds."""
    by = lambda s: F.aggregate(F.filter(edits, lambda e: e["at"] <= s["start"]), F.lit(0), lambda a, e: a + e["more"])
    return F.transform(spans, lambda s: T.let(by(s), lambda n: F.struct((s["start"] + n).alias("start"), (s["end"] + n).alias("end"))))


def repetition(text: Column, key: Column, level: Column, spans: Column, toks: Column | None = None) -> Column:
    """Text with one to three repetitions of words outside spans; the first token is said twice if there is none."""
    return repeated(text, key, level, spans, toks)["text"]


def repeated(text: Column, key: Column, level: Column, spans: Column, toks: Column | None = None) -> Column:
    """struct<text, edits> of ``repetition``; edits (at, more) are where a repeated part starts and what it adds. toks are the text's tokens, where they are known."""
    def picks(toks: Column, free: Column) -> Column:
        state = F.struct(F.expr("cast(array() as array<int>)").alias("used"), F.expr(f"cast(array() as array<{_PICK}>)").alias("got"))
        more = lambda a, p: F.when(p.isNull(), a).otherwise(F.struct(F.concat(a["used"], F.sequence(p["first"], p["first"] + p["k"] - 1)).alias("used"), F.concat(a["got"], F.array(p)).alias("got")))
        got = F.aggregate(F.sequence(F.lit(0), count(key, level, "rep.n", REPEAT_COUNTS) - 1), state, lambda a, i: T.let(_pick(toks, free, a["used"], key, i), lambda p: more(a, p)))["got"]
        return T.let(got, lambda g: F.when(F.size(g) > 0, g).otherwise(F.array(F.struct(F.lit(0).alias("first"), F.lit(1).alias("k"), F.lit("word").alias("form")))))

    def rebuilt(toks: Column, got: Column) -> Column:
        def say(t: Column, p: Column) -> Column:
            start, end = F.get(toks, p["first"])["start"], F.get(toks, p["first"] + p["k"] - 1)["end"]
            own = F.array_join(F.transform(F.slice(toks, p["first"] + 1, p["k"]), lambda x: x["token"]), " ")
            part = F.substr(own, F.lit(1), (F.pmod(draw_at(key, "rep.part", p["first"]), F.lit(2)) + 1).cast("int"))
            new = F.when(p["form"] == "stutter", F.concat(part, F.lit("-"), own)).when(p["form"] == "clause", F.concat(own, F.lit(", "), own)).otherwise(F.concat(own, F.lit(" "), own))
            done = F.concat(F.substr(t["text"], F.lit(1), start), new, F.substr(t["text"], end + 1))
            return F.struct(done.alias("text"), F.concat(t["edits"], F.array(F.struct(start.alias("at"), (F.length(new) - (end - start)).alias("more")))).alias("edits"))

        return F.aggregate(F.reverse(F.array_sort(got)), unedited(text), say)

    def run(toks: Column, spans: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.size(toks) - 1), lambda x: T.let(F.get(toks, x), lambda t: _said(t["token"]) & ~F.exists(spans, lambda s: (t["start"] < s["end"]) & (t["end"] > s["start"]))))
        return F.when(F.size(toks) > 0, T.let(free, lambda free: T.let(picks(toks, free), lambda got: rebuilt(toks, got)))).otherwise(unedited(text))

    return T.let(tokens(text) if toks is None else toks, lambda toks: T.let(spans, lambda spans: run(toks, spans)))
