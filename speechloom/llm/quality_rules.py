"""Line-first cleaning, in DataFrame functions only.

Punctuation, navigation and boilerplate rules are evaluated per line; failing lines are removed; a document that
loses too much of its text, or breaks a document rule on length or repetition, is rejected.

Boilerplate is known by fixed phrases; lines that only repeat over the corpus are not looked for.

Cases: null text counts as no words and is rejected; empty lines are neither kept nor counted as lost; a text of one very
long line is one line; ties do not arise; repeated rows are judged alike; an empty table gives no rows; other columns,
whatever their names, are carried in ``row`` by ``judge`` and play no part.

Windows are compared by their 64-bit hashes within one text (a chance collision among n windows has odds of n^2 / 2^65).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import SPACE_RE

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is rejected if its kept lines hold less than this share of its characters in words.
MIN_KEPT_SHARE = 0.5
#: Phrases of licence, cookie and copyright lines.
BOILERPLATE = (
    "licensed under", "all rights reserved", "copyright (c)", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "accept cookies", "enable javascript", "subscribe to our", "sign up for our newsletter", "spdx-license-identifier", "powered by",
)
#: A line of at most so many characters and words that does not end like a sentence is a menu's or a heading.
SHORT_CHARS, SHORT_WORDS = 40, 4
SENTENCE_END = "[.!?…:;。！？][\"'”»)\\]]*[ \\t-\\r]*$"
#: Only texts with one of these, or a phrase above, can hold a line that fails for more than having no letter.
SUSPECT = "[©|»›•!#*$%&<>]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body's lambdas use it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RE), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array."""

    def covered(spots: Column) -> Column:
        far = F.lit(-3).cast("long")
        start = F.struct(far.alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(spots, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3).cast("long"), p - acc["last"])).alias("n")))["n"]

    def spots(order: Column, key: Callable[[Column], Column], spot: Callable[[Column], Column]) -> Column:
        twice = F.filter(order, lambda x, i: F.coalesce(key(F.get(order, i + 1)) == key(x), F.lit(False)) | F.coalesce(key(F.get(order, i - 1)) == key(x), F.lit(False)))
        return F.sort_array(F.transform(twice, spot))

    def packed(hashes: Column) -> Column:
        """Hash and place in one long: 48 bits and 16, so that a plain sort of longs brings equals together."""
        low = F.lit(0xFFFF).cast("long")
        longs = F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))
        return let(F.sort_array(longs), lambda o: covered(spots(o, lambda x: F.get(hashes, x.bitwiseAND(low).cast("int")), lambda x: x.bitwiseAND(low))))

    def paired(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("p")))
        return let(F.sort_array(pairs), lambda o: covered(spots(o, lambda x: x["h"], lambda x: x["p"])))

    def count(hashes: Column) -> Column:
        none = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(none, F.lit(0).cast("long")).when(F.size(hashes) <= 65536, packed(hashes)).otherwise(paired(hashes))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(let(hashed, windows), count))


def boilerplate(text: Column) -> Column:
    def any_of(low: Column) -> Column:
        hit = F.contains(low, F.lit(BOILERPLATE[0]))
        for phrase in BOILERPLATE[1:]:
            hit = hit | F.contains(low, F.lit(phrase))
        return hit

    return let(F.lower(text), any_of)


def no_sentence(line: Column) -> Column:
    """Whether a line is short and does not end like a sentence."""
    few = line.rlike(f"^[ \\t-\\r]*+(?:[^ \\t-\\r]++[ \\t-\\r]*+){{1,{SHORT_WORDS}}}+$")
    return (F.length(line) <= SHORT_CHARS) & few & ~line.rlike(SENTENCE_END)


def line_fails(line: Column) -> Column:
    """Whether a line with words breaks a rule on signs or phrases: menu, boilerplate, symbols, shouting."""
    tight = F.regexp_replace(line, SPACE_RE, "")
    chars = F.length(tight)
    symbols = chars - F.length(F.regexp_replace(tight, SYMBOLS, ""))
    bars = F.length(line) - F.length(F.translate(line, "|»›•", ""))
    shouts = F.length(line) - F.length(F.translate(line, "!", ""))
    n = F.size(words_of(line))
    # one bar for every four words, from two bars on; symbols above a tenth of the characters; an exclamation mark for every word
    return boilerplate(line) | line.contains("©") | ((bars >= 2) & (bars * 4 >= n)) | ((chars >= 10) & (symbols * 10 > chars)) | ((n >= 5) & (shouts >= n))


def judge(docs: DataFrame) -> DataFrame:
    """row (the document as a struct), doc_id, the counts, base_failed, clean_text (its passing lines) and kept."""
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("suspect", F.col("text").rlike(SUSPECT) | boilerplate(F.col("text")))
    d = d.withColumn("words", words_of(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]")))
    d = d.select(
        "row",
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.array_join(F.filter(F.when(F.col("suspect"), F.filter("lines", lambda x: ~line_fails(x))).otherwise(F.col("lines")), lambda x: x.rlike("\\pL") & ~no_sentence(x)), "\n").alias("clean_text"),
    )
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    left = F.length(F.regexp_replace("clean_text", SPACE_RE, ""))
    return d.withColumn("kept", ~F.col("base_failed") & (left >= MIN_KEPT_SHARE * F.col("word_chars")))


def clean(docs: DataFrame) -> DataFrame:
    """The documents kept, in the columns of docs; text (and n_chars, if there) holds the passing lines only."""
    d = judge(docs).where("kept")
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return d.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
