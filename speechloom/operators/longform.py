"""Long spoken texts: an opener, sentences joined by connectives, a closer, within a budget of words.

Every sentence is a template with clauses that its domain allows, filled as a plan of its own. All sentences that a text may need are made at once; a fold over
them, in order, takes a sentence while the text has too few sentences or words, and passes over one that would break the upper bound. Connectives come in
the order of their hashes, so none is used twice. A text whose sentences do not come to its lower bound is null, to be planned anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import bank, templates
from .pools import Pools

#: Words of a text, sentences at least, clauses of a sentence (and perhaps one more).
BOUNDS = {"easy": (55, 80), "medium": (90, 145), "hard": (155, 290)}
SENTENCES = {"easy": 2, "medium": 3, "hard": 4}
CLAUSES = {"easy": 1, "medium": 2, "hard": 3}
#: Sentences and clauses have so many words at least; a bank with shorter ones needs smaller numbers here. Sentences made beyond those that may be needed.
SHORTEST, SHORTEST_CLAUSE, SPARE = 5, 5, 3


def most(level: str) -> int:
    """Sentences made for a text: as many of the shortest as reach its lower bound, and some to pass over."""
    return max(SENTENCES[level], -(-BOUNDS[level][0] // (SHORTEST + CLAUSES[level] * SHORTEST_CLAUSE))) + SPARE


def _by_level(level: Column, values: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), level)


def in_hash_order(values: Column, key: Column, site: str) -> Column:
    """The values of an array in the order of md5(seed:key:site:value)."""
    return F.transform(F.array_sort(F.transform(values, lambda v: F.struct(F.md5(F.concat_ws(":", F.lit("42"), key, F.lit(site), v)).alias("h"), v.alias("v")))), lambda x: x["v"])


def clauses(domain: Column, clause_bank: tuple = bank.CLAUSES) -> Column:
    """The clauses that a domain allows."""
    held = F.array(*[F.struct(F.lit(t).alias("t"), (F.array(*map(F.lit, ds)) if ds else F.expr("cast(array() as array<string>)")).alias("ds")) for t, ds in clause_bank])
    return F.transform(F.filter(held, lambda c: (F.size(c["ds"]) == 0) | F.array_contains(c["ds"], domain)), lambda c: c["t"])


def sentences(plans: DataFrame, template_table: DataFrame, pools: Pools) -> DataFrame:
    """plans (key, domain, level) with said: all sentences that each may need, in order. Null where the domain has no template."""
    each = F.explode(F.sequence(F.lit(0), _by_level(F.col("level"), {k: most(k) for k in BOUNDS}) - 1)).alias("unit")
    u = plans.select(F.col("key").alias("parent"), "domain", "level", each)
    u = u.withColumn("key", F.concat("parent", F.lit(":u"), F.col("unit"))).withColumn("required", F.expr("cast(array() as array<string>)"))
    u = templates.choose(u, template_table)
    n = _by_level(F.col("level"), CLAUSES) + F.pmod(T.draw(F.col("key"), "clauses"), F.lit(2)).cast("int")
    added = F.array_join(F.transform(F.slice(in_hash_order(clauses(F.col("domain")), F.col("key"), "clause"), 1, n), lambda c: F.concat(F.lit(", "), c)), "")
    mark = F.regexp_extract("text", "[.?!]$", 0)  # clauses stand before the mark that ends the sentence
    u = u.withColumn("text", F.concat(F.regexp_replace("text", "[.?!]$", ""), added, mark)).withColumn("slots", templates.slots(F.col("text")))
    u = templates.fill(u.withColumn("repeat_same", F.lit(False)), pools)
    held = u.groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("unit", "clean"))).alias("said"))  # at most ``most`` of a plan
    return plans.join(held.select(F.col("parent").alias("key"), F.transform("said", lambda s: s["clean"]).alias("said")), "key")


def gathered(said: Column, key: Column, least: Column, lo: Column, hi: Column, closer: Column) -> Column:
    """struct<parts: array<struct<text, connective>>, words>: the sentences taken, with their opener or connective, and all words with the closer's."""
    opener = T.pick(key, "opener", bank.OPENERS)
    comma = F.create_map(*[F.lit(x) for c, mark in bank.CONNECTIVES for x in (c, "," if mark else "")])
    state = F.struct(F.expr("cast(array() as array<struct<text:string,connective:string>>)").alias("parts"), F.size(T.words(closer)).alias("words"))

    def part(s: Column, i: Column, order: Column) -> Column:
        c = F.get(order, i - 1)
        text = F.when(i == 0, F.concat(opener, F.lit(" "), T.lower_first(s))).otherwise(F.concat(T.upper_first(c), F.element_at(comma, c), F.lit(" "), T.lower_first(s)))
        return F.struct(text.alias("text"), F.when(i > 0, c).alias("connective"))

    def step(a: Column, s: Column, order: Column) -> Column:
        more = (F.size(a["parts"]) < least) | (a["words"] < lo)
        taken = lambda x: F.struct(F.concat(a["parts"], F.array(x)).alias("parts"), (a["words"] + F.size(T.words(x["text"]))).alias("words"))
        return F.when(s.isNull() | ~more, a).otherwise(T.let(taken(part(s, F.size(a["parts"]), order)), lambda t: F.when(t["words"] <= hi, t).otherwise(a)))

    order = in_hash_order(F.array(*[F.lit(c) for c, _ in bank.CONNECTIVES]), key, "connective")
    return T.let(order, lambda order: F.aggregate(said, state, lambda a, s: step(a, s, order)))


def compose(plans: DataFrame, template_table: DataFrame, pools: Pools, bounds: dict | None = None) -> DataFrame:
    """plans (key, domain, level: easy, medium or hard; keys unique) with clean and units: array<struct<text, start, end, connective>>, of which each text is clean[start, end)."""
    bounds = bounds or BOUNDS
    lo, hi = (_by_level(F.col("level"), {k: b[i] for k, b in bounds.items()}) for i in (0, 1))
    least, closer = _by_level(F.col("level"), SENTENCES), T.pick(F.col("key"), "closer", bank.CLOSERS)
    p = sentences(plans, template_table, pools).withColumn("__g", T.once(gathered(F.col("said"), F.col("key"), least, lo, hi, closer))).drop("said")
    parts = F.concat(T.part("__g", "parts"), F.array(F.struct(closer.alias("text"), F.lit(None).cast("string").alias("connective"))))
    none = F.expr("cast(array() as array<struct<text:string,start:int,end:int,connective:string>>)")
    end = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1)["end"] + 1, F.lit(0))
    unit = lambda acc, x: F.struct(x["text"].alias("text"), end(acc).alias("start"), (end(acc) + F.length(x["text"])).alias("end"), x["connective"].alias("connective"))
    whole = (T.part("__g", "words") >= lo) & (F.size(T.part("__g", "parts")) >= least)
    p = p.withColumn("units", F.when(whole, F.aggregate(parts, none, lambda acc, x: F.concat(acc, F.array(unit(acc, x))))))
    return p.withColumn("clean", F.array_join(F.transform("units", lambda u: u["text"]), " ")).drop("__g")
