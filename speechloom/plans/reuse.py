"""Real texts for plans: each text serves a few plans, and one identity plan, by exact ranks on both sides.

A slot is one use of a text. Plans that need a text with a value (corrections) take eligible slots in rank order first; the others take what is left. Ranks come from
counts of hash ranges, so any number of plans and texts is spread over tasks, and plans meet slots in a join by rank with one row on each side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.pools import ranked

#: Words of a text for an identity plan and for others, uses of a text.
IDENTITY_WORDS, WORDS, USES = 30, 60, 3


def _slots(texts: DataFrame, uses: int) -> DataFrame:
    return texts.select("text_id", "words", "kinds", F.explode(F.sequence(F.lit(0), F.lit(uses - 1))).alias("use_no")).withColumn("__slot", F.concat_ws(":", "use_no", "text_id"))


def _in_order(slots: DataFrame, where: Column) -> DataFrame:
    """Slots with rank: all first uses in hash order, then all second ones."""
    held = ranked(slots.where(where), ["use_no"], "__slot", "__r")
    n = held.groupBy("use_no").agg(F.count("*").alias("__n"))  # a row a use
    before = n.alias("a").join(n.alias("b"), F.col("b.use_no") < F.col("a.use_no"), "left").groupBy("a.use_no").agg(F.coalesce(F.sum("b.__n"), F.lit(0)).alias("__before"))
    return held.join(F.broadcast(before), "use_no").withColumn("rank", F.col("__r") + F.col("__before")).drop("__r", "__before")


def match(plans: DataFrame, texts: DataFrame, uses: int = USES, words: int = WORDS, identity_words: int = IDENTITY_WORDS, order: str = "key") -> DataFrame:
    """plans (key, identity, needs_value, other columns; keys unique), ranked by the hash of order, then key, with text_id and use_no of texts (text_id, words, kinds; ids unique); null where no slot is left."""
    key = lambda where, name: ranked(plans.where(where).select("key", F.col(order).alias("__order"), F.lit(0).alias("__all")), ["__all"], "__order", "rank", ["key"]).select("key", "rank")
    same = key(F.col("identity"), "i").join(ranked(texts.where(F.col("words") <= identity_words).withColumn("__all", F.lit(0)), ["__all"], "text_id", "rank").select("text_id", F.lit(0).alias("use_no"), "rank"), "rank")
    slots = _slots(texts.where(F.col("words") <= words), uses)
    with_value = _in_order(slots, F.col("kinds") > 0).select("__slot", "text_id", "use_no", "rank")
    first = key(~F.col("identity") & F.col("needs_value"), "v").join(with_value, "rank")
    left = slots.join(first.select("__slot"), "__slot", "left_anti")
    rest = key(~F.col("identity") & ~F.col("needs_value"), "o").join(_in_order(left, F.lit(True)).select("__slot", "text_id", "use_no", "rank"), "rank")
    taken = same.select("key", "text_id", "use_no").union(first.select("key", "text_id", "use_no")).union(rest.select("key", "text_id", "use_no"))
    return plans.join(taken, "key", "left")


def usage(matched: DataFrame, texts: DataFrame, uses: int = USES, words: int = WORDS, identity_words: int = IDENTITY_WORDS) -> DataFrame:
    """For identity plans and others: plans, those with a text, slots that are eligible and slots that stay unused."""
    plans = matched.groupBy("identity").agg(F.count("*").alias("plans"), F.count("text_id").alias("matched"))
    n = texts.agg(F.count(F.when(F.col("words") <= identity_words, 1)).alias("same"), (uses * F.count(F.when(F.col("words") <= words, 1))).alias("other"))
    slots = n.select(F.explode(F.array(F.struct(F.lit(True).alias("identity"), F.col("same").alias("slots")), F.struct(F.lit(False).alias("identity"), F.col("other").alias("slots")))).alias("x")).select("x.*")
    d = slots.join(plans, "identity", "left").na.fill(0, ["plans", "matched"])
    return d.select("identity", "plans", "matched", "slots", (F.col("slots") - F.col("matched")).alias("unused"))
