"""Records for plans: the first candidate of each, then every other branch and attempt at once for those that it fails; the first that passes the gates is kept.

A plan with a real text first tries to say that text, then a template; others take a template, a long form or a formatting command. Every candidate has a key of its own,
so its draws are its own. Candidates are gated where they are made, and one aggregation by plan keeps the best; plans without any are gaps.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import CATEGORIES, COMBOS, TRANSFORMS
from ..operators import dedup, gates, longform, realize, templates
from ..operators import entities as E
from ..operators import values as V
from ..operators.bank import DOMAINS
from ..operators.pools import Pools, ranked
from ..sources.shared import cut
from .allocate import padded

ATTEMPTS = 2
VERSION = "20260101.2"
_NONE = "cast(array() as array<string>)"
_FORMAT = "struct<type:string,items:array<string>>"


def _attempts(plans: DataFrame, branch: int, name: str, attempts: int, first: bool | None) -> DataFrame:
    """Plans with attempts of a branch: plan, key and rank among all candidates of the plan. first: only those of the lowest rank that their plan has, or all others."""
    p = plans.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1)))).withColumnRenamed("key", "plan")
    p = p.withColumn("key", F.concat("plan", F.lit(f":{name}"), F.col("attempt"))).withColumn("rank", F.col("attempt") + branch * attempts).drop("attempt")
    lowest = F.col("rank") == F.when(F.col("text").isNotNull(), 0).otherwise(attempts)
    return p if first is None else p.where(lowest if first else ~lowest)


def candidates(plans: DataFrame, template_table: DataFrame, pools: Pools, attempts: int = ATTEMPTS, suffix: str = "", first: bool | None = None) -> DataFrame:
    """plans (of ``allocate``, with text where a real one is assigned) as candidates with clean, said, kept, template_id, format and the source they come from.

    Plans that are made again (with a suffix) get formatting commands in detail: there are too few plain ones for many plans. first: see ``_attempts``.
    """
    null = F.lit(None).cast("string")
    shaped = lambda d, clean, said, kept, tid, fmt, source: d.select(
        *[c for c in plans.columns if c not in ("key", "source", "text", "domain")], "plan", "key", "rank", F.when(F.lit(source == "real"), "everyday").otherwise(F.col("domain")).alias("domain"),
        clean.alias("clean"), said.alias("said"), kept.alias("kept"), tid.alias("template_id"), fmt.cast(_FORMAT).alias("format"), F.lit(source).alias("source"),
    )
    none, no_format = F.expr(_NONE), F.lit(None)
    real = _attempts(plans.where("text is not null"), 0, f"r{suffix}", attempts, first)
    real = shaped(real, F.col("text"), F.col("text"), none, null, no_format, "real")
    made = _attempts(plans.where("not longform and (preservation or not formatting)"), 1, f"t{suffix}", attempts, first).drop("text")
    made = made.withColumn("domain", F.when(F.col("preservation"), "preservation").otherwise(F.when(F.col("source") == "real", T.pick(F.col("key"), "domain", DOMAINS)).otherwise(F.col("domain"))))
    made = templates.fill(templates.choose(made.withColumn("required", none), template_table).withColumn("repeat_same", F.lit(False)), pools)
    made = shaped(made.where("clean is not null"), F.col("clean"), F.col("clean"), F.col("kept"), F.col("template_id"), no_format, "template")
    long = _attempts(plans.where("longform"), 1, f"l{suffix}", attempts, first).withColumn("level", F.col("difficulty"))
    long = longform.compose(long.drop("text"), template_table, pools).where("clean is not null")
    long = shaped(long, F.col("clean"), F.col("clean"), none, null, no_format, "template")
    told = _attempts(plans.where("formatting and not longform and not preservation"), 1, f"f{suffix}", attempts, first).withColumn("c", T.once(V.command(F.col("key"), detail=bool(suffix))))
    told = shaped(told, T.part("c", "output"), T.part("c", "input"), none, null, F.struct(T.part("c", "type").alias("type"), T.part("c", "items").alias("items")), "template")
    return reduce(DataFrame.unionByName, (made, long, told), real)


def issues() -> Column:
    """Codes of the gates that a candidate breaks, in order."""
    category, transforms, out = F.col("category"), F.col("transforms"), F.col("clean")
    structure = gates.structure_issues(category, F.array_distinct(transforms), F.size(F.array_distinct(transforms)), F.col("combo"), CATEGORIES, TRANSFORMS, COMBOS)
    low = lambda c: F.lower(c)
    wrong = F.exists("made", lambda c: (low(c["abandoned"]) == low(c["kept"])) | ~F.contains(low(F.col("input")), low(c["abandoned"])) | ~F.contains(low(out), low(c["kept"])) | F.contains(low(out), low(c["abandoned"])))
    own = F.col("format").isNotNull()
    checks = (
        ("structure", F.size(structure) > 0), ("unchanged", F.when(F.size(transforms) == 0, F.col("input") != out).otherwise(F.col("input") == out)),
        ("shape", ~own & (gates.shape_issue(out) | (F.size(T.words(F.col("input"))) < 3))), ("corrections", (F.size("made") != F.col("corrections")) | wrong),
        ("formatting", gates.formatting_issue(out, F.coalesce("format.type", F.lit("none")))), ("length", gates.length_issue(F.size(T.unicode_words(out)), category, F.col("identity"))), ("preservation", gates.preservation_issue(F.col("preservation"), F.col("kept"), out)),
    )
    return F.filter(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in checks]), lambda x: x.isNotNull())


def records(cands: DataFrame) -> DataFrame:
    """The best candidate of every plan as a record without an id; plans that have none are missing."""
    r = realize.realize(cands)
    row = F.struct(
        "key", "input", F.col("clean").alias("output"), "category", F.array_sort("transforms").alias("transformations"), F.size("transforms").alias("num_transformations"), "difficulty", "domain", E.inventory(F.col("clean_spans")).alias("entities"),
        F.col("made").alias("corrections"), F.col("restarts").alias("reformulations"), F.col("format").alias("formatting"), F.col("preservation").alias("preservation_case"), F.col("kept").alias("preserved"), "combo", "template_id", T.seed_of(F.col("key")).alias("seed"), F.lit(VERSION).alias("generator_version"), "bucket", "source",
    )
    # not a filter: it would be pushed below the changes, and all of them written out in it
    best = r.groupBy("plan").agg(F.min_by(row, F.when(F.size(issues()) == 0, F.col("rank"))).alias("r")).where("r is not null")
    return best.select("plan", "r.*")


def pair_key() -> Column:
    return F.sha2(F.concat_ws("\x1f", "input", "output"), 256)


def unique(rows: DataFrame) -> DataFrame:
    """The first record, by plan, of each pair of input and output; pairs travel as hashes."""
    first = rows.groupBy(pair_key().alias("__p")).agg(F.min("plan").alias("plan")).select("plan")
    return rows.join(first, "plan", "left_semi")


def finished(rows: DataFrame) -> DataFrame:
    """Records with ids by bucket and a split of every bucket."""
    r = ranked(rows, ["bucket"], "plan", "n").withColumn("id", F.concat(F.lit("v4_"), F.col("bucket"), F.lit("_"), padded(F.col("n")))).drop("n")
    return r.join(dedup.stratified_split(r, "bucket", "id").select("id", "split"), "id")


def signature() -> Column:
    """What near duplicates are looked for within: category, template and entities of a record."""
    values = F.flatten(F.array(*[F.col(f"entities.{k}s") for k in E.KINDS]))
    return F.concat_ws("\t", "category", F.coalesce("template_id", F.lit("")), F.array_join(F.array_sort(values), "|"))


def regenerate(made: DataFrame, remake: Callable[[DataFrame, str], DataFrame], rounds: int = 3) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Records of which none is near an earlier one of its signature, and (made again, without a new record, dropped at the end) of each round.

    The later one of a near pair is made again by remake (plans, suffix of their new keys). After the first round only pairs with a new record are looked for, among all. What is still near
    after the last round is dropped. Each round's records are kept in a checkpoint.
    """
    counts, changed = [], None
    texts, group = [F.col("input"), F.col("output")], signature()
    for k in range(rounds + 1):
        late = cut(dedup.near_later(made, "plan", texts, group=group, changed=changed).withColumnRenamed("id", "plan"))
        n = late.count()
        if n == 0:
            break
        kept = made.join(late, "plan", "left_anti")
        if k == rounds:
            made = cut(kept)
            counts.append((0, 0, n))
            break
        new = cut(remake(late, f"n{k}"))
        counts.append((n, n - new.count(), 0))
        made, changed = cut(kept.unionByName(new)), new.select(F.col("plan").alias("id"))
    return made, counts


def compile_records(plans: DataFrame, template_table: DataFrame, pools: Pools, holdout: DataFrame, attempts: int = ATTEMPTS, rounds: int = 3) -> DataFrame:
    """Records of all plans: none near another of its signature, none in the hold-out (output), none twice. Candidates and records are kept in checkpoints, since each is read more than once."""
    plans = cut(plans)
    make = lambda p, suffix, first=None: records(cut(candidates(p, template_table, pools, attempts, suffix, first)))
    soon = cut(make(plans, "", True))  # most plans pass by their first candidate: the others are made for the rest only
    made = cut(soon.unionByName(make(plans.join(soon.select(F.col("plan").alias("key")), "key", "left_anti"), "", False)))
    made, _ = regenerate(made, lambda late, suffix: make(plans.join(late.select(F.col("plan").alias("key")), "key", "left_semi"), suffix), rounds)
    return finished(cut(unique(dedup.holdout_guard(made, holdout, ["output"]))))
