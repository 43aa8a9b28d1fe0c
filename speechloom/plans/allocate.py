"""Plans for records by quota: every row of a table becomes a plan with a bucket, transforms, combination, domain and difficulty.

Quotas are cumulative segments, a few dozen whatever the number of plans. A plan's place in the order of all rows falls into one segment; its place there
decides what the segment takes in turn, and draws by its key decide what is weighted. Nothing is joined, and no task holds all plans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import COMBOS
from ..operators.bank import DOMAINS
from ..operators.pools import ranked
from .quota import REAL, quotas

#: Shares of categories, and the weights in 100 of easy, medium and hard plans.
CATEGORY_SHARES = (("basic", 0.15), ("filler", 0.10), ("repetition", 0.10), ("correction", 0.20), ("reformulation", 0.10), ("formatting", 0.05), ("long", 0.15), ("mixed", 0.15))
LEVELS = ("easy", "medium", "hard")
CATEGORY_LEVELS = {"basic": (60, 30, 10), "filler": (55, 30, 15), "repetition": (45, 35, 20), "correction": (30, 45, 25), "reformulation": (45, 35, 20), "formatting": (60, 30, 10), "long": (25, 45, 30), "mixed": (20, 40, 40)}
BUCKET_LEVELS = {"noop": (55, 30, 15), "simple": (50, 35, 15), "correction": (30, 45, 25), "compositional": (20, 40, 40), "formatting": (100, 0, 0)}
BUCKET_COMBOS = (("filler+rep", 30), ("filler+corr", 30), ("rep+corr", 25), ("filler+rep+corr", 15))
IDENTITY, PRESERVED = 0.15, 0.10
#: What the parts of a combination's name stand for.
PARTS = {"filler": "filler", "rep": "repetition", "corr": "self_correction", "reform": "reformulation", "fmt": "formatting"}


def combo_transforms(combo: str) -> tuple[str, ...]:
    return ("self_correction", "self_correction") if combo == "multi-corr" else tuple(PARTS[p] for p in combo.split("+") if p != "long")


@dataclass(frozen=True)
class Segment:
    """n plans in a row: ``turns`` are their kinds and transforms in turn, or by weight if there are ``weights``."""

    bucket: str
    category: str
    n: int
    turns: tuple[tuple[str, tuple[str, ...]], ...]
    levels: tuple[int, int, int]
    weights: tuple[int, ...] = ()
    combo: bool = False
    identity: bool = False
    preservation: bool = False
    longform: bool = False
    real: int = 0


def even_matrix(n: int) -> dict[str, int]:
    """n mixed plans over all combinations; the first ones take what is left."""
    return {c: n // len(COMBOS) + (i < n % len(COMBOS)) for i, c in enumerate(COMBOS)}


def by_category(total: int, matrix: dict[str, int] | None = None) -> list[Segment]:
    """Segments of the categories in order, each with its sub-quotas, and one for each combination."""
    if abs(sum(p for _, p in CATEGORY_SHARES) - 1) > 1e-9:
        raise ValueError("shares must sum to 1")
    n = {c: round(total * p) for c, p in CATEGORY_SHARES}
    n["mixed"] += total - sum(n.values())
    matrix = even_matrix(n["mixed"]) if matrix is None else matrix
    if sum(matrix.values()) != n["mixed"]:
        raise ValueError(f"the matrix sums to {sum(matrix.values())}, the quota of mixed plans is {n['mixed']}")
    filler, repetition, easy = ("filler", ("filler",)), ("repetition", ("repetition",)), (100, 0, 0)
    same = round(n["basic"] * IDENTITY)
    out = [Segment("basic", "basic", same, (("noop", ()),), CATEGORY_LEVELS["basic"], identity=True), Segment("basic", "basic", n["basic"] - same, (filler, filler, repetition), easy), Segment("filler", "filler", n["filler"], (filler,), CATEGORY_LEVELS["filler"])]
    for c, transform in (("repetition", "repetition"), ("correction", "self_correction"), ("reformulation", "reformulation")):
        own = round(n[c] * (1 - PRESERVED))
        out += [Segment(c, c, own, ((transform, (transform,)),), CATEGORY_LEVELS[c]), Segment(c, c, n[c] - own, (filler,), easy, preservation=True)]
    out.append(Segment("formatting", "formatting", n["formatting"], (("formatting", ("formatting",)),), CATEGORY_LEVELS["formatting"]))
    out.append(Segment("long", "long", n["long"], (filler, filler, ("filler+repetition", ("filler", "repetition"))), CATEGORY_LEVELS["long"], longform=True))
    return out + [Segment("mixed", "mixed", k, ((c, combo_transforms(c)),), CATEGORY_LEVELS["mixed"], combo=True, longform=c.endswith("+long")) for c, k in matrix.items()]


def by_bucket(total: int) -> list[Segment]:
    """Segments of the five buckets; the first ``real`` plans of each take real text."""
    n = {b: last - first for b, first, last in quotas(total)}
    kinds = lambda *names: tuple((k, (k,)) for k in names)
    turns = {"noop": (("noop", ()),), "simple": kinds("filler", "repetition"), "correction": kinds("self_correction", "reformulation"), "compositional": tuple((c, combo_transforms(c)) for c, _ in BUCKET_COMBOS), "formatting": kinds("formatting")}
    category = {"noop": "basic", "simple": "", "correction": "", "compositional": "mixed", "formatting": "formatting"}  # none: the kind's own
    weights = {"compositional": tuple(w for _, w in BUCKET_COMBOS)}
    return [
        Segment(b, category[b], k, turns[b], BUCKET_LEVELS[b], weights.get(b, ()), combo=b == "compositional", identity=b == "noop", real=0 if b == "formatting" else int(k * REAL))
        for b, k in n.items()
    ]


def weighted(key: Column, site: str, weights: Column) -> Column:
    """The place of a draw among weights that sum to 100."""
    u = F.pmod(T.draw(key, site), F.lit(100))
    upto = F.transform(weights, lambda w, i: F.aggregate(F.slice(weights, 1, i + 1), F.lit(0), lambda a, x: a + x))
    return F.size(F.filter(upto, lambda x: x <= u))


def padded(n: Column) -> Column:
    """A number in six digits, or as many as it has: lpad cuts longer ones, so that 123,456 and 1,234,567 would be one."""
    s = n.cast("string")
    return F.lpad(s, F.greatest(F.lit(6), F.length(s)), F.lit("0"))


def plan_key(i: Column, seed: int = 42) -> Column:
    """The key of ``assign`` for the first million plans, and one of its own for every other."""
    return F.concat(F.lit(f"plan:{seed}:"), padded(i))


def assign(rows: DataFrame, segments: list[Segment], seed: int = 42) -> DataFrame:
    """rows (i: 0 .. total - 1, other columns) with key and what a plan holds. As in SQL, a key has six digits: beyond a million plans several share one (``plan_key`` names each)."""
    segments = [s for s in segments if s.n > 0]
    ends = [sum(s.n for s in segments[: k + 1]) for k in range(len(segments))]
    turn = lambda kind, ts: F.struct(F.lit(kind).alias("kind"), (F.array(*map(F.lit, ts)) if ts else F.expr("cast(array() as array<string>)")).alias("transforms"))
    row = lambda s, end: F.struct(
        F.lit(s.bucket).alias("bucket"), F.lit(s.category).alias("category"), F.lit(end - s.n).cast("long").alias("first"), F.lit(s.n).cast("long").alias("n"), F.array(*[turn(*t) for t in s.turns]).alias("turns"), F.array(*map(F.lit, s.levels)).alias("levels"),
        (F.array(*map(F.lit, s.weights)) if s.weights else F.expr("cast(array() as array<int>)")).alias("weights"), F.lit(s.combo).alias("combo"), F.lit(s.identity).alias("identity"), F.lit(s.preservation).alias("preservation"), F.lit(s.longform).alias("longform"), F.lit(s.real).cast("long").alias("real"),
    )
    held = F.array(*[row(s, end) for s, end in zip(segments, ends, strict=True)])
    at = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("i")))
    d = rows.withColumn("__s", F.get(held, at)).withColumn("key", F.concat(F.lit(f"plan:{seed}:"), F.lpad(F.col("i").cast("string"), 6, "0")))
    s, key = F.col("__s"), F.col("key")
    place = F.col("i") - s["first"]
    chosen = F.when(F.size(s["weights"]) > 0, weighted(key, "combo", s["weights"])).otherwise((place % F.size(s["turns"])).cast("int"))
    d = d.withColumn("__t", F.get(s["turns"], chosen)).withColumn("source", F.when(place < s["real"], "real").otherwise("template"))
    kind = F.col("__t.kind")
    flags = [s[c].alias(c) for c in ("identity", "preservation", "longform")]
    return d.select(
        *rows.columns, "key", s["bucket"].alias("bucket"), F.when(s["category"] == "", F.when(kind == "self_correction", "correction").otherwise(kind)).otherwise(s["category"]).alias("category"), kind.alias("kind"), F.col("__t.transforms").alias("transforms"),
        F.when(s["combo"], kind).alias("combo"), F.get(F.array(*map(F.lit, DOMAINS)), (F.col("i") % len(DOMAINS)).cast("int")).alias("domain"), F.get(F.array(*map(F.lit, LEVELS)), weighted(key, "level", s["levels"])).alias("difficulty"), *flags,
        F.array_contains("__t.transforms", "formatting").alias("formatting"), F.when(kind == "multi-corr", 2).otherwise(F.when(F.array_contains("__t.transforms", "self_correction"), 1).otherwise(0)).alias("corrections"), "source", place.alias("place"),
    )


def numbered(rows: DataFrame, id_col: str) -> DataFrame:
    """rows with i, their place in the order of their ids' hashes; ids are unique."""
    return ranked(rows.withColumn("__all", F.lit(0)), ["__all"], id_col, "i").drop("__all")
