"""Duplicates, hold-out guard, splits, samples and identifiers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import stored

NEAR = 0.85


def exact_duplicates(df: DataFrame, keys: list[str], order: list[str], id_col: str) -> DataFrame:
    """Rows whose keys occurred before, with the id that came right before them."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.select(F.col(id_col), F.row_number().over(w).alias("rn"), F.lag(id_col).over(w).alias("duplicate_of")).where("rn > 1").drop("rn")


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _stir(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class _Codes(dict):
    """64-bit codes of words."""

    def __missing__(self, word: str) -> int:
        code = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return code


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n, digest, g: the hashes of each row's distinct 3-word shingles, ascending, their number and digest, from rows (id, lower-cased texts, group)."""
    codes = _Codes()
    for b in batches:
        at, digests, sets = [], [], []
        for i, (texts, group) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
            if len(codes) > 300_000:
                codes.clear()
            parts = []
            for w in ([w for w in (t or "").split(" ") if w] for t in texts):
                if len(w) >= 3:
                    c = np.fromiter(map(codes.__getitem__, w), np.uint64, len(w))
                    start = _STEP if group is None else np.uint64(codes[group] ^ int(_STEP))
                    parts.append(_stir(_stir(_stir(c[:-2] + start) ^ c[1:-1]) + _STEP ^ c[2:]))
            if parts:
                g = np.unique(np.concatenate(parts).view(np.int64))
                at.append(i)
                digests.append(hashlib.blake2b(g.tobytes(), digest_size=16).digest())
                sets.append(g)
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
        yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), pa.array(size), pa.array(digests, pa.binary()), lists], names=["id", "n", "digest", "g"])


def near_classes(df: DataFrame, id_col: str, text: Column | list[Column], least: float = NEAR, group: Column | None = None, changed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """members (id, class, n shingles) and near (u < v, shared, jaccard): the pairs of classes of at least ``least``.

    Rows of equal shingles form a class, named by its smallest id. Shingles are 64-bit hashes, sets 128-bit digests, computed once and stored.
    Of two classes of that Jaccard index, with p(n) = n - ceil(least * n) + 1, the first 2 p - 1 shingles of each by hash have p of the smaller in common: a class
    of which fewer are held by another class is dropped before anything more is shuffled. The rest share one of the rarest p of each, in one order of all
    shingles (by holders, then hash), so only these are joined; a pair that cannot come to ``least`` by the places of its last common one is not compared.
    Several texts of a row give the union of their shingles. With a group, shingles are hashed with it, so rows of different groups share none.
    With changed (id), only pairs with a class that holds one of these are looked for.
    """
    texts = text if isinstance(text, list) else [text]
    rows = df.select(F.col(id_col).alias("id"), F.array(*[F.lower(t) for t in texts]).alias("t"), (F.lit(None) if group is None else group).cast("string").alias("p"))
    rows = stored(rows.mapInArrow(_hashed, f"id {rows.schema['id'].dataType.simpleString()}, n long, digest binary, g array<long>"))
    names = stored(rows.groupBy("digest").agg(F.min("id").alias("class")))
    members = rows.select("id", "digest", "n").join(names.hint("merge"), "digest").select("id", "class", "n")
    prefix_of = lambda n: n - F.ceil(F.lit(least) * n - 1e-6) + 1
    head = F.explode(F.slice("g", F.lit(1), F.least(F.col("n"), 2 * prefix_of(F.col("n")) - 1).cast("int"))).alias("s")
    heads = rows.select("id", "n", F.xxhash64("digest").alias("d"), head)
    common = heads.groupBy("s").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi").select("s")
    need = prefix_of(F.ceil(F.lit(least) * F.col("n") - 1e-6))  # what the smallest class that may be near has in common at least
    able = heads.join(common.hint("merge"), "s", "left_semi").groupBy("id", "n").agg(F.count("*").alias("c")).where(F.col("c") >= need).select(F.col("id").alias("class"))
    able = able.join(names.select("class").hint("merge"), "class", "left_semi")
    sets = stored(rows.select(F.col("id").alias("class"), "n", "g").join(able.hint("merge"), "class", "left_semi"))
    keyed = sets.select("class", "n", F.explode("g").alias("s"))
    held = keyed.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    own = W.partitionBy("class")
    ranked = keyed.join(held.hint("merge"), "s").withColumn("m", F.count("*").over(own)).withColumn("k", F.col("n") - F.col("m") + F.row_number().over(own.orderBy("df", "s")))  # no other class holds the first n - m
    prefix = stored(ranked.where((F.col("m") >= F.lit(least) * F.col("n") - 1e-6) & (F.col("k") <= prefix_of(F.col("n")))).select("s", "class", "n", "k"))
    x, y = (prefix.select("s", F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("k").alias(f"k{c}")) for c in "uv")
    met = F.col("u") < F.col("v")
    if changed is not None:
        new = members.join(changed.select(F.col("id")), "id", "left_semi").select(F.col("class").alias("u"))
        x, met = x.join(new, "u", "left_semi"), F.col("u") != F.col("v")
    pairs = x.join(y.hint("merge"), "s").where(met & (F.least("nu", "nv") >= F.lit(least) * F.greatest("nu", "nv") - 1e-6))
    most = F.count("*") + F.least(F.first("nu") - F.max("ku"), F.first("nv") - F.max("kv"))  # those met, and all after the last of them
    pairs = pairs.groupBy("u", "v").agg((most >= F.lit(least / (1 + least)) * (F.first("nu") + F.first("nv")) - 1e-6).alias("may")).where("may")
    candidates = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    arrays = sets.select("class", "g")
    both = candidates.join(arrays.select(F.col("class").alias("u"), F.col("g").alias("hu")).hint("merge"), "u").join(arrays.select(F.col("class").alias("v"), F.col("g").alias("hv")).hint("merge"), "v")
    shared = F.size(F.array_intersect("hu", "hv"))
    both = both.select("u", "v", T.let(shared, lambda c: F.struct(c.alias("shared"), (c / (F.size("hu") + F.size("hv") - c)).alias("jaccard"))).alias("o"))
    return members, stored(both.select("u", "v", "o.*").where(F.col("jaccard") >= least))


def near_pairs(df: DataFrame, id_col: str, text: Column | list[Column], least: float = NEAR, group: Column | None = None) -> DataFrame:
    """a < b, shared, jaccard of 3-word shingles: all pairs of at least ``least``, from pairs of classes (``near_classes``)."""
    members, near = near_classes(df, id_col, text, least, group)
    p, q = members.select(F.col("id").alias("p"), F.col("class").alias("u"), "n"), members.select(F.col("id").alias("q"), F.col("class").alias("v"))
    across = near.join(p.drop("n"), "u").join(q, "v").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "shared", "jaccard")
    within = p.join(q, F.col("u") == F.col("v")).where("p < q").select(F.col("p").alias("a"), F.col("q").alias("b"), F.col("n").alias("shared"), F.lit(1.0).alias("jaccard"))
    return across.union(within)


def near_links(df: DataFrame, id_col: str, text: Column | list[Column], least: float = NEAR, group: Column | None = None) -> DataFrame:
    """a < b, shared, jaccard: all near pairs of classes, by their smallest ids, and each other member of a class with its smallest id. Rows do not grow with the square of copies."""
    members, near = near_classes(df, id_col, text, least, group)
    copies = members.where("id <> class").select(F.col("class").alias("a"), F.col("id").alias("b"), F.col("n").alias("shared"), F.lit(1.0).alias("jaccard"))
    return near.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("shared").cast("long").alias("shared"), "jaccard").union(copies)


def near_offenders(df: DataFrame, id_col: str, text: Column | list[Column], least: float = NEAR, group: Column | None = None) -> DataFrame:
    """id of every row that has a near one: members of a class of two or more, or of one with a near class. No pair of rows is made."""
    members, near = near_classes(df, id_col, text, least, group)
    full = members.groupBy("class").agg(F.count("*").alias("c")).where("c > 1").select("class")
    return members.join(full.union(near.select(F.explode(F.array("u", "v")))).distinct(), "class", "left_semi").select("id")


def near_later(df: DataFrame, id_col: str, text: Column | list[Column], least: float = NEAR, group: Column | None = None, changed: DataFrame | None = None) -> DataFrame:
    """id of every row that has a near one with a smaller id; what is left without them has no near pair. No pair of rows is made."""
    members, near = near_classes(df, id_col, text, least, group, changed)
    first = near.groupBy(F.col("v").alias("class")).agg(F.min("u").alias("other"))  # a class is named by its smallest id
    return members.join(first, "class", "left").where((F.col("id") != F.col("class")) | F.col("other").isNotNull()).select("id")


def offenders(pairs: DataFrame) -> DataFrame:
    """Both ends of every pair, once."""
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def holdout_guard(rows: DataFrame, holdout: DataFrame, on: list[str]) -> DataFrame:
    """Rows that are not in the hold-out."""
    return rows.join(holdout.select(*on).distinct(), on, "left_anti")


def stratified_split(df: DataFrame, stratum: str, id_col: str, test: float = 0.05, val: float = 0.10, seed: int = 42) -> DataFrame:
    """split by rank of md5(seed:id) in its stratum; sizes are rounded half to even, at least one row for the test.

    Rows are ranked within 65,536 ranges of the hash, shifted by the counts of the ranges before, so no task holds a stratum.
    """
    d = df.select(id_col, stratum, F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))).alias("__h")).withColumn("__b", F.substring("__h", 1, 4))
    s = W.partitionBy("__s")
    counts = d.groupBy(F.col(stratum).alias("__s"), F.col("__b").alias("__k")).agg(F.count("*").alias("c"))
    places = counts.select("__s", "__k", F.coalesce(F.sum("c").over(s.orderBy("__k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"), F.sum("c").over(s).alias("__n"))
    ranked = d.join(places, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__k")))
    rank = F.row_number().over(W.partitionBy(stratum, "__b").orderBy("__h", id_col)) + F.col("__start")
    n_test = F.greatest(F.lit(1.0), F.bround(F.lit(test) * F.col("__n"), 0))
    n_val = F.bround(F.lit(val) * F.col("__n"), 0)
    return ranked.select(id_col, stratum, F.when(rank <= n_test, "test").when(rank <= n_test + n_val, "validation").otherwise("train").alias("split"))


def hash_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).limit(n)


def dense_ids(df: DataFrame, by: str, order: list[str], prefix: str) -> DataFrame:
    """Ids numbered from 0 in the order (by, order): counts per value of ``by`` shift the ranks within it, so no task holds all rows."""
    counts = df.groupBy(by).agg(F.count("*").alias("c"))
    start = counts.select(by, F.coalesce(F.sum("c").over(W.orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    ranked = df.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(*order))).join(start, by)
    n = (F.col("start") + F.col("r") - 1).cast("long")
    return ranked.withColumn("n", n).withColumn("id", F.concat(F.lit(prefix), F.lpad(n.cast("string"), 6, "0"))).drop("r", "start")
