"""SimHash near-duplicates: fingerprints by 3-word shingles, links found through shared blocks.

Cases: null or wordless text has fingerprint zero and is linked like any other; null doc_id rows get a
fingerprint but never name a component unless all of its rows are null; repeated rows stay repeated (``dedup`` keeps one,
whether rows repeat, lack a doc_id or share one with other texts); ties of a bit's votes give 0; very long texts are read whole, their shingles summed in parts; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .storage import Table, release, with_groups, with_rows, written

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Blocks of 16 bits. Two prints that differ in at most two bits agree in at least two of four blocks.
BLOCKS = 4
#: A bucket of blocks with more prints than this is linked by neighbour keys instead of pair by pair.
PAIRWISE = 24


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    spans = zip(starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        part = hashes[i : i + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        kept = [n for n in b.schema.names if n != "text"]
        yield pa.record_batch([*(b.column(n) for n in kept), pa.array(fps)], names=[*kept, "fp"])


def _digest(docs: DataFrame) -> Column:
    """The 16 bytes by which ``dedup`` knows a text; a null one is empty, as its fingerprint is."""
    return F.unhex(F.md5(F.coalesce(docs["text"].cast("string"), F.lit(""))))


def fingerprints(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row; with the digest of its text between them if asked."""
    more = [_digest(docs).alias("digest")] if digest else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_prints, "doc_id long, digest binary, fp long" if digest else "doc_id long, fp long")


def links(spark: SparkSession, fps: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct prints that differ in at most two bits; their components are those of all such pairs.

    Small buckets compare pairs. In a larger one each print emits itself and its 64 one-bit neighbours: two
    prints differ in at most two bits exactly if they share such a key, so the holders of a key are linked
    to the smallest of them. Both ways are exact; rows grow with the prints, not with their square. No table that grows with them is broadcast, since that would pass the driver.
    """
    keys = []
    for i in range(BLOCKS):
        for j in range(i + 1, BLOCKS):
            mask = (0xFFFF << (16 * i)) | (0xFFFF << (16 * j))
            keys.append(F.struct(F.lit(4 * i + j).alias("c"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")).alias("k")))
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("b")).select("fp", "b.c", "b.k")
    sizes = keyed.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    crowded = written(spark, keyed.join(sizes.hint("merge"), ["c", "k"]))  # here and below: files are small for their rows, and Spark would broadcast them by that
    few = crowded.where(F.col("n") <= PAIRWISE)
    a, b = few.select("c", "k", F.col("fp").alias("u")), few.select("c", "k", F.col("fp").alias("v"))
    near = a.join(b.hint("merge"), ["c", "k"]).where("u < v").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS).select("u", "v")
    bits = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - ((1 << 64) if i == 63 else 0)).cast("long") for i in range(64)])
    many = crowded.where(F.col("n") > PAIRWISE).select("fp").distinct()
    ball = many.select("fp", F.explode(bits).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("key"))
    hub = ball.groupBy("key").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("key", "v")
    star = ball.join(hub.hint("merge"), "key").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return near.union(star)


def _components(spark: SparkSession, fps: DataFrame, named_by: str) -> DataFrame:
    """The rows of fps (one a print) with the least value of the column named_by in their component, as component."""
    comps = connected_components(spark, links(spark, fps.select("fp")))
    groups = fps.join(comps.hint("merge"), fps.fp == comps.node, "left").select(*fps.columns, F.coalesce("root", "fp").alias("root"))
    return with_groups(spark, groups, "root", ["fp"], [F.min(named_by).alias("component")], "true").drop("root")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links) of every row."""
    prints = written(spark, fingerprints(docs))
    fps = written(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("__n")))
    named = written(spark, _components(spark, fps, "rep").select("fp", "__n", F.col("component").alias("component_id")))
    return with_rows(prints, named, "fp", ["doc_id"]).select("doc_id", "fp", "component_id")


def dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of docs of each group, in its columns: that of the smallest doc_id (none counts as greatest), then of the least digest of its text.

    Rows equal in doc_id and text are one, whichever; only those that repeat are aggregated for that, in part before their shuffle.
    """
    prints = Table(spark, fingerprints(docs, digest=True).groupBy("doc_id", "digest", "fp").agg(F.count("*").alias("n")))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    fps = written(spark, prints.df.groupBy("fp").agg(F.min(first).alias("first"), F.sum("n").alias("rows")))
    keepers = _components(spark, fps, "first").where("first = component").select("fp", F.col("first.doc_id").alias("kept_id"), F.col("first.digest").alias("kept_digest"))
    same = (prints.df.fp == keepers.fp) & prints.df.doc_id.eqNullSafe(keepers.kept_id) & (prints.df.digest == keepers.kept_digest)
    # more than one in 10,000 of all rows (so 10,000 such at most): known by broadcast and never gathered by their key
    often = max(1000, (prints.df.agg(F.sum("n")).first()[0] or 0) // 10_000)
    found = prints.df.join(keepers.hint("merge"), same, "left").select("doc_id", "digest", "n", F.col("kept_digest").isNotNull().alias("stays"))
    table = written(spark, found.where((F.col("n") > often) | F.col("stays")).toDF("__kid", "__ktext", "__n", "__stays"))
    prints.drop()
    release(spark)
    have = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__d"), F.col("doc_id").cast("long").alias("__id"), _digest(docs).alias("__text"))
    on = F.col("__id").eqNullSafe(F.col("__kid")) & (F.col("__text") == F.col("__ktext"))
    hot, cold = F.broadcast(table.where(F.col("__n") > often)), table.where(F.col("__n") <= often)
    rare = have.join(hot, on, "left_anti").join(cold.hint("merge"), on)
    several = have.join(hot, on).where("__stays").select(*have.columns).union(rare.where("__n > 1").select(*have.columns)).dropDuplicates(["__id", "__text"])
    return rare.where("__n = 1").select("__d.*").union(several.select("__d.*"))
