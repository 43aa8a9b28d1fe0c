"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets and verified pairs.

Vectors equal bit for bit (within a label) form a class, and classes are hashed: in each table a class is put in the bucket of its nearest vertices
and, by multiprobe, in the bucket with the next nearest vertex of the least certain of its rotations. A key has as many rotations as keep buckets
near BUCKET rows whatever the number of vectors, and as many tables as find a pair at the least cosine nearly always. Rows of a bucket
stream past in key order and are compared in double precision; a bucket of any size is dealt as pairs of blocks, so no task
holds it whole. A pair met in several buckets counts in the first of them only, so that links are counted without listing them:
a class's links are summed, and a spanning forest of each block pair is all that goes on to the components.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors without a label, link with nothing; labels are
compared as they are; vectors of different lengths link with nothing; repeated vectors link with each other; rows that repeat a vec_id count as
vectors of their own and share a component; ties of vertices fall to the first axis; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .storage import with_groups, written

MIN_COSINE = 0.98
#: Rows that a bucket holds about at most, if vectors are spread evenly: more vectors get keys of more rotations.
BUCKET = 64
#: Rows of one block of a bucket; larger buckets are compared block by block.
BLOCK = 256
SEED = 20_240_501


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def vertices(x: np.ndarray, table: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest and next nearest vertex (axis and sign) after a pseudo-random rotation, and the gap between them."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([SEED, width, table, part])
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], width)) / np.sqrt(width)
    size = np.abs(y)
    rows = np.arange(len(y))
    first = size.argmax(axis=1)
    top = size[rows, first]
    sign = lambda at: (2 * at + (y[rows, at] < 0)).astype(np.int64)
    one = sign(first)
    size[rows, first] = -1.0
    second = size.argmax(axis=1)
    return one, sign(second), top - size[rows, second]


def layout(n: int, width: int) -> tuple[int, int]:
    """Rotations of a key and number of tables for n vectors of a width; measured in the tests."""
    vertices_each = 2 << max(1, (width - 1).bit_length())
    parts = max(2, math.ceil(math.log(max(1, n / BUCKET)) / math.log(vertices_each)))
    return parts, math.ceil(14 * 1.6 ** (parts - 2))


def keys(x: np.ndarray, parts: int = 2, tables: int = 14) -> np.ndarray:
    """Two bucket keys for every row and table: that of its vertices, and the probe."""
    out = np.zeros((len(x), 2 * tables), np.int64)
    for t in range(tables):
        got = [vertices(x, t, p) for p in range(parts)]
        weakest = np.argmin([g[2] for g in got], axis=0)
        for probe in (0, 1):
            key = np.zeros(len(x), np.uint64)
            for p, (one, two, _) in enumerate(got):
                v = np.where(weakest == p, two, one) if probe else one
                key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ (v.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            out[:, 2 * t + probe] = (np.uint64(t) << np.uint64(48) | key >> np.uint64(16)).astype(np.int64)
    return out


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest key that rows of a and rows of b have in common (tables ascend, so compare table by table)."""
    best = np.full(len(a), np.iinfo(np.int64).max)
    for t in range(0, a.shape[1], 2):
        for i in (t, t + 1):
            for j in (t, t + 1):
                same = a[:, i] == b[:, j]
                best[same] = np.minimum(best[same], a[same, i])
    return best


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, digest (null if the vector links with nothing)."""
    for b in batches:
        out = []
        for v, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            digest = None
            if v and k is not None and None not in v:
                x = np.array(v, np.float64) + 0.0
                if np.isfinite(x).all() and x.any():
                    digest = hashlib.blake2b(f"{k}|".encode() + x.tobytes(), digest_size=16).hexdigest()
            out.append(digest)
        yield pa.record_batch([b.column(0), b.column(2), b.column(1), pa.array(out, pa.string())], names=["vec_id", "label", "embedding", "digest"])


def _unit(vectors: list[list[float]]) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashed(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """rep, label, width, key: the buckets of each class."""
    for b in batches:
        reps, labels, vectors = (b.column(i).to_pylist() for i in range(3))
        widths = np.array([len(v) for v in vectors])
        for w in np.unique(widths):
            at = np.flatnonzero(widths == w)
            k = np.sort(keys(_unit([vectors[i] for i in at]), *layout(n, int(w))), axis=1)
            new = np.column_stack([np.ones(len(at), bool), k[:, 1:] != k[:, :-1]])
            row, col = np.nonzero(new)
            yield pa.record_batch([pa.array([reps[at[r]] for r in row], pa.int64()), pa.array([labels[at[r]] for r in row], pa.string()), pa.array([int(w)] * len(row), pa.int32()), pa.array(k[row, col])], names=["rep", "label", "width", "key"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, n = [], 0
    for b in batches:
        rows.append(b)
        n += b.num_rows
        if n >= 10_000:
            yield pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            rows, n = [], 0
    if n:
        yield pa.Table.from_batches(rows).combine_chunks().to_batches()[0]


def _forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of the links given."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if (ra := root(a)) != (rb := root(b)):
            up[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _compare(batches: Iterator[pa.RecordBatch], total: int) -> Iterator[pa.RecordBatch]:
    """u, v, links: verified links of each run of equal (label, width, key, left, right) in rows sorted by it.

    A row (u, null, n) adds n linked vectors to class u; a row (u, v, null) is a link of a spanning forest.
    """

    def close(run: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(run) < 2:
            return
        rep = np.array([r[0] for r in run])
        x = _unit([r[2] for r in run])
        n = np.array([r[1] for r in run])
        side = np.array([r[3] for r in run])
        key, cross = run[0][4], run[0][5] != run[0][6]
        near = (x @ x.T) >= MIN_COSINE
        i, j = np.nonzero(np.triu(near, 1))
        if cross:
            keep = side[i] != side[j]
            i, j = i[keep], j[keep]
        if not len(i):
            return
        at, back = np.unique(np.concatenate([i, j]), return_inverse=True)
        k, mine = keys(x[at], *layout(total, x.shape[1])), np.zeros(len(i), bool)
        ki, kj = back[: len(i)], back[len(i) :]
        for a in range(0, len(i), 100_000):
            mine[a : a + 100_000] = first_shared(k[ki[a : a + 100_000]], k[kj[a : a + 100_000]]) == key
        i, j = i[mine], j[mine]
        if len(i):
            links = np.bincount(i, weights=n[j], minlength=len(run)) + np.bincount(j, weights=n[i], minlength=len(run))
            at = np.flatnonzero(links)
            span = _forest(rep[i], rep[j])
            u = np.concatenate([rep[at], np.array([s[0] for s in span], np.int64)])
            v = [None] * len(at) + [s[1] for s in span]
            c = [int(z) for z in links[at]] + [None] * len(span)
            yield pa.record_batch([pa.array(u), pa.array(v, pa.int64()), pa.array(c, pa.int64())], names=["u", "v", "links"])

    run, held = [], None
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("rep", "n", "embedding", "block", "key", "left", "right", "label", "width")]
        for rep, n, vec, block, key, left, right, label, width in zip(*cols, strict=True):
            now = (label, width, key, left, right)
            if now != held:
                yield from close(run)
                run, held = [], now
            run.append((rep, n, vec, block, key, left, right))
    yield from close(run)


def links(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """u, v, links as _compare has them, from classes (rep, label, embedding, n)."""
    total = classes.count()
    rows = classes.select("rep", "label", "embedding").mapInArrow(lambda it: _merge(_hashed(it, total)), "rep long, label string, width int, key long")
    buckets = written(spark, rows)
    by = ["label", "width", "key"]
    sizes = buckets.groupBy(*by).agg(F.count("*").alias("size")).where("size > 1")
    near = buckets.join(sizes, by)
    # a row goes to the block pairs that its block takes part in: one for a bucket of a single block
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    near = near.withColumn("blocks", blocks).withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int")).otherwise(0))
    near = near.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    near = near.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")).drop("size", "blocks", "other")
    whole = near.join(classes.select("rep", "n", "embedding"), "rep")
    dealt = whole.select("rep", "n", "embedding", "block", "key", "left", "right", "label", "width").repartition("label", "width", "key", "left", "right").sortWithinPartitions("label", "width", "key", "left", "right")
    return dealt.mapInArrow(lambda it: _compare(it, total), "u long, v long, links long")


def near_duplicates(spark: SparkSession, table: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of table (vec_id, embedding, label)."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    # a row number of its own for every row, so that repeated or null ids stay apart
    rows = rows.mapInArrow(_classes, "vec_id long, label string, embedding array<double>, digest string")
    ids = written(spark, rows.select("vec_id", "label", "digest", F.when(F.col("digest").isNotNull(), F.col("embedding")).alias("embedding")))
    good = ids.where("digest is not null")
    classes = good.groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = written(spark, classes.withColumn("rep", F.monotonically_increasing_id()))
    found = written(spark, links(spark, classes))
    sums = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("far"))
    comps = connected_components(spark, found.where("v is not null").select("u", "v"))
    named = classes.select("digest", "rep", "least", "n").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    named = with_groups(spark, named, "root", ["rep"], [F.min("least").alias("component")], "true")
    named = named.join(sums, "rep", "left").select("digest", "component", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
    out = good.select("vec_id", "digest").join(named, "digest").select("vec_id", "links", "component")
    alone = ids.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    out = out.union(alone)
    return out.select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))
