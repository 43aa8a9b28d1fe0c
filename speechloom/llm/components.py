"""Connected components over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Table


def _with_least(spark: SparkSession, rows: DataFrame, total: int) -> tuple[DataFrame, Table]:
    """rows (u, v) with m, the least v of their u; and the written table of (u, m, n) that the caller drops.

    Hubs, those u with more than one in 10,000 of ``total`` rows (no fewer than there are, so at most 10,000 hubs), are joined by
    broadcast and their rows stay where they are; the rows of all others are joined by u.
    """
    low = Table(spark, rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    bound = max(1000, total // 10_000)
    hubs, others = low.df.where(F.col("n") > bound).select("u", "m"), low.df.where(F.col("n") <= bound).select("u", "m")
    at_hubs = rows.join(F.broadcast(hubs), "u")
    elsewhere = rows.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(others.hint("merge"), "u")
    return at_hubs.unionByName(elsewhere), low


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of edges (u, v).

    Alternating large-star and small-star rounds: every round hooks neighbours to the smallest
    known one, so a long chain halves its length. Each step is a partial minimum by key and a join in which the rows
    of a hub are not gathered in a task; nothing but two totals reaches the driver.
    Self-links, repeated links and both directions are fine; null ends are dropped; no edges give no rows.
    """
    e = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    table = Table(spark, e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = (table.df.count(), None)
    while True:
        t = table.df
        both = t.union(t.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star, low = _with_least(spark, both, 2 * before[0])
        larger = star.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        mid = Table(spark, larger)
        table.drop()
        low.drop()
        star, low = _with_least(spark, mid.df, before[0])
        hooked = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        table = Table(spark, hooked.union(low.df.select("u", F.col("m").alias("v"))).distinct())
        mid.drop()
        low.drop()
        now = tuple(table.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    done = table.df
    return done.select(F.col("u").alias("node"), F.col("v").alias("root")).union(done.select("v", "v").distinct())
