"""Connected components of a graph given as links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from retenta.session import stage


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of each node to the smallest node among them and itself.

    The large star does so for neighbours above the node, the small star for those below it. Smallest neighbours are
    found by an aggregation with map-side combine and joined back, so that a node with very many neighbours is split
    like any other skewed join.
    """
    pairs = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else \
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = pairs.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of ``links`` (bigint ``a``, ``b``).

    Loops and repeated links do no harm; links with a null end are left out; no links give no rows. The rounds grow
    with the logarithm of the longest path; each is written to the shared folder, so a lost executor costs one round.
    """
    now = stage(links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).dropna()
                .filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .distinct(), "links")

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    before = state(now)
    while before[0]:
        now = stage(_stars(_stars(now, large=True), large=False), "stars")
        after = state(now)
        if after == before:
            break
        before = after
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
