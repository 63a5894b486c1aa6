"""Connected components by alternating large-star and small-star steps, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.store import cut


#: An edge list of at most this many rows (16 MB) takes its rounds in one task instead of shuffles.
SMALL = 500_000


def _lowest(directed: DataFrame) -> DataFrame:
    """u and the least id among it and its neighbours; combines before the shuffle."""
    return directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the least node reachable. edges has long columns a and b.

    Each round is two grouped minima and two joins; an edge list that no longer changes ends it. Only its size and
    a checksum reach the driver. Loops and repeated edges do no harm; nulls are ignored; no edges give no rows.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = cut(now), None
    small_enough = now.count() <= SMALL
    while True:
        now = now.coalesce(1) if small_enough else now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = both.coalesce(1) if small_enough else both
        large = both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.join(_lowest(large), "u").select("u", "v", "m")
        now = cut(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("label")))
