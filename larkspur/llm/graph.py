"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop, materialize

#: Edges in one part of a table.
PART_ROWS = 50_000


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, component) for every end of `edges` (a, b: long): the smallest id that it reaches.

    Null ends and loops are left out; an empty input gives an empty result. Every step is a group-by with map-side
    minima and a join on the node. The minima, one row a node, are written down before the join: only then are both its
    sides plain exchanges, whose large partitions adaptive execution splits, so a node with very many neighbours is
    no task of its own. The edges are written each round too; nothing comes to the driver but a count and a checksum.
    Tables are written in as many parts as their rows ask for, so few edges aren't spread over very many small files.
    """
    parts = lambda rows: max(1, -(-rows // PART_ROWS))
    k = parts(edges.count())
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    e, seen = materialize(e.coalesce(k), "edges"), None
    for _ in range(most_rounds):
        last = e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = materialize(low.coalesce(k), "minima")
        large = materialize(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(k), "large")
        drop(low)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(k), "minima")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        e = materialize(small.coalesce(k), "edges")
        drop(last, low, large)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == tuple(now):
            break
        seen, k = tuple(now), parts(now.n)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
