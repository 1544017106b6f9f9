"""Numbering within a trace, and the batches in which a model would see messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets that ranks are counted in; the broadcast table of their sizes has as many rows.
BUCKETS = 256


def trace_sequence(events: DataFrame, trace: str, order: list[str], to: str = "seq") -> DataFrame:
    """1, 2, 3 ... within each trace: the pipeline's only shuffle."""
    return events.withColumn(to, F.row_number().over(Window.partitionBy(trace).orderBy(*order)))


def batch_shapes(lengths: DataFrame, order: str, length: str, batch: int = 8, most: int = 512) -> DataFrame:
    """Adds batch, seq_len (longest of the batch, at most `most`) and truncated, for batches of consecutive `order` ranks.

    A row's rank is its rank within its bucket of `order` and the rows of lower buckets. Buckets are cut at approximate
    quantiles of the values, so they depend on the values alone, not on how partitions were dealt, and no task holds
    more than some buckets. `order` is a number without repeats; rows where it is null come first, unordered.
    """
    cuts = lengths.select(F.percentile_approx(order, [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("c")).first().c or []
    x = lengths.withColumn("_p", F.coalesce(F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col(order))) if cuts else F.lit(0), F.lit(-1)))
    before = x.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))  # as many rows as buckets
    before = before.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(order))).join(F.broadcast(before), "_p")
    x = x.withColumn("batch", F.floor((F.col("_b") + F.col("_n") - 1) / batch).cast("long"))
    w = Window.partitionBy("batch")
    return x.withColumn("seq_len", F.least(F.max(length).over(w), F.lit(most))).withColumn("truncated", F.col(length) > most).drop("_p", "_n", "_b")
