"""Labels to spans: within the row where a text's labels are an array, as a window where tokens are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bio_decode(tokens: DataFrame, keys: list[str], orphans: bool = False) -> DataFrame:
    """(keys, start, end, entity) from rows (keys, pos, label, start, end, length).

    B-X opens a span; I-X that follows B-X or I-X of the same X extends it; any other I- is ignored (with `orphans`, it
    opens one). A span is dropped, with its I- tokens, unless 0 <= start < end <= length. One shuffle on the keys.
    """
    by = Window.partitionBy(*keys).orderBy("pos")
    kind, entity = F.substring("label", 1, 1), F.expr("substr(label, 3)")
    x = tokens.withColumn("_k", kind).withColumn("_e", entity)
    x = x.withColumn("_on", (F.col("_k") == "I") & F.lag("_k").over(by).isin("B", "I") & F.coalesce(F.lag("_e").over(by) == F.col("_e"), F.lit(False)))
    x = x.withColumn("_on", F.coalesce("_on", F.lit(False))).withColumn("_g", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(by))
    opens = F.col("_k").isin("B", "I") if orphans else F.col("_k") == "B"
    x = x.filter(F.col("_k").isin("B", "I")).groupBy(*keys, "_g").agg(F.min(F.struct("pos", "start", "_k", "_e")).alias("a"), F.max(F.struct("pos", "end")).alias("z"), F.max("length").alias("length"))
    x = x.select(*keys, F.col("a.start").alias("start"), F.col("z.end").alias("end"), F.col("a._e").alias("entity"), F.col("a._k").alias("_k"), "length")
    return x.filter(opens & (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.col("length"))).select(*keys, "start", "end", "entity")


def bio_spans(labels: Column, starts: Column, ends: Column, length: Column, orphans: bool = False) -> Column:
    """array<struct<start, end, entity>> by the rules of `bio_decode`, for arrays of one text: no shuffle, no Python.

    One pass marks where runs begin, one where they end. Null labels give null.
    """
    rest = lambda x: F.substring(x, 3, 1 << 30)

    def decoded(x: Column) -> Column:
        tag = lambda i: F.get(x["labels"], i)
        goes_on = lambda i: F.coalesce(tag(i).startswith("I-") & F.substring(tag(i - 1), 1, 2).isin("B-", "I-") & (rest(tag(i - 1)) == rest(tag(i))), F.lit(False))
        inside = lambda t: F.substring(t, 1, 2).isin("B-", "I-")
        places = lambda keep: F.filter(F.transform(x["labels"], lambda t, i: F.when(inside(t) & keep(i), i)), lambda i: i.isNotNull())
        heads, lasts = places(lambda i: ~goes_on(i)), places(lambda i: ~goes_on(i + 1))
        runs = F.zip_with(heads, lasts, lambda a, z: F.struct(F.get(x["starts"], a).alias("start"), F.get(x["ends"], z).alias("end"), rest(tag(a)).alias("entity"), tag(a).startswith("B-").alias("opens")))
        fine = F.filter(runs, lambda s: (s["opens"] | F.lit(orphans)) & (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= x["length"]))
        return F.transform(fine, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity"].alias("entity")))

    # bound to a lambda's variable, so that the arrays are computed once and not wherever they are named
    once = F.array(F.struct(labels.alias("labels"), starts.alias("starts"), ends.alias("ends"), length.alias("length")))
    return F.get(F.transform(once, decoded), 0)
