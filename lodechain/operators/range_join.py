"""Interval join: Spark has no range join, so both sides are cut into time buckets and joined on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def range_join(anchors: DataFrame, events: DataFrame, keys: list[str], at: str, time: str, before: int, after: int, how: str = "inner") -> DataFrame:
    """Events with ``anchors.at - before <= events.time <= anchors.at + after`` and equal ``keys`` (null keys never
    meet). ``at`` and ``time`` are integer columns of one unit. An anchor spans two buckets at most and an event lies
    in one, so no pair appears twice and a hot key is spread over its buckets. Column names other than the keys must
    differ."""
    width = max(1, before + after)
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    left = anchors.withColumn("__b", F.explode(F.sequence(bucket(F.col(at) - before), bucket(F.col(at) + after))))
    right = events.withColumn("__b", bucket(F.col(time)))
    return left.join(right, [*keys, "__b"], how).where(F.col(time).between(F.col(at) - before, F.col(at) + after)).drop("__b")


def range_join_totals(anchors: DataFrame, events: DataFrame, keys: list[str], anchor: str, at: str, id: str, time: str, before: int, after: int) -> DataFrame:
    """(anchor, n, total): of the events that ``range_join`` gives each anchor id, but for those of the anchor's own id, the number
    of distinct ids and the sum of all ids. Anchors without events are left out.

    No row is made for a pair. Buckets are as wide as the interval, so that it begins in one and ends in the next; running
    totals over each (keys, bucket), and the totals of the bucket before, give what lies within. An id that comes back
    within the interval's width counts once: of two neighbouring occurrences the later takes one off, and where an
    interval begins behind the earlier one it is given back. Only an anchor id of several (keys, time) makes pairs."""
    width = before + after + 1  # from an interval's begin to the first time behind it
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    present = lambda df, *names: df.where(reduce(Column.__and__, [F.col(x).isNotNull() for x in names]))
    a = present(anchors, *keys, anchor, at).groupBy(*keys, F.col(anchor).alias("__a"), F.col(at).alias("__t")).agg(F.count("*").alias("__m"))
    a = a.withColumn("__places", F.count("*").over(Window.partitionBy("__a")))
    b = present(events, *keys, id, time).select(*keys, F.col(id).alias("__i"), F.col(time).alias("__t"))
    one, several = a.where("__places = 1"), a.where("__places > 1")

    zero, t, p, i = F.lit(0).cast("long"), F.col("__t"), F.col("__p"), F.col("__i")
    back = b.withColumn("__p", F.lag("__t").over(Window.partitionBy(*keys, "__i").orderBy("__t"))).where(t - p < width)

    def rows(df: DataFrame, t: Column, n: Column, total: Column, carries: Column, marks: bool = False) -> DataFrame:
        """Changes at times ``t``, or marks at which the totals of what is before them are read."""
        who = (F.col("__a"), F.col("__m")) if marks else (F.lit(None).cast(a.schema["__a"].dataType), F.lit(None).cast("long"))
        return df.select(*keys, bucket(t).alias("__b"), t.alias("__t"), F.lit(int(not marks)).alias("__s"), n.cast("long").alias("__n"), total.cast("long").alias("__x"), carries.alias("__c"), who[0].alias("__a"), who[1].alias("__m"))

    def read(changes: DataFrame, marks: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys, "__b").orderBy("__t", "__s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return changes.union(marks).withColumns({"__n": F.sum("__n").over(w), "__x": F.sum("__x").over(w)}).where(F.col("__a").isNotNull()).select("__a", "__m", "__n", "__x")

    met = rows(b, t, F.lit(1), i, F.lit(True))
    entered = met.union(rows(back, t, F.lit(-1), zero, bucket(t) == bucket(p)))
    carried = entered.where("__c").groupBy(*keys, "__b").agg(F.sum("__n").alias("__n"), F.sum("__x").alias("__x"))
    carried = rows(carried, (F.col("__b") + 1) * width, F.col("__n"), F.col("__x"), F.lit(False)).withColumn("__s", F.lit(-1))
    ends = read(entered.union(carried), rows(one, t + (after + 1), zero, zero, F.lit(False), True))
    begins = read(met.union(rows(back, p, F.lit(-1), zero, F.lit(False))), rows(one, t - before, zero, zero, F.lit(False), True))
    own = one.join(b.withColumnRenamed("__t", "__bt").withColumn("__a", i), [*keys, "__a"]).where(F.col("__bt").between(t - before, t + after)).groupBy("__a", "__m").agg(F.lit(1).cast("long").alias("__n"), F.sum("__i").alias("__x"))
    minus = begins.union(own).select("__a", "__m", (-F.col("__n")).alias("__n"), (-F.col("__x")).alias("__x"))
    sums = ends.union(minus).groupBy("__a", "__m").agg(F.sum("__n").alias("n"), F.sum("__x").alias("x")).where("n > 0").select("__a", "n", (F.col("x") * F.col("__m")).alias("total"))
    pairs = range_join(several.withColumnRenamed("__t", "__at"), b, keys, "__at", "__t", before, after).where(F.col("__a") != i)
    sums = sums.union(pairs.groupBy("__a").agg(F.count_distinct("__i").alias("n"), F.sum(i * F.col("__m")).alias("total")))
    return sums.withColumnRenamed("__a", anchor)
