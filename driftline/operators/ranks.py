"""Exact medians of large groups, by counting and narrowing ranges of values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftline.session import checkpointed

#: Values of a range that are put in order at once, and ranges that a range is divided into.
ENOUGH, RANGES = 4096, 1024


def medians(rows: DataFrame, key: str, value: str, enough: int = ENOUGH) -> DataFrame:
    """(key, median) of ``value`` in each group of ``key``, exactly: the middle value, or the mean of both.

    Each group has one or two ranks to find, and for each the range of values that it lies in. As long as a range holds more than ``enough`` values, the values in it are counted by
    subranges, of which the one with the rank goes on with its own least and greatest value; equal values end it. Counts are added up
    before they are shuffled, so no group meets in a task, and a group of n values takes about log(n / ``enough``) / log(1024) passes. Nulls don't count.
    """
    values = checkpointed(rows.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")))
    found = values.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    ranks = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    state = checkpointed(found.select("key", F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("long").alias("below"), "n"))
    wide = (F.col("n") > enough) & (F.col("low") < F.col("high"))

    def inside(some: DataFrame) -> DataFrame:
        return values.join(some, "key").where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))

    while not state.where(wide).isEmpty():
        place = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * RANGES), F.lit(RANGES - 1))
        counted = inside(state.where(wide)).groupBy("key", "rank", "below", place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.col("below") + F.sum("n").over(W.partitionBy("key", "rank").orderBy("place")) - F.col("n")
        narrowed = counted.withColumn("below", before).where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n")))
        state = checkpointed(state.where(~wide).unionByName(narrowed.select(*state.columns)))
    same = state.where("low = high").select("key", "rank", F.col("low").alias("v"))
    sorted_ = inside(state.where("low < high")).groupBy("key", "rank", "below").agg(F.sort_array(F.collect_list("v")).alias("x"))
    last = sorted_.select("key", "rank", F.get("x", (F.col("rank") - F.col("below")).cast("int")).alias("v"))
    return same.unionByName(last).groupBy("key").agg(F.avg("v").alias("median")).withColumnRenamed("key", key)
