"""Settings of each series, and seasonal differencing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalar import stride_for, window_size_for
from driftline.operators.periods import periods

MIN_WINDOW_SIZE = 50
WINDOW_SIZE, STRIDE = 200, 50


def window_settings(series: DataFrame, method: str = "autocorr", window_size: int = WINDOW_SIZE, stride: int = STRIDE, mode: str = "seasonal_diff", min_window_size: int = MIN_WINDOW_SIZE) -> DataFrame:
    """A row of settings for each series: its period, and window and stride from it, or the given ones where there is none."""
    if mode not in ("raw", "seasonal_diff"):
        raise ValueError(f"series are scored in mode 'raw' or 'seasonal_diff', not {mode!r}")
    if stride <= 0:
        raise ValueError("windows must move on by one row or more: the stride is too small")
    if mode == "raw":
        found = series.select("series_id").distinct().withColumn("estimated_period", F.lit(None).cast("int"))
    else:
        found = periods(series, method)
    period = F.col("estimated_period")
    size = F.when(period.isNotNull(), window_size_for(period, min_window_size)).otherwise(F.lit(window_size))
    return found.select(
        "series_id",
        F.lit(mode).alias("preprocessing_mode"),
        F.lit("none" if mode == "raw" else method).alias("period_method"),
        "estimated_period",
        period.isNotNull().alias("seasonal_adjustment"),
        size.alias("window_size"),
        F.when(period.isNotNull(), stride_for(size)).otherwise(F.lit(stride)).cast("int").alias("stride"),
    )


#: Rows of a block of a differenced series, at least; long periods have blocks of as many periods.
BLOCK, PERIODS = 4096, 8


def seasonal_diff(series: DataFrame, settings: DataFrame) -> DataFrame:
    """Each value less the one a period before, by position; a period's first rows become missing, a series without one stays.

    Series are packed into blocks of positions, each with the period's rows in front of it: one shuffle, in which an eighth of the rows at most goes to two blocks. The
    positions of a series are 0, 1, 2, ... without gaps (missing values are rows too); a gap is an error.
    """
    p = F.col("p")
    known = settings.select("series_id", F.coalesce("estimated_period", F.lit(0)).cast("long").alias("p"))
    rows = series.select("series_id", "pos", "time", "value").join(known, "series_id")
    size = F.greatest(F.lit(BLOCK), PERIODS * p)
    home = F.floor(F.col("pos") / size)
    # a row is in the next block too, if that reaches back to it; a last block of such rows only gives none
    after = F.floor((F.col("pos") + p) / size)
    spread = rows.withColumn("block", F.explode(F.sequence(home, after)))
    packed = spread.groupBy("series_id", "block", "p").agg(F.sort_array(F.collect_list(F.struct("pos", "time", "value"))).alias("x"))
    last, first = F.element_at("x", -1)["pos"], F.element_at("x", 1)["pos"]
    gap = F.raise_error(F.concat(F.lit("positions with a gap or twice: series "), F.col("series_id"))).cast("int")
    ahead = (F.col("block") * size - first).cast("int")
    packed = packed.withColumn("ahead", F.when(last - first + 1 != F.size("x"), gap).otherwise(F.greatest(ahead, F.lit(0))))
    own = F.slice("x", F.col("ahead") + 1, F.greatest(F.size("x") - F.col("ahead"), F.lit(0)))

    def less(row: Column, k: Column) -> Column:
        at = (k + F.col("ahead") - p).cast("int")
        earlier = F.when(at >= 0, F.get("x", at)["value"])
        return F.struct(row["pos"].alias("pos"), row["time"].alias("time"), F.when(p == 0, row["value"]).otherwise(row["value"] - earlier).alias("value"))

    return packed.select("series_id", F.inline(F.transform(own, less)))


def branches(series: DataFrame, settings: DataFrame, which: tuple[str, ...] = ("final",)) -> DataFrame:
    """(series_id, branch, pos, time, value): the series as they are scored.

    ``final`` is the differenced series where there is a period, else the raw one. ``both`` gives raw ones for all and
    differenced ones where there is a period.
    """
    if which not in (("final",), ("both",)):
        raise ValueError("which must be ('final',) or ('both',)")
    adjusted = settings.where("seasonal_adjustment").select("series_id")
    changed = seasonal_diff(series.join(adjusted, "series_id", "left_semi"), settings).withColumn("branch", F.lit("transformed"))
    raw = series.select("series_id", "pos", "time", "value").withColumn("branch", F.lit("raw"))
    if which == ("final",):
        raw = raw.join(adjusted, "series_id", "left_anti")
    return raw.unionByName(changed).select("series_id", "branch", "pos", "time", "value")
