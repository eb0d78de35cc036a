"""Dominant periods: autocorrelation and spectrum of every series at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftline.functions.scalar import is_finite
from driftline.operators.ranks import medians
from driftline.operators.spectrum import long_powers
from driftline.session import checkpointed
from driftline.sources.series import compact

MIN_PERIOD = 2
LONGEST = 1000
MIN_AUTOCORR = 0.3
MIN_POWER_RATIO = 3.0
#: Positions that a task correlates at once, and those of a run of smaller blocks.
BLOCK = 32_768
#: Positions that a series is packed by for its spectrum.
PACKED = 8_192
#: Values of a series whose spectrum one task works out.
WHOLE = 1 << 22
#: Digits to which correlations and powers count; what differs less is a tie.
DIGITS = 12


def guards(series: DataFrame, min_period: int = MIN_PERIOD, max_period: int | None = None) -> DataFrame:
    """(series_id, n, mean, std, finite, max_period, usable) of each series' values that aren't missing.

    ``usable`` says that a period can be looked for: enough values, all finite, not all equal, room for more than one period.
    """
    value = F.col("value")
    found = series.groupBy("series_id").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.coalesce(F.bool_and(F.when(value.isNotNull(), is_finite(value))), F.lit(True)).alias("finite"),
    )
    room = F.least(F.floor(F.col("n") / 4), F.lit(LONGEST)) if max_period is None else F.lit(max_period)
    longest = F.greatest(F.lit(min_period), room).cast("int")
    enough = F.col("n") >= max(8, 4 * min_period)
    usable = enough & F.col("finite") & (F.col("std") > 0) & (longest > min_period)
    return found.withColumn("max_period", longest).withColumn("usable", F.coalesce(usable, F.lit(False)))


def acf(series: DataFrame, min_period: int = MIN_PERIOD, max_period: int | None = None, block: int = BLOCK) -> DataFrame:
    """(series_id, lag, acf): the biased autocorrelation from lag 0 to the longest period, of usable series.

    Series are packed into blocks of positions, eight bytes a point, which are dealt in runs of ``BLOCK`` positions (one block at least), each with as many positions of the
    next run as there are lags: a long series is many tasks, whatever the blocks' size. A run's blocks are transformed together, and their sums added up before
    they leave the task.
    """
    run = max(1, BLOCK // block)

    def lag_sums(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        """Sums of x[t] * x[t + lag] over the run's own positions t; the run comes with the positions that follow it."""
        lags, home = parts["max_period"][0].as_py(), parts["home"].to_numpy()
        lists = parts["x"].combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        x = np.concatenate([flat[ends[k] : ends[k + 1]] for k in np.argsort(home)])
        # only a series' last block is shorter than the others, and nothing follows it
        blocks = int(np.count_nonzero(home // run == key[1].as_py()))
        padded = np.zeros(blocks * block + lags)
        padded[: len(x)] = x
        reached = np.lib.stride_tricks.sliding_window_view(padded, block + lags)[::block]
        size = 1 << int(np.ceil(np.log2(2 * block + lags)))
        # what stands after the lags are the negative ones
        spectrum = (np.conj(np.fft.rfft(reached[:, :block], size)) * np.fft.rfft(reached, size)).sum(axis=0)
        name = pa.array([key[0].as_py()]).take(pa.array(np.zeros(lags + 1, np.int8)))
        return pa.table({"series_id": name, "lag": pa.array(np.arange(lags + 1), pa.int32()), "s": np.fft.irfft(spectrum, size)[: lags + 1]})

    known = guards(series, min_period, max_period).where("usable").select("series_id", "mean", "max_period")
    rows = compact(series.select("series_id", "pos", "value")).join(known, "series_id")
    rows = rows.select("series_id", "max_period", F.floor(F.col("cpos") / block).alias("home"), "cpos", (F.col("value") - F.col("mean")).alias("x"))
    packed = rows.groupBy("series_id", "max_period", "home").agg(F.sort_array(F.collect_list(F.struct("cpos", "x"))).alias("p"))
    first = F.greatest(F.lit(0), F.floor((F.col("home") - F.ceil(F.col("max_period") / block)) / run))
    spread = packed.select("series_id", "max_period", "home", F.transform("p", lambda p: p["x"]).alias("x"), F.explode(F.sequence(first, F.floor(F.col("home") / run))).alias("run"))
    # of a block behind the run's last one, what the lags reach
    behind = F.col("home") - (F.col("run") + 1) * run
    needed = F.when(behind < 0, F.lit(block)).otherwise(F.least(F.lit(block), F.col("max_period") - behind * block)).cast("int")
    spread = spread.withColumn("x", F.slice("x", 1, needed))
    sums = spread.groupBy("series_id", "run").applyInArrow(lag_sums, "series_id string, lag int, s double").groupBy("series_id", "lag").agg(F.sum("s").alias("s"))
    zero = F.max(F.when(F.col("lag") == 0, F.col("s"))).over(W.partitionBy("series_id"))
    return sums.select("series_id", "lag", (F.col("s") / zero).alias("acf"))


def autocorr_periods(series: DataFrame, min_period: int = MIN_PERIOD, max_period: int | None = None, min_autocorr: float = MIN_AUTOCORR) -> DataFrame:
    """(series_id, estimated_period): the highest local peak of the autocorrelation; null where there is none that counts.

    Without a local peak all lags are candidates. Ties go to the smallest lag.
    """
    by = W.partitionBy("series_id").orderBy("lag")
    known = guards(series, min_period, max_period).select("series_id", "max_period")
    r = F.round("acf", DIGITS)
    lags = acf(series, min_period, max_period).withColumn("r", r).join(known, "series_id")
    lags = lags.withColumns({"low": F.lag("r").over(by), "high": F.lead("r").over(by)})
    inner = (F.col("lag") > min_period) & (F.col("lag") < F.col("max_period"))
    lags = lags.withColumn("peak", (inner & (F.col("r") > F.col("low")) & (F.col("r") >= F.col("high"))).cast("int")).where(F.col("lag") >= min_period)
    best = lags.groupBy("series_id").agg(F.max(F.struct("peak", "r", (-F.col("lag")).alias("minus"))).alias("best"))
    found = best.where(F.col("best.r") >= min_autocorr).select("series_id", (-F.col("best.minus")).cast("int").alias("estimated_period"))
    return series.select("series_id").distinct().join(found, "series_id", "left")


def _powers(key: tuple[pa.Scalar, ...], blocks: pa.Table) -> pa.Table:
    order = np.argsort(blocks["block"].to_numpy())
    lists = blocks["x"].combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    x = np.concatenate([flat[ends[k] : ends[k + 1]] for k in order])
    power = np.abs(np.fft.rfft(x)) ** 2
    k = np.arange(1, len(x) // 2 + 1)
    return pa.table({"series_id": pa.array([key[0].as_py()]).take(pa.array(np.zeros(len(k), np.int8))), "k": k, "period": len(x) / k, "power": power[1 : len(k) + 1]})


def periodogram(series: DataFrame, min_period: int = MIN_PERIOD, max_period: int | None = None, longest: int = WHOLE) -> DataFrame:
    """(series_id, k, period, power) of each usable series: its spectrum without the mean.

    A series of up to ``longest`` values is transformed by one task, which gets it in packed blocks of positions, eight bytes a point; longer
    ones by many (see ``spectrum``), with equal results up to rounding.
    """
    known = checkpointed(guards(series, min_period, max_period).where("usable").select("series_id", "mean", "n"))
    short = known.where(F.col("n") <= longest)
    rows = series.where("value IS NOT NULL").join(short, "series_id").select("series_id", "pos", (F.col("value") - F.col("mean")).alias("x"))
    packed = rows.groupBy("series_id", F.floor(F.col("pos") / PACKED).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("p"))
    packed = packed.select("series_id", "block", F.transform("p", lambda p: p["x"]).alias("x"))
    found = packed.groupBy("series_id").applyInArrow(_powers, "series_id string, k long, period double, power double")
    long = known.where(F.col("n") > longest)
    if long.isEmpty():
        return found
    placed = compact(series.join(long.select("series_id"), "series_id", "left_semi")).join(long, "series_id")
    return found.unionByName(long_powers(placed.select("series_id", "cpos", "n", (F.col("value") - F.col("mean")).alias("x"))))


def fft_periods(series: DataFrame, min_period: int = MIN_PERIOD, max_period: int | None = None, min_power_ratio: float = MIN_POWER_RATIO) -> DataFrame:
    """(series_id, estimated_period) from the strongest bin of the spectrum; null where none stands out. Ties go to the lowest bin."""
    known = guards(series, min_period, max_period).select("series_id", "max_period")
    bins = periodogram(series, min_period, max_period).join(known, "series_id").where((F.col("period") >= min_period) & (F.col("period") <= F.col("max_period")))
    bins = checkpointed(bins)
    best = bins.groupBy("series_id", "max_period").agg(F.max(F.struct("power", (-F.col("k")).alias("minus"), "period")).alias("best"))
    best = best.join(medians(bins, "series_id", "power").withColumnRenamed("median", "middle"), "series_id")
    stands = (F.col("best.power") > 0) & ((F.col("middle") <= 0) | (F.col("best.power") / F.col("middle") >= min_power_ratio))
    period = F.bround(F.col("best.period")).cast("int")
    found = best.where(stands & (period >= min_period) & (period <= F.col("max_period"))).select("series_id", period.alias("estimated_period"))
    return series.select("series_id").distinct().join(found, "series_id", "left")


def periods(series: DataFrame, method: str) -> DataFrame:
    """(series_id, estimated_period) by ``autocorr`` or ``fft``."""
    if method == "autocorr":
        return autocorr_periods(series)
    if method == "fft":
        return fft_periods(series)
    raise ValueError(f"no method of period estimation is called {method!r}: take 'autocorr' or 'fft'")
