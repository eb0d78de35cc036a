"""Window scores, residual series and window results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftline.functions.arima import checked_order, fit
from driftline.functions.scalar import is_finite
from driftline.operators.windows import position_blocks
from driftline.session import checkpointed, ship_package

#: Windows that are fitted at once.
BATCH = 1024
FITTED = "series_id string, branch string, block bigint, positions array<bigint>, sigma2 array<double>, converged array<boolean>, residual_sum array<double>, residual_count array<int>"


def _lists(flat: np.ndarray, sizes: list[int], kind: pa.DataType) -> pa.ListArray:
    """Lists of the given sizes; NaN is null."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(flat, kind, from_pandas=True))


def _rows(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column of numbers."""
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]


def fit_blocks(blocks: DataFrame, order: tuple[int, int, int], burn: bool = False) -> DataFrame:
    """Fits the model to the windows of blocks (see ``position_blocks``): a row for each block.

    It has the windows' numbers, times, innovation variances (null where a window can't be fitted) and whether each converged; and for the block's points
    their positions, and the sum and number of the residuals that its windows have there. A point is in many windows, but nothing is a row for each of both. A block's windows are slices of its values,
    so a long series is many tasks; a task fits the windows of one length together. The first d residuals of a window of order (p, d, q) are its values themselves, or left out with ``burn``.
    """
    order = checked_order(order)
    ship_package(blocks.sparkSession)

    def fitted(parts: list[dict]) -> None:
        """Fits the windows of all ``parts``, which have one length, and puts the results into these."""
        w = parts[0]["w"]
        values = np.concatenate([np.lib.stride_tricks.sliding_window_view(p["values"], w)[p["offsets"]] for p in parts])
        sigma2, residuals, sure = fit(values, order)
        at = 0
        for p in parts:
            n = len(p["offsets"])
            left = residuals[at : at + n]
            left[:, : order[1] * burn] = np.nan
            good = np.isfinite(left)
            where = (p["offsets"][:, None] + np.arange(w))[good]
            p["sigma2"], p["converged"] = sigma2[at : at + n], sure[at : at + n]
            p["sum"] = np.bincount(where, left[good], minlength=len(p["values"]))
            p["count"] = np.bincount(where, minlength=len(p["values"]))
            at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = zip(batch["w"].to_pylist(), _rows(batch["offsets"]), _rows(batch["values"]), strict=True)
            parts = [{"w": w, "offsets": offsets, "values": values} for w, offsets, values in lists]
            waiting: dict[int, list[dict]] = {}
            for p in parts:
                own = waiting.setdefault(p["w"], [])
                own.append(p)
                if sum(len(x["offsets"]) for x in own) >= BATCH:
                    fitted(waiting.pop(p["w"]))
            for own in waiting.values():
                fitted(own)
            windows, points = [len(p["offsets"]) for p in parts], [len(p["values"]) for p in parts]
            columns = [_lists(np.concatenate([p[k] for p in parts]), sizes, kind) for k, sizes, kind in (("sigma2", windows, pa.float64()), ("converged", windows, pa.bool_()), ("sum", points, pa.float64()), ("count", points, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch["series_id"], batch["branch"], batch["block"], batch["told"], batch["positions"], *columns], names=["series_id", "branch", "block", "told", "positions", "sigma2", "converged", "residual_sum", "residual_count"])

    def time_of(place: Column) -> Column:
        return F.element_at("points", place)["time"]

    told = F.transform("windows", lambda x: F.struct(x["window_no"].alias("window_no"), time_of(x["offset"] + 1).alias("window_start"), time_of(x["offset"] + F.col("w")).alias("window_end")))
    rows = blocks.select("series_id", "branch", "block", "w", told.alias("told"), F.transform("windows", lambda x: x["offset"]).alias("offsets"), F.transform("points", lambda p: p["pos"]).alias("positions"), F.transform("points", lambda p: p["value"]).alias("values"))
    return rows.mapInArrow(run, FITTED.replace("positions", "told array<struct<window_no:bigint,window_start:timestamp_ntz,window_end:timestamp_ntz>>, positions", 1))


def score_series(series: DataFrame, settings: DataFrame, order: tuple[int, int, int], on_short: str = "error", burn: bool = False) -> DataFrame:
    """Cuts the series into blocks of windows and fits each window."""
    return fit_blocks(position_blocks(series, settings, on_short), order, burn)


def scores(fitted: DataFrame) -> DataFrame:
    """(series_id, branch, window_no, window_start, window_end, sigma2, converged) of each window."""
    rows = fitted.select("series_id", "branch", F.inline(F.arrays_zip("told", "sigma2", "converged")))
    return rows.select("series_id", "branch", "told.*", "sigma2", "converged")


def residual_series(fitted: DataFrame, series: DataFrame) -> DataFrame:
    """(series_id, branch, pos, time, residual): the mean residual over the windows that cover a row; null where none does.

    Blocks share the rows that the first windows of the next one reach back to, so the sums of at most two blocks are added up for a row.
    """
    points = fitted.select("series_id", "branch", F.inline(F.arrays_zip("positions", "residual_sum", "residual_count"))).where("residual_count > 0")
    means = points.groupBy("series_id", "branch", F.col("positions").alias("pos")).agg((F.sum("residual_sum") / F.sum("residual_count")).alias("residual"))
    whole = series if "branch" in series.columns else series.withColumn("branch", F.lit("raw"))
    return whole.select("series_id", "branch", "pos", "time").join(means, ["series_id", "branch", "pos"], "left")


def overlaps(scored: DataFrame, labels: DataFrame, block: str = "hour") -> DataFrame:
    """Adds ``actual_anomaly``: whether a labelled time lies between a window's first and last time.

    The last labelled time up to a window's end decides. It is looked for in the end's own block of time, in one pass over
    both in the order of time, and else it is the last one of the blocks before, so no task sorts a whole series.
    """
    marks = labels.where("is_anomaly = 1").select("series_id", F.col("time").alias("at"), F.lit(0).alias("kind"), F.col("time").alias("mark"))
    ends = scored.select("series_id", F.col("window_end").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("mark"), F.struct(*scored.columns).alias("row"))
    both = marks.withColumn("row", F.lit(None).cast(ends.schema["row"].dataType)).unionByName(ends).withColumn("block", F.date_trunc(block, "at"))
    before = F.max(F.max("mark")).over(W.partitionBy("series_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    earlier = both.groupBy("series_id", "block").agg(before.alias("earlier"))
    here = F.last("mark", ignorenulls=True).over(W.partitionBy("series_id", "block").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0))
    seen = both.withColumn("here", here).where("kind = 1").join(earlier, ["series_id", "block"]).select("row.*", F.coalesce("here", "earlier").alias("latest"))
    return seen.withColumn("actual_anomaly", F.coalesce(F.col("latest") >= F.col("window_start"), F.lit(False)).cast("int")).drop("latest")


def train_flags(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``is_train``: whether a window ends by the last training time; as is where labels have no training rows."""
    if "is_train" not in labels.columns:
        return scored
    last = labels.where("is_train = 1").groupBy("series_id").agg(F.max("time").alias("_last"))
    return scored.join(last, "series_id", "left").withColumn("is_train", (F.col("window_end") <= F.col("_last")).cast("int")).drop("_last")


def flag_best(scored: DataFrame) -> DataFrame:
    """Adds ``predicted_anomaly``: 1 for the window with the highest score of each series and branch, the first of equal ones."""
    best = scored.where("sigma2 IS NOT NULL").groupBy("series_id", "branch").agg(F.max(F.struct("sigma2", (-F.col("window_no")).alias("minus"))).alias("_best"))
    best = best.select("series_id", "branch", (-F.col("_best.minus")).alias("window_no"), F.lit(1).alias("_flag"))
    return scored.join(best, ["series_id", "branch", "window_no"], "left").withColumn("predicted_anomaly", F.coalesce("_flag", F.lit(0))).drop("_flag")


def window_results(scored: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(series_id, branch, window_no, time, window_start, window_end, sigma2, actual_anomaly, predicted_anomaly), and converged where the scores have it.

    The scores are read several times, so they are materialised first: every window is fitted once.
    """
    scored = checkpointed(scored)
    sure = [c for c in scored.columns if c == "converged"]
    known = labels is not None and "is_anomaly" in labels.columns
    seen = overlaps(scored, labels) if known else scored.withColumn("actual_anomaly", F.lit(0))
    return flag_best(seen).select("series_id", "branch", "window_no", F.col("window_end").alias("time"), "window_start", "window_end", "sigma2", *sure, "actual_anomaly", "predicted_anomaly")
