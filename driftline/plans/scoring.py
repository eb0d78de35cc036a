"""Scoring plans: a corpus with its evaluation, and series without one."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.arima import checked_order
from driftline.functions.scalar import run_name
from driftline.operators.evaluate import anomaly_bounds, localisation
from driftline.operators.preprocess import STRIDE, WINDOW_SIZE, branches, window_settings
from driftline.operators.scoring import score_series, scores, window_results
from driftline.schemas import METRICS
from driftline.session import checkpointed
from driftline.sources.series import checked_mode


@dataclass(frozen=True)
class Parameters:
    """How series are scored. ``branches`` is ("final",), or ("both",) to score raw series next to differenced ones.

    A series of a corpus that can't be scored is an error, or left out with ``on_error="skip"``; ``scored_corpus`` tells why.
    """

    order: tuple[int, int, int] = (1, 1, 1)
    mode: str = "seasonal_diff"
    method: str = "autocorr"
    window_size: int = WINDOW_SIZE
    stride: int = STRIDE
    branches: tuple[str, ...] = ("final",)
    on_short: str = "error"
    on_error: str = "error"
    base: str | None = None
    folder: str = "results"


def scored_windows(series: DataFrame, labels: DataFrame | None, how: Parameters) -> tuple[DataFrame, DataFrame]:
    """Settings of each series and the results of its windows."""
    checked_order(how.order)
    settings = checkpointed(window_settings(series, how.method, how.window_size, how.stride, how.mode))
    fitted = score_series(branches(series, settings, how.branches), settings, how.order, how.on_short)
    return settings, window_results(scores(fitted), labels)


def labelled_bounds(labels: DataFrame) -> DataFrame:
    """The labelled interval of each series; labels without a labelled row are an error."""
    none = F.raise_error(F.concat(F.lit("no labelled row in the labels of "), F.col("series_id"))).cast("long")
    return anomaly_bounds(labels).withColumn("anomaly_start", F.when(F.col("n_anomaly") == 0, none).otherwise(F.col("anomaly_start")))


def corpus_status(series: DataFrame, labels: DataFrame, catalog: DataFrame, how: Parameters, found: DataFrame | None = None) -> DataFrame:
    """(series_id, category, dataset_name, reason) of each series of ``catalog``: why it can't be scored, null where it can.

    In this order: what ``found`` (series_id, reason) says, as from ``prepared_status``; ``no_series`` and ``no_labels`` where there are no rows;
    ``no_is_anomaly`` and ``no_labelled_row`` of the labels; ``short`` where a branch has fewer values than its window.
    """
    flag = F.col("is_anomaly") if "is_anomaly" in labels.columns else F.lit(None).cast("int")
    marked = labels.groupBy("series_id").agg(F.count(flag).alias("n_flags"), F.sum(flag).alias("n_anomaly"))
    settings = window_settings(series, how.method, how.window_size, how.stride, how.mode)
    sizes = branches(series, settings, how.branches).groupBy("series_id", "branch").agg(F.count("value").alias("n")).groupBy("series_id").agg(F.min("n").alias("n_values"))
    sizes = sizes.join(settings.select("series_id", "window_size"), "series_id")
    rows = catalog.select("series_id", "category", "dataset_name").join(sizes, "series_id", "left").join(marked, "series_id", "left")
    told = F.lit(None).cast("string")
    if found is not None:
        rows, told = rows.join(found.select("series_id", F.col("reason").alias("told")), "series_id", "left"), F.col("told")
    seen = (
        F.when(F.col("n_values").isNull(), F.lit("no_series"))
        .when(F.col("n_flags").isNull(), F.lit("no_labels"))
        .when(F.col("n_flags") == 0, F.lit("no_is_anomaly"))
        .when(F.col("n_anomaly") == 0, F.lit("no_labelled_row"))
        .when(F.col("n_values") < F.col("window_size"), F.lit("short"))
    )
    return rows.select("series_id", "category", "dataset_name", F.coalesce(told, seen).alias("reason"))


def scored_corpus(series: DataFrame, labels: DataFrame, catalog: DataFrame, how: Parameters = Parameters(), found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The metrics of all series that can be scored, and the status of each: ``scored``, or ``skipped`` with the reason (see ``corpus_status``)."""
    checks = checkpointed(corpus_status(series, labels, catalog, how, found))
    good = checks.where("reason IS NULL").select("series_id")
    kept = [rows.join(good, "series_id", "left_semi") for rows in (series, labels, catalog)]
    flagged = kept[1] if "is_anomaly" in labels.columns else kept[1].withColumn("is_anomaly", F.lit(None).cast("int"))
    metrics = corpus_metrics(kept[0], flagged, kept[2], replace(how, on_error="error"))
    status = F.when(F.col("reason").isNull(), F.lit("scored")).otherwise(F.lit("skipped"))
    return metrics, checks.select("series_id", "category", "dataset_name", status.alias("status"), "reason")


def corpus_metrics(series: DataFrame, labels: DataFrame, catalog: DataFrame, how: Parameters = Parameters()) -> DataFrame:
    """A row of metrics, 22 columns, for each series of ``catalog`` (series_id, category, dataset_name).

    Series without labels are left out; labels without a labelled row are an error, and so is a series that is shorter than its window. With
    ``on_error="skip"`` all these are left out (see ``scored_corpus``).
    """
    if checked_mode(how.on_error) == "skip":
        return scored_corpus(series, labels, catalog, how)[0]
    if "is_anomaly" not in labels.columns:
        raise ValueError("the labels have no column is_anomaly")
    kept = series.join(labels.select("series_id").distinct(), "series_id", "left_semi")
    settings, results = scored_windows(kept, labels, how)
    # what counts is the differenced branch where there is one
    final = results.join(settings.select("series_id", F.when(F.col("seasonal_adjustment"), F.lit("transformed")).otherwise(F.lit("raw")).alias("branch")), ["series_id", "branch"], "left_semi")
    bounds = labelled_bounds(labels)
    counts = kept.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_points"), F.min("time").alias("reference"))
    best = final.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_windows"), F.max(F.when(F.col("predicted_anomaly") == 1, F.struct("window_start", "window_end", "sigma2"))).alias("best"))
    flagged = best.where("best IS NOT NULL").select("series_id", "best.*", F.lit(1).alias("predicted_anomaly"))
    metric = localisation(flagged, bounds, counts.select("series_id", F.col("reference").alias("time")))
    run = f"{how.folder}/{run_name(how.order, how.mode, how.method, how.window_size, how.stride, how.base)}"
    where = F.concat(F.col("category"), F.lit("/"), F.col("dataset_name"))
    rows = catalog.join(settings, "series_id").join(counts, "series_id").join(best.select("series_id", "n_windows"), "series_id", "left").join(bounds, "series_id").join(metric, "series_id")
    return rows.withColumns({
        "n_windows": F.coalesce("n_windows", F.lit(0)),
        "timeseries_path": F.concat(F.lit("by_category/"), where, F.lit("/timeseries.csv")),
        "labels_path": F.concat(F.lit("by_category/"), where, F.lit("/labels.csv")),
        "sigma2_path": F.concat(F.lit(f"{run}/"), where, F.lit("_sigma2_values.csv")),
        "figure_path": F.lit(None).cast("string"),
        "order": F.lit(str(tuple(how.order))),
    }).select(*METRICS)


def single_series(series: DataFrame, labels: DataFrame | None, how: Parameters = Parameters(order=(1, 0, 1))) -> tuple[DataFrame, DataFrame | None]:
    """Window results of one or more series, and the metric where there are labels; those without a labelled row are an error."""
    settings, results = scored_windows(series, labels, how)
    if labels is None or "is_anomaly" not in labels.columns:
        return results, None
    final = results.join(settings.select("series_id", F.when(F.col("seasonal_adjustment"), F.lit("transformed")).otherwise(F.lit("raw")).alias("branch")), ["series_id", "branch"], "left_semi")
    return results, localisation(final, labelled_bounds(labels), series)
