"""Preparation of a raw corpus, and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.scalar import dataset_folder, safe_name
from driftline.operators.evaluate import overall_summary, point_labels
from driftline.sources.corpus import decode_values, file_metadata, raw_file_names, read_category_map, read_raw_values, with_category
from driftline.sources.naming import write_named


def prepared(files: DataFrame, categories: DataFrame, values: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Catalog, series and labels of raw files (file_name, content); ``series_id`` is the folder of the dataset.

    With ``values`` (file_name, pos, time, value), as from ``read_raw_values``, no content is needed.
    """
    named = with_category(file_metadata(files), categories)
    catalog = named.withColumns({"series_id": dataset_folder(F.col("dataset_id"), F.col("dataset_name")), "folder": safe_name(F.col("category"))})
    rows = decode_values(files).withColumnRenamed("series_id", "file_name") if values is None else values
    series = rows.join(catalog.select("file_name", "series_id"), "file_name").drop("file_name")
    return catalog, series.select("series_id", "pos", "time", "value"), point_labels(series, catalog)


def prepare_corpus(spark: SparkSession, folder: str, category_csv: str, out: str, limit: int | None = None, layout: str = "parquet") -> DataFrame:
    """Reads raw files of any size, labels them and writes series and labels, partitioned by category and dataset; returns the catalog.

    ``layout`` is ``parquet``, or ``csv`` for by_category/<category>/<dataset>/timeseries.csv and labels.csv.
    """
    if layout not in ("parquet", "csv"):
        raise ValueError("layout must be 'parquet' or 'csv'")
    files = raw_file_names(spark, folder)
    if limit is not None:
        files = files.join(files.select("file_name").orderBy("file_name").limit(limit), "file_name", "left_semi")
    catalog, series, labels = prepared(files, read_category_map(spark, category_csv), read_raw_values(spark, folder))
    parts = catalog.select("series_id", F.col("folder").alias("category"), F.col("series_id").alias("dataset_name"))
    for rows, name, columns in ((series, "timeseries", ["time", "value"]), (labels, "labels", ["time", "is_anomaly", "anomaly_type"])):
        placed = rows.join(parts, "series_id")
        if layout == "csv":
            write_named(placed.select("category", "dataset_name", *columns), ["category", "dataset_name"], ["time"], f"{out}/by_category", lambda v, name=name: f"{v['category']}/{v['dataset_name']}/{name}.csv", label=name)
        else:
            placed = placed.repartition("category", "dataset_name").sortWithinPartitions("category", "dataset_name", "pos")
            placed.write.mode("overwrite").partitionBy("category", "dataset_name").parquet(f"{out}/{name}")
    return catalog


def write_window_results(results: DataFrame, path: str) -> None:
    """CSV files of window results, partitioned by category and dataset_name."""
    rows = results.select("category", "dataset_name", "time", "window_start", "window_end", "sigma2", "actual_anomaly", "predicted_anomaly")
    placed = rows.repartition("category", "dataset_name").sortWithinPartitions("category", "dataset_name", "window_end")
    placed.write.mode("overwrite").partitionBy("category", "dataset_name").csv(path, header=True)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A CSV file of metrics for each category, <category>/<category>_evaluation.csv; a null one is called nan."""
    named = metrics.withColumn("in_category", F.coalesce("category", F.lit("nan")))
    write_named(named, ["in_category"], ["category", "dataset_name"], path, lambda v: f"{v['in_category']}/{v['in_category']}_evaluation.csv")


def write_summary(metrics: DataFrame, path: str) -> None:
    """One CSV file of the name ``path``: the categories' rows, then the overall one."""
    base, _, name = path.rpartition("/")
    write_named(overall_summary(metrics), [], [], base or ".", lambda _: name, label=name)


def write_status(status: DataFrame, path: str) -> None:
    """One CSV file of the name ``path``: each dataset, whether it was scored, and why not."""
    base, _, name = path.rpartition("/")
    write_named(status.select("category", "dataset_name", "status", "reason").orderBy("category", "dataset_name"), [], [], base or ".", lambda _: name, label=name)


def write_run(metrics: DataFrame, path: str, run: str) -> None:
    """Adds the metrics of a run to a table of runs, a partition for each ``run_name``; an earlier run of that name is replaced, others stay."""
    named = metrics.withColumn("run_name", F.lit(run))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_name").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The metrics of all runs of a table, with ``run_name``."""
    found = spark.read.parquet(path)
    return found.withColumn("run_name", F.col("run_name").cast("string"))


def compare_runs(runs: DataFrame, first: str, second: str) -> DataFrame:
    """(category, n_both, n_first_only, n_second_only, both_right, first_right, second_right, neither_right, accuracy_change) of two runs.

    Datasets are matched by category and name; the first three columns count those that both runs have, or one. The others are about those that both have;
    a run's own hits exclude those of both. A null category is one.
    """
    sides = [F.max(F.when(F.col("run_name") == name, F.col("ucr_correct"))).alias(side) for name, side in ((first, "a"), (second, "b"))]
    pairs = runs.where(F.col("run_name").isin(first, second)).groupBy("category", "dataset_name").agg(*sides)

    def counted(a: int, b: int) -> Column:
        return F.count(F.when((F.col("a") == a) & (F.col("b") == b), 1))

    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return pairs.groupBy("category").agg(
        F.count(F.when(both, 1)).alias("n_both"),
        F.count(F.when(F.col("b").isNull(), 1)).alias("n_first_only"),
        F.count(F.when(F.col("a").isNull(), 1)).alias("n_second_only"),
        counted(1, 1).alias("both_right"),
        counted(1, 0).alias("first_right"),
        counted(0, 1).alias("second_right"),
        counted(0, 0).alias("neither_right"),
        F.avg(F.when(both, F.col("b") - F.col("a"))).alias("accuracy_change"),
    )


def output_paths(run: str, folder: str = "results", overall: str | None = None) -> dict[str, str]:
    """Where a run writes; an overall path that ends in .csv is used as it is, any other is a parent folder."""
    base = f"{folder}/{run}"
    if overall is None:
        last = f"{base}/overall_evaluation.csv"
    else:
        last = overall if overall.lower().endswith(".csv") else f"{overall}/{run}/overall_evaluation.csv"
    return {"run": base, "windows": f"{base}/windows", "metrics": f"{base}/metrics", "overall": last, "status": f"{base}/status.csv", "runs": f"{folder}/runs"}
