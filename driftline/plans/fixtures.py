"""Series, labels and catalogs that the registered queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.scalar import axis_time
from driftline.session import stored
from driftline.sources.naming import write_named
from driftline.sources.series import with_positions

PERIOD = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series for each type of event, in the order of time."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", "event_id", "value")
    placed = with_positions(rows, ["ts", "event_id"], "day")
    return placed.select("series_id", "pos", axis_time(F.col("pos")).alias("time"), "value")


def seasonal_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event series with a season of 24 rows."""
    wave = 200 * F.sin(2 * F.pi() * (F.col("pos") % PERIOD) / PERIOD)
    return event_series(spark, sf_dir).withColumn("value", F.col("value") + wave)


def gappy_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event series with every 17th value missing."""
    return event_series(spark, sf_dir).withColumn("value", F.when(F.col("pos") % 17 != 3, F.col("value")))


def event_labels(series: DataFrame) -> DataFrame:
    """A tenth of each series from its middle on is labelled, and its first quarter is for training."""
    return labelled(series).select("series_id", "pos", "time", "is_anomaly", "anomaly_type", "is_train")


def labelled(series: DataFrame) -> DataFrame:
    """The rows of the series with the columns of their labels."""
    sizes = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    half, tenth = F.expr("n div 2"), F.expr("n div 10")
    inside = F.col("pos").between(half, half + tenth - 1)
    rows = series.join(sizes, "series_id")
    return rows.select(
        "series_id", "pos", "time", "value", inside.cast("int").alias("is_anomaly"), F.when(inside, F.lit("burst")).otherwise(F.lit("normal")).alias("anomaly_type"), (F.col("pos") < F.expr("n div 4")).cast("int").alias("is_train")
    )


def fixed_settings(series: DataFrame, window_size: int = 50, stride: int = 12) -> DataFrame:
    return series.select("series_id").distinct().select("series_id", F.lit(window_size).alias("window_size"), F.lit(stride).alias("stride"))


def file_name() -> Column:
    """A raw file's name for each row of ``part``."""
    return F.format_string("%03d_UCR_Anomaly_%s_%d_%d_%d.txt", F.col("p_partkey"), F.concat("p_name", F.lit("+"), "p_brand"), F.col("p_size") * 10, F.col("p_size") * 20, F.col("p_size") * 30)


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("*", file_name().alias("file_name"))


def part_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category map with files that it lacks and files that it names twice."""
    files = part_files(spark, sf_dir)
    first = files.where("p_partkey % 3 != 0").select(F.col("file_name").alias("name"), F.col("p_type").alias("anomaly_type_2"), F.lit(0).alias("line_no"))
    again = files.where("p_partkey % 5 = 0").select(F.col("file_name").alias("name"), F.col("p_brand").alias("anomaly_type_2"), F.lit(1).alias("line_no"))
    return first.unionByName(again)


def event_catalog(series: DataFrame) -> DataFrame:
    """(series_id, category, dataset_name) of the event series."""
    kind = F.when(F.col("series_id").isin("view", "click"), F.lit("page")).when(F.col("series_id") == "error", F.lit("fault")).otherwise(F.lit("other"))
    return series.select("series_id").distinct().select("series_id", kind.alias("category"), F.concat(F.lit("ev_"), F.col("series_id")).alias("dataset_name"))


def order_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of hits for each order, a null category among them."""
    category = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(category.alias("category"), F.concat(F.lit("ds_"), "o_orderkey").alias("dataset_name"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("ucr_correct"))


#: Faults of the datasets of ``faulty_corpus``, by their number; the first has none.
FAULTS = ("none", "value_columns", "time", "no_labels", "no_is_anomaly", "no_labelled_row", "short", "labels_number")


def faulty_corpus(spark: SparkSession, sf_dir: str, out: str) -> None:
    """A prepared corpus of CSV files: each event series once for each fault, in a category of the fault's name."""
    series = stored(event_series(spark, sf_dir))
    once = stored(labelled(series).select(F.col("series_id").alias("dataset_name"), "pos", "time", "value", "is_anomaly"))
    rows = once.select(F.explode(F.array(*map(F.lit, FAULTS))).alias("category"), "*")
    keys, base, kind = ["category", "dataset_name"], f"{out}/by_category", F.col("category")

    def written(some: DataFrame, name: str) -> None:
        write_named(some, keys, ["time"], base, lambda v: f"{v['category']}/{v['dataset_name']}/{name}.csv", label=name)

    when = F.when((kind == "time") & (F.col("pos") == 7), F.lit("yesterday")).otherwise(F.col("time").cast("string"))
    written(rows.where((kind != "value_columns") & ((kind != "short") | (F.col("pos") < 40))).select(*keys, when.alias("time"), "value"), "timeseries")
    written(rows.where(kind == "value_columns").select(*keys, "time", (-F.col("value")).alias("other"), "value"), "timeseries")
    flag = F.when(kind == "labels_number", F.lit("yes")).when(kind == "no_labelled_row", F.lit("0")).otherwise(F.col("is_anomaly").cast("string"))
    written(rows.where(~kind.isin("no_labels", "no_is_anomaly")).select(*keys, "time", flag.alias("is_anomaly")), "labels")
    written(rows.where(kind == "no_is_anomaly").select(*keys, "time", F.lit("burst").alias("anomaly_type")), "labels")
