"""Raw corpus files, category maps, and prepared corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftline.functions.scalar import axis_time, decoded_file_name, file_field
from driftline.session import checkpointed, stored
from driftline.sources.naming import exists, has_files, head_of
from driftline.sources.series import checked_mode, label_file_status, parsed_labels, parsed_series, read_labels, read_parsed_labels, read_series, series_file_status


def read_raw_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, content) of every raw file under ``folder``; none is an error."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", RAW).text(folder, wholetext=True)
    files = found.select(decoded_file_name(F.col("_metadata.file_name")).alias("file_name"), F.col("value").alias("content"))
    if files.select("file_name").isEmpty():
        raise FileNotFoundError(f"{folder} holds no raw corpus file")
    return files


def decode_values(files: DataFrame, key: str = "file_name", content: str = "content") -> DataFrame:
    """(series_id, pos, time, value) of texts of numbers divided by white space, in one line or many."""
    words = F.split(F.trim(F.regexp_replace(F.col(content), r"\s+", " ")), " ")
    rows = files.select(F.col(key).alias("series_id"), F.posexplode(words).alias("pos", "word"))
    pos = F.col("pos").cast("long")
    return rows.select("series_id", pos.alias("pos"), axis_time(pos).alias("time"), F.col("word").cast("double").alias("value"))


#: First bytes of a raw file that tell what divides its numbers.
HEAD = 4096
RAW = "*UCR_Anomaly*.txt"


def raw_file_names(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, path, n_bytes) of every raw file under ``folder``, without reading any; none is an error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", RAW).load(folder).select("path", F.col("length").alias("n_bytes"))
    files = found.select(decoded_file_name(F.substring_index("path", "/", -1)).alias("file_name"), "path", "n_bytes")
    if files.isEmpty():
        raise FileNotFoundError(f"{folder} holds no raw corpus file")
    return files


def divider(head: bytes) -> str:
    """The white space that divides most numbers at a file's beginning."""
    return max("\n \t", key=lambda c: head.count(c.encode()))


def read_raw_values(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, pos, time, value) of every raw file under ``folder``, as ``decode_values`` gives them, for files of any size.

    Files are read in ranges of bytes, a line of gigabytes too: what divides a file's numbers, which the driver sees in its first bytes (one call for each file), is what
    Spark ends its lines at, so a number that a range's edge cuts is read whole with the first part. The numbers of each range are counted, the counts summed up over a file's ranges,
    and numbers are placed by them; no task holds more than a range.
    """
    paths: dict[str, list[str]] = {}
    for file in raw_file_names(spark, folder).select("path").toLocalIterator():
        paths.setdefault(divider(head_of(spark, file.path, HEAD)), []).append(file.path)
    found = None
    for mark, own in sorted(paths.items()):
        text = spark.read.option("lineSep", mark).text(own)
        rows = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
        found = rows if found is None else found.unionByName(rows)
    words = found.select("path", "block", "at", F.posexplode(F.split("value", r"\s+")).alias("k", "word")).where("word <> ''")
    counts = words.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    here = F.row_number().over(W.partitionBy("path", "block").orderBy("at", "k")) - 1
    placed = words.withColumn("here", here).join(counts.select("path", "block", before.alias("before")), ["path", "block"])
    pos = (F.col("here") + F.col("before")).cast("long")
    name = decoded_file_name(F.substring_index("path", "/", -1))
    return placed.select(name.alias("file_name"), pos.alias("pos"), axis_time(pos).alias("time"), F.col("word").cast("double").alias("value"))


def file_metadata(files: DataFrame) -> DataFrame:
    """(file_name, dataset_id, dataset_name, train_end, anomaly_start, anomaly_end) from files' names."""
    name = F.col("file_name")
    whole = {"dataset_id": 1, "train_end": 3, "anomaly_start": 4, "anomaly_end": 5}
    fields = {k: file_field(name, g).cast("int") for k, g in whole.items()} | {"dataset_name": file_field(name, 2)}
    return files.select("file_name", *(fields[k].alias(k) for k in ("dataset_id", "dataset_name", "train_end", "anomaly_start", "anomaly_end")))


#: Columns that a category map needs.
MAP_COLUMNS = ["name", "anomaly_type_2"]


def checked_columns(columns: list[str]) -> None:
    """An error that lists the columns which a category map lacks."""
    missing = set(MAP_COLUMNS) - set(columns)
    if missing:
        raise ValueError(f"the category map lacks {', '.join(sorted(missing))}")


def last_of_name(categories: DataFrame) -> DataFrame:
    """(name, category): of rows with one name the last one counts. ``categories`` has name, anomaly_type_2, line_no."""
    latest = F.row_number().over(W.partitionBy("name").orderBy(F.desc("line_no")))
    return categories.withColumn("_k", latest).where("_k = 1").select("name", F.col("anomaly_type_2").alias("category"))


def read_category_map(spark: SparkSession, path: str) -> DataFrame:
    """(name, category) from a CSV file divided by semicolons."""
    found = spark.read.csv(path, sep=";", header=True)
    checked_columns(found.columns)
    return last_of_name(found.select("name", "anomaly_type_2").withColumn("line_no", F.monotonically_increasing_id()))


def with_category(catalog: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds each file's category, ``unknown`` if the map doesn't name it."""
    named = categories.withColumnRenamed("name", "file_name")
    return catalog.join(named, "file_name", "left").withColumn("category", F.coalesce("category", F.lit("unknown")))


def labelled_only(series: DataFrame, labels: DataFrame) -> DataFrame:
    """The series that have labels."""
    return series.join(labels.select("series_id").distinct(), "series_id", "left_semi")


def first_datasets(catalog: DataFrame, n: int, path: str = "file_name") -> DataFrame:
    """The first ``n`` datasets in the order of their paths."""
    return catalog.orderBy(path).limit(n)


def read_prepared(spark: SparkSession, folder: str, on_error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Series and labels of a prepared corpus, each with category and dataset_name; series without labels are left out.

    Both layouts of ``plans.corpus.prepare_corpus`` are read: Parquet, and by_category/<category>/<dataset>/timeseries.csv with labels.csv. In
    the latter ``series_id`` is <category>/<dataset>, since two categories may have datasets of one name. Each file is read by its own header; one that
    can't be read is an error, or left out with ``on_error="skip"`` (see ``prepared_status``).
    """
    if checked_mode(on_error) == "skip":
        return read_prepared_status(spark, folder)[:2]
    if exists(spark, f"{folder}/by_category"):
        _check_files(spark, folder)
        series, labels = _placed(read_series(spark, _SERIES.format(folder))), _placed(read_labels(spark, _LABELS.format(folder)))
    else:
        series, labels = spark.read.parquet(f"{folder}/timeseries"), spark.read.parquet(f"{folder}/labels")
    kept = labelled_only(series, labels)
    if kept.select("series_id").isEmpty():
        raise FileNotFoundError(f"{folder} holds no prepared dataset with labels")
    return kept, labels


def _check_files(spark: SparkSession, folder: str) -> None:
    if not (has_files(spark, _SERIES.format(folder)) and has_files(spark, _LABELS.format(folder))):
        raise FileNotFoundError(f"{folder} holds no prepared dataset with labels")


def read_prepared_status(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``read_prepared`` with ``on_error="skip"`` and ``prepared_status`` give: series, labels, and the status of each dataset.

    Each CSV file is parsed once, for its rows and for its status, and what is kept of it is numbered and stored once, whatever reads it later.
    """
    if not exists(spark, f"{folder}/by_category"):
        return *read_prepared(spark, folder), prepared_status(spark, folder)
    _check_files(spark, folder)
    series, labels = parsed_series(spark, _SERIES.format(folder)), parsed_labels(spark, _LABELS.format(folder))
    marks = stored(read_parsed_labels(labels, _placed(labels.good())))
    names = checkpointed(labelled_only(_placed(series.good()), marks))
    if names.isEmpty():
        raise FileNotFoundError(f"{folder} holds no prepared dataset with labels")
    return stored(series.read(names)), marks, _merged_status(_placed(series.status.drop("_file")), _placed(labels.status.drop("_file")))


_SERIES, _LABELS = "{}/by_category/*/*/timeseries.csv", "{}/by_category/*/*/labels.csv"


def prepared_status(spark: SparkSession, folder: str) -> DataFrame:
    """(series_id, category, dataset_name, reason) of each dataset of a prepared corpus: why its files can't be read, null where they can.

    The reasons of ``series_file_status`` and, for the labels, ``label_file_status``; ``no_series`` and ``no_labels`` where a file is missing.
    """
    if exists(spark, f"{folder}/by_category"):
        series, labels = _placed(series_file_status(spark, _SERIES.format(folder))), _placed(label_file_status(spark, _LABELS.format(folder)))
    else:
        names = ["series_id", "category", "dataset_name"]
        series, labels = (spark.read.parquet(f"{folder}/{n}").select(*names).distinct().withColumn("reason", F.lit(None).cast("string")) for n in ("timeseries", "labels"))
    return _merged_status(series, labels)


def _merged_status(series: DataFrame, labels: DataFrame) -> DataFrame:
    """The status of datasets from that of their files (series_id, category, dataset_name, reason)."""
    label_reason = F.when(F.col("reason") == "no_is_anomaly", F.col("reason")).otherwise(F.concat(F.lit("labels_"), "reason"))
    labels = labels.withColumn("reason", label_reason)
    both = series.withColumn("has_series", F.lit(True)).join(labels.withColumn("has_labels", F.lit(True)).withColumnRenamed("reason", "of_labels"), ["series_id", "category", "dataset_name"], "full")
    missing = F.when(F.col("has_series").isNull(), F.lit("no_series")).when(F.col("has_labels").isNull(), F.lit("no_labels"))
    return both.select("series_id", "category", "dataset_name", F.coalesce("reason", missing, "of_labels").alias("reason"))


def _placed(rows: DataFrame) -> DataFrame:
    """Category and dataset from the last folders of a file's path, which is the series' identifier so far."""
    parts = F.split("series_id", "/")
    category, dataset = (F.url_decode(F.replace(F.element_at(parts, k), F.lit("+"), F.lit("%2B"))) for k in (-3, -2))
    return rows.withColumns({"category": category, "dataset_name": dataset}).withColumn("series_id", F.concat("category", F.lit("/"), "dataset_name"))
