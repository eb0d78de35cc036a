"""Series and labels from files and tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftline.functions.scalar import numeric
from driftline.session import checkpointed, stored
from driftline.sources.headers import BROADCAST_FILES, checked, read_files, unread
from driftline.sources.naming import exists


def with_positions(rows: DataFrame, order: list[str], block: str = "hour") -> DataFrame:
    """Adds ``pos``, each row's place in its series by ``order`` (its first column is the time), from 0.

    Series are numbered by blocks of time, whose sizes are summed up, so no task sorts a whole series.
    """
    cut = F.date_trunc(block, order[0])
    keyed = rows.withColumn("_block", F.coalesce(cut, F.lit("0001-01-01").cast("timestamp")))
    sizes = keyed.groupBy("series_id", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("series_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("series_id", "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    here = F.row_number().over(W.partitionBy("series_id", "_block").orderBy(*order)) - 1
    return keyed.withColumn("_here", here).join(offsets, ["series_id", "_block"]).withColumn("pos", (F.col("_here") + F.col("_before")).cast("long")).drop("_block", "_here", "_before", "_n")


def compact(series: DataFrame, block: int = 65_536) -> DataFrame:
    """The rows of ``series`` that have a value, with ``cpos``, their place among them, and ``m``, their number.

    Numbered by blocks of positions, like ``with_positions``.
    """
    keyed = series.where(F.col("value").isNotNull()).withColumn("_block", F.floor(F.col("pos") / block))
    keys = [c for c in ("series_id", "branch") if c in series.columns]
    sizes = keyed.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    by = W.partitionBy(*keys)
    before = F.sum("_n").over(by.orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(*keys, "_block", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(by).alias("m"))
    here = F.row_number().over(W.partitionBy(*keys, "_block").orderBy("pos")) - 1
    return keyed.withColumn("_here", here).join(offsets, [*keys, "_block"]).withColumn("cpos", F.col("_here") + F.col("_before")).drop("_block", "_here", "_before")


def _time(cell: Column) -> Column:
    return cell.try_cast("timestamp_ntz")


@dataclass
class Parsed:
    """CSV files parsed once: ``rows`` (_file, time, values) of all files, and ``status`` (_file, series_id, reason) of each of the ``n`` files."""

    rows: DataFrame
    status: DataFrame
    n: int

    def good(self) -> DataFrame:
        """(_file, series_id) of the files that can be read."""
        return self.status.where("reason IS NULL").select("_file", "series_id")

    def read(self, names: DataFrame) -> DataFrame:
        """The rows of the files of ``names`` (_file, series_id and whatever else the rows are to have), with ``pos``.

        Rows are numbered by the files' numbers, and get the names last, so no path is shuffled or sorted with every row.
        """
        few = F.broadcast if self.n <= BROADCAST_FILES else lambda df: df
        own = self.rows.join(few(names.select("_file")), "_file", "left_semi")
        placed = with_positions(own.withColumnRenamed("_file", "series_id"), ["time"]).withColumnRenamed("series_id", "_file")
        also = [c for c in names.columns if c not in ("_file", "series_id")]
        return placed.join(few(names), "_file").select("series_id", *(c for c in placed.columns if c != "_file"), *also)


def _parsed(headers: DataFrame, rows: DataFrame, reason: Column) -> Parsed:
    """Stores the rows, of which ``_bad`` tells those with a cell that isn't a number, and works out the files' status from them."""
    rows = stored(rows)
    return Parsed(rows.drop("_bad"), checkpointed(_status(headers, rows, reason)), headers.count())


def _status(headers: DataFrame, rows: DataFrame, reason: Column) -> DataFrame:
    found = rows.groupBy("_file").agg(F.bool_or(F.col("time").isNull()).alias("bad_time"), F.bool_or("_bad").alias("bad_number"))
    return headers.join(found, "_file", "left").select("_file", F.col("file_path").alias("series_id"), reason.alias("reason"))


def _series_cells(spark: SparkSession, path: str, coerce: bool) -> tuple[DataFrame, DataFrame, Column]:
    """Headers, rows (_file, time, value, _bad) and reasons of series files."""
    files = read_files(spark, path, width=2, by_name=False, numbered=True)
    time, value = (F.col("cells")[k] for k in (0, 1))
    number = numeric(value) if coerce else value.try_cast("double")
    bad = F.lit(False) if coerce else unread(value.try_cast("double"), value)
    reason = F.when(F.size("names") != 2, F.lit("value_columns")).when(F.col("bad_time"), F.lit("time")).when(F.col("bad_number"), F.lit("number"))
    return files.headers, files.rows.select("_file", _time(time).alias("time"), number.alias("value"), bad.alias("_bad")), reason


def parsed_series(spark: SparkSession, path: str, coerce: bool = True) -> Parsed:
    """Series files parsed once, for both their rows and their status (see ``series_file_status``)."""
    return _parsed(*_series_cells(spark, path, coerce))


def series_file_status(spark: SparkSession, path: str, coerce: bool = True) -> DataFrame:
    """(series_id, reason): why a file below ``path`` can't be read as a series, null where it can.

    ``value_columns``: it hasn't a time and one further column. ``time``: a time can't be read. ``number``: a cell isn't a number, where that counts.
    """
    return _status(*_series_cells(spark, path, coerce)).drop("_file")


def checked_mode(on_error: str) -> str:
    if on_error not in ("error", "skip"):
        raise ValueError("on_error must be 'error' or 'skip'")
    return on_error


def read_series(spark: SparkSession, path: str, coerce: bool = True, on_error: str = "error") -> DataFrame:
    """(series_id, pos, time, value) from CSV files with a header, a first column of times and one further column.

    ``series_id`` is a file's path. Every file is read by its own header. With ``coerce`` cells that aren't numbers become null, else they are an
    error. A file with another number of columns, or a time that can't be read, is an error that names it; with ``on_error="skip"`` such files are
    left out, and ``series_file_status`` tells why.
    """
    if checked_mode(on_error) == "skip":
        found = parsed_series(spark, path, coerce)
        return found.read(found.good()).select("series_id", "pos", "time", "value")
    files = read_files(spark, path, by_name=False)
    other = files.headers.where(F.size("names") != 2).orderBy("file_path").first()
    if other is not None:
        raise ValueError(f"{other.file_path}: a series file has a time and one further column, not {', '.join(other.names)}")
    rows, (time, value) = files.rows, (F.col("cells")[k] for k in (0, 1))
    at = checked(_time(time), F.coalesce(time, F.lit("no time")), "a time", "timestamp_ntz")
    number = numeric(value) if coerce else checked(value.try_cast("double"), value, "a number", "double")
    return with_positions(rows.select(F.col("file_path").alias("series_id"), at.alias("time"), number.alias("value")), ["time"]).select("series_id", "pos", "time", "value")


#: Kinds of the label columns that have one.
LABEL_KINDS = {"is_anomaly": "int", "is_train": "int"}


def _label_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, Column]:
    """Headers, rows (_file, time, the columns, _bad) and reasons of label files. The columns of ``LABEL_KINDS`` are doubles still."""
    files = read_files(spark, path, numbered=True)
    bad = F.lit(False)
    for cell in map(files.cell, LABEL_KINDS):
        bad = bad | F.coalesce(unread(cell.try_cast("double"), cell), F.lit(False))
    columns = [(files.cell(k).try_cast("double") if k in LABEL_KINDS else files.cell(k)).alias(k) for k in files.columns()]
    lacks = ~F.array_contains(F.slice("names", 2, 1 << 20), "is_anomaly")
    reason = F.when(lacks, F.lit("no_is_anomaly")).when(F.col("bad_time"), F.lit("time")).when(F.col("bad_number"), F.lit("number"))
    return files.headers, files.rows.select("_file", _time(F.col("cells")[0]).alias("time"), *columns, bad.alias("_bad")), reason


def parsed_labels(spark: SparkSession, path: str) -> Parsed:
    """Label files parsed once, for both their rows and their status (see ``label_file_status``)."""
    return _parsed(*_label_cells(spark, path))


def read_parsed_labels(found: Parsed, names: DataFrame) -> DataFrame:
    """``Parsed.read`` of labels, the columns of ``LABEL_KINDS`` as whole numbers."""
    rows = found.read(names)
    return rows.withColumns({k: F.col(k).cast(kind) for k, kind in LABEL_KINDS.items() if k in rows.columns})


def label_file_status(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, reason): why a file below ``path`` can't be read as labels: ``no_is_anomaly``, ``time`` or ``number``; null where it can."""
    return _status(*_label_cells(spark, path)).drop("_file")


def read_labels(spark: SparkSession, path: str | None, on_error: str = "error") -> DataFrame | None:
    """Labels from CSV files, with whatever columns they have after the time; None if there is no path or nothing at it.

    Each file's columns are found by the names in its own header, in whatever order; a column that a file lacks is null in its rows. A cell that can't be
    read is an error that names the file; with ``on_error="skip"`` files with such a cell, or without is_anomaly, are left out.
    """
    skip = checked_mode(on_error) == "skip"
    if path is None:
        return None
    if "*" not in path and not exists(spark, path):
        return None
    if skip:
        found = parsed_labels(spark, path)
        return read_parsed_labels(found, found.good())
    files = read_files(spark, path)
    rows, time = files.rows, F.col("cells")[0]

    def column(name: str) -> Column:
        cell = files.cell(name)
        return checked(cell.try_cast("double"), cell, f"a number ({name})", "double").cast(LABEL_KINDS[name]) if name in LABEL_KINDS else cell

    at = checked(_time(time), F.coalesce(time, F.lit("no time")), "a time", "timestamp_ntz")
    return with_positions(rows.select(F.col("file_path").alias("series_id"), at.alias("time"), *(column(k).alias(k) for k in files.columns())), ["time"])


def read_periods(spark: SparkSession, path: str) -> DataFrame:
    """The curated periods: dataset_idx, period, remarks."""
    return spark.read.csv(path, header=True, schema="dataset_idx int, period int, remarks string")
