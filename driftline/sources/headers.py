"""CSV files read by their own headers: each file's columns are found by the names in its first line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import checkpointed

#: Files whose headers may be broadcast to the rows; beyond it they are joined by a shuffle.
BROADCAST_FILES = 100_000
#: A cell that no file has, so that empty cells differ from missing ones.
_NEVER = "\u0000"


def missing_columns(headers: DataFrame, needed: list[str]) -> DataFrame:
    """(file_path, missing): the files (file_path, names) that lack any of the columns ``needed``, and which, in alphabetical order."""
    lacks = F.array_sort(F.array_except(F.array(*map(F.lit, needed)), "names"))
    return headers.select("file_path", lacks.alias("missing")).where(F.size("missing") > 0)


def file_headers(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(file_path, names): the names in the first line of each file that isn't blank. Files without one are left out.

    One row for each file; a task keeps only the first line of each of its files, so nothing else is shuffled.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    opening = lines.where("block = 0 AND trim(line) <> ''").withColumn("at", F.monotonically_increasing_id())
    first = opening.groupBy("file_path").agg(F.min_by("line", "at").alias("line"))
    first = checkpointed(first.select("file_path", F.ltrim(F.col("line"), F.lit("﻿")).alias("line")))
    widest = first.agg(F.max(F.size(F.split("line", sep)))).first()[0] or 1
    schema = ", ".join(f"c{k} string" for k in range(widest))
    cells = F.from_csv("line", schema, {"nullValue": _NEVER, "sep": sep})
    names = F.filter(F.array(*(cells[f"c{k}"] for k in range(widest))), lambda name: name.isNotNull())
    return first.select("file_path", F.transform(names, F.trim).alias("names"))


@dataclass
class Files:
    """``rows`` has file_path and cells, and names where headers differ; ``headers`` a row for each file; ``layouts`` the different lists of names."""

    rows: DataFrame
    headers: DataFrame
    layouts: list[list[str]]

    def columns(self) -> list[str]:
        """All names behind the first column, in the order in which they are first met."""
        return list(dict.fromkeys(name for names in self.layouts for name in names[1:]))

    def cell(self, name: str) -> Column:
        """The cell of a row under a name, wherever the row's file has it; null where it has none. Of equal names the first counts."""
        if len(self.layouts) == 1:
            names = self.layouts[0]
            return F.col("cells")[names.index(name, 1)] if name in names[1:] else F.lit(None).cast("string")
        place = F.array_position(F.slice("names", 2, 1 << 20), name)
        return F.when(place > 0, F.get("cells", place.cast("int")))


def read_files(spark: SparkSession, path: str, width: int | None = None, by_name: bool = True, numbered: bool = False) -> Files:
    """The rows of CSV files below ``path`` as cells.

    ``width`` leaves out files of another number of columns. ``by_name`` gives rows the names of their files where headers differ. The driver
    gets one list of names for each different header, not for each file; where all are the same no row is joined with its header. ``numbered`` gives
    rows and headers ``_file``, a number that is shorter than the path.
    """
    headers = checkpointed(file_headers(spark, path).withColumn("_file", F.monotonically_increasing_id()))
    kept = headers if width is None else headers.where(F.size("names") == width)
    layouts = [list(r.names) for r in kept.select("names").distinct().orderBy(F.desc(F.size("names")), "names").collect()]
    widest = max(map(len, layouts), default=1)
    schema = ", ".join(f"c{k} string" for k in range(widest))
    found = spark.read.option("recursiveFileLookup", True).csv(path, header=True, schema=schema)
    rows = found.select(F.col("_metadata.file_path").alias("file_path"), F.array(*(f"c{k}" for k in range(widest))).alias("cells"))
    n = kept.count()
    if numbered or (by_name and len(layouts) != 1) or n < headers.count():
        rows = rows.join(F.broadcast(kept) if n <= BROADCAST_FILES else kept, "file_path")
    return Files(rows, headers, layouts)


def unread(value: Column, cell: Column) -> Column:
    """Whether there is a cell, but it gave no value."""
    return value.isNull() & (F.trim(cell) != "")


def checked(value: Column, cell: Column, what: str, kind: str) -> Column:
    """``value``, or an error that names the file and the cell if the cell couldn't be read."""
    wrong = F.raise_error(F.concat(F.col("file_path"), F.lit(f": not {what}: "), cell)).cast(kind)
    return F.when(unread(value, cell), wrong).otherwise(value)
