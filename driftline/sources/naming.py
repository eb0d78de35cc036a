"""Files of given names: Spark writes its part files to a folder aside, and the driver moves each to its name."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    """A path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _at(spark, path)
    return files.exists(where)


def has_files(spark: SparkSession, pattern: str) -> bool:
    """Whether any file matches a pattern."""
    where, files = _at(spark, pattern)
    found = files.globStatus(where)
    return found is not None and len(found) > 0


def head_of(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file."""
    where, files = _at(spark, path)
    stream = files.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def part_files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """The part files below a folder: their paths and sizes in bytes."""
    where, files = _at(spark, folder)
    found, each = [], files.listFiles(where, True)
    while each.hasNext():
        status = each.next()
        path = status.getPath()
        if path.getName().startswith("part-"):
            found.append((path.toString(), status.getLen()))
    return sorted(found)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Moves a file, over an older one if there is one."""
    where, files = _at(spark, target)
    files.mkdirs(where.getParent())
    files.delete(where, False)
    if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(source), where):
        raise OSError(f"couldn't move {source} to {target}")


@dataclass(frozen=True)
class Named:
    """A file that was written: its name below the folder, the part file it comes from, its rows and bytes."""

    name: str
    source: str
    n_rows: int
    n_bytes: int


def listed(spark: SparkSession, aside: str, base: str, name: Callable[[dict[str, str]], str], kind: str, header: bool, line_end: str = "\n") -> list[Named]:
    """The part files below ``aside`` with the names that they are to have, and their rows, counted by reading them once.

    A name that is met twice is an error.
    """
    unquote = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    sizes = part_files(spark, aside)
    reader = spark.read.option("recursiveFileLookup", True)
    plain = spark._jvm.org.apache.hadoop.fs.Path

    def counted(found: DataFrame, *also: Column) -> list[tuple[str, Row]]:
        rows = found.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n"), *also).collect()
        return [(plain(spark._jvm.java.net.URI(r.path)).toString(), r) for r in rows]

    counts: dict[str, int] = {}
    if any(n for _, n in sizes) and kind == "text":
        counts = {path: r.n for path, r in counted(reader.text(aside, lineSep=line_end))}
    elif any(n for _, n in sizes):
        # where quotes are closed within each line, lines are rows, and files are counted in ranges; others are parsed, each by one task
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        broken = F.bool_or((quotes % 2 == 1) | ((quotes > 0) & F.contains("value", F.lit("\\"))))
        lines = counted(reader.text(aside, lineSep="\n").where("value <> ''"), broken.alias("broken"))
        counts = {path: r.n - header for path, r in lines}
        if parsed := [path for path, r in lines if r.broken]:
            counts |= dict.fromkeys(parsed, 0) | {path: r.n for path, r in counted(reader.csv(parsed, header=header, schema="c0 string", multiLine=True))}
    out, seen = [], {}
    for path, size in sizes:
        values = dict(p.split("=", 1) for p in path[path.index("/_aside") + 1 :].split("/")[1:-1])
        target = name({k: unquote(v) for k, v in values.items()})
        if target in seen:
            raise ValueError(f"two files would be called {base}/{target}: {seen[target]} and {path}")
        seen[target] = path
        out.append(Named(target, path, counts.get(path, 0), size))
    return out


def write_named(rows: DataFrame, keys: list[str], order: list[str], base: str, name: Callable[[dict[str, str]], str], kind: str = "csv", header: bool = True, label: str = "files", line_end: str = "\n") -> list[Named]:
    """Writes the rows of each combination of ``keys`` to one file, ``base`` and what ``name`` makes of the keys' values, and a manifest.

    The keys aren't columns of the files, nor is ``order`` one of text files. Files are published in two steps. First all are written to a folder aside, listed, and
    their rows counted: if a name is met twice, that is an error and nothing at ``base`` has changed. Then each is moved to its name, over an older file of that name,
    and last the manifest is written, ``base``/_manifest/``label``, which ``read_manifest`` reads. Each file is written by one task, as its format demands; the driver moves files, one call for
    each, and never reads them.
    """
    spark = rows.sparkSession
    base = base.rstrip("/")
    aside = f"{base}/_aside-{uuid.uuid4().hex}"
    # dealt by an expression of its own: by the bare keys, a join on them below would stand in for this exchange, and once adaptive planning broadcasts that join, its rows stay where they are
    placed = rows.repartition(F.struct(F.lit(label), *keys)).sortWithinPartitions(*keys, *order) if keys else rows.coalesce(1)
    if kind == "text":  # one column of lines
        placed = placed.drop(*order)
    # whatever the session says: a file of a given name can't be several
    writer = placed.write.mode("overwrite").option("maxRecordsPerFile", 0)
    writer = writer.partitionBy(*keys) if keys else writer
    writer.text(aside, lineSep=line_end) if kind == "text" else writer.csv(aside, header=header)
    try:
        found = listed(spark, aside, base, name, kind, header, line_end)
        for file in found:
            move(spark, file.source, f"{base}/{file.name}")
    finally:
        where, files = _at(spark, aside)
        files.delete(where, True)
    manifest = spark.createDataFrame([(f.name, f.n_rows, f.n_bytes) for f in found], MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{base}/_manifest/{label}")
    return found


MANIFEST = "name string, n_rows long, n_bytes long"


def read_manifest(spark: SparkSession, base: str, label: str = "files") -> DataFrame:
    """(name, n_rows, n_bytes) of the files that the last ``write_named`` of that label published at ``base``."""
    return spark.read.schema(MANIFEST).parquet(f"{base.rstrip('/')}/_manifest/{label}")


def missing_files(spark: SparkSession, base: str, label: str = "files") -> list[str]:
    """Names of the manifest whose files aren't there, or have another size: an unfinished or damaged publication."""
    out = []
    for file in read_manifest(spark, base, label).orderBy("name").toLocalIterator():
        where, files = _at(spark, f"{base.rstrip('/')}/{file.name}")
        if not files.exists(where) or files.getFileStatus(where).getLen() != file.n_bytes:
            out.append(file.name)
    return out
