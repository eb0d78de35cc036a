"""What several corpus operators share: lineage cuts, even keys and salted lookups."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The two alphabets of ASCII case folding.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, as in local tests, a
    temporary folder of this machine takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    used = spark.sparkContext.getCheckpointDir()
    if used is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="driftline-"))
        used = spark.sparkContext.getCheckpointDir()
    return used


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that an operator wrote for itself."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def cut_by(df: DataFrame, n: int, key: str, then: Callable[[DataFrame], DataFrame] = lambda dealt: dealt) -> DataFrame:
    """``cut`` of ``df`` in ``n`` partitions by ``key``, which later groupings by ``key`` use as they are.

    ``then`` is applied to the dealt rows before they are written; it must keep ``key`` and the partitioning.

    A checkpoint keeps its partitioning only where the plan is fixed before it runs, so adaptive planning is
    off for this one exchange, whose number of partitions is given anyway.
    """
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(then(df.repartition(n, key)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: the one knob that follows the size of the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@lru_cache(maxsize=64)
def _even_keys(spark: SparkSession, n: int) -> tuple[int, ...]:
    found: dict[int, int] = {}
    size = 8 * n + 64
    while len(found) < n:
        rows = spark.range(size).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).agg(F.min("id").alias("id"))
        found = {r.p: r.id for r in rows.collect()}
        size *= 4
    return tuple(found[p] for p in range(n))


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` integers of which hash partitioning into ``n`` parts puts each in a part of its own.

    The driver gets ``n`` integers, one for each partition, whatever the size of the data.
    """
    return list(_even_keys(spark, n))


def salted_lookup(big: DataFrame, small: DataFrame, keys: list[str], spread: str, salts: int | None = None) -> DataFrame:
    """Left join of ``big`` with ``small`` (unique and non-null ``keys``) that survives a hot key.

    The rows of ``big`` are first reduced to distinct (keys, salt), the salt being a hash of
    ``spread``. Only these, ``salts`` rows for a key at most, meet ``small``; the rows themselves
    are joined on (keys, salt), so a key that holds a third of all rows is dealt over ``salts`` tasks: by default
    as many as there are shuffle partitions, 64 at least. ``big`` is read twice.
    """
    salts = max(64, partitions(big.sparkSession)) if salts is None else salts
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    leaves = salted.select(*keys, "_salt").distinct().join(small, keys, "left")
    return salted.join(leaves, [*keys, "_salt"], "left").drop("_salt")


#: Rows of a small table that may be broadcast.
BROADCAST_ROWS = 200_000


def near_lookup(big: DataFrame, small: DataFrame, keys: list[str], n: int, spread: str) -> DataFrame:
    """Left join of ``big`` with ``small`` of ``n`` rows: broadcast up to a checked size, salted beyond it."""
    return big.join(F.broadcast(small), keys, "left") if n <= BROADCAST_ROWS else salted_lookup(big, small, keys, spread)
