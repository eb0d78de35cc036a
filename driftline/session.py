"""The package on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package's source to the executors once, so that Python tasks can import it wherever it lies."""
    context = spark.sparkContext
    if not getattr(context, "_driftline_shipped", False):
        here = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="driftline-")) / "driftline.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(here.rglob("*.py")):
                z.write(source, source.relative_to(here.parent))
        context.addPyFile(str(archive))
        context._driftline_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; where it is unset, one of this machine, in local mode only."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="driftline-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet, and read again: for tables that several steps read, each only some of the columns."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))  # whatever the columns are called
    plain.write.parquet(path)
    return df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*df.columns)
