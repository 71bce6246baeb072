"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset, in local mode, a temporary folder, which is then set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="missive-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table: what reads it plans from the table on, and a lost executor costs its tasks only."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/missive-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared ones."""
    with suppress(Exception):  # the session may be gone
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def removed(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing reads any more; other frames stay as they are."""
    if path := getattr(df, "_written_at", None):
        remove_path(df.sparkSession, path)
