"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one serves a local
    master, whose executors are the driver; on a cluster that fails."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what is used twice is worked out once, and no executor's loss
    starts it again. The table goes when the session ends."""
    path = f"{shared_dir(df.sparkSession)}/notelake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, keys: list[str], sort: str) -> DataFrame:
    """``df`` appended to the table ``name`` in the shared folder, bucketed by ``keys`` and sorted by ``sort`` within a
    file: joins and groups by the keys read it without a shuffle. The first call makes the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/notelake-{name}"
    if not spark.catalog.tableExists(name):
        atexit.register(_drop, spark, path)
    df.write.mode("append").bucketBy(buckets, *keys).sortBy(sort).option("path", path).saveAsTable(name)
    return spark.table(name)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone; the folder's owner clears it
        pass
