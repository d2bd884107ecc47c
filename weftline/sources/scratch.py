"""The folder for tables and checkpoints that outlive a task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir, also set for checkpoint(); unset, a new local one in local mode and an error elsewhere."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftline-", dir="/tmp"))
    return sc.getCheckpointDir()


@contextmanager
def written(rows: DataFrame) -> Iterator[DataFrame]:
    """rows as a table of the shared folder, deleted at the end: for work that reads them many times and whose result does not."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    try:
        rows.write.parquet(path)
        yield spark.read.schema(rows.schema).parquet(path)
    finally:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
