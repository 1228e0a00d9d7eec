"""Cutting the lineage of loops: tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_SETTING = "spark.checkpoint.dir"
_written: list[str] = []


def folder(spark) -> str:
    """The folder that the cluster names for checkpoints; without that setting (local
    runs) one of our own."""
    where = spark.conf.get(_SETTING, None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError(f"{_SETTING} must name a folder that all executors share")
        where = "file://" + (own := tempfile.mkdtemp(prefix="orbitalis-steps-"))
        spark.conf.set(_SETTING, where)
        atexit.register(shutil.rmtree, own, True)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written below the shared folder and read back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/orbitalis/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark) -> int:
    """Deletes this process's tables, once no result is to be read any more; how many there were."""
    n, jvm = len(_written), spark._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
