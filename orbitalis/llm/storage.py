"""Shared scratch tables: how these operators cut lineage.

A scratch table is a Parquet folder below ``spark.checkpoint.dir``, which all
executors share, so that a lost executor costs no recomputation.  Only where
that setting is missing (tests, local runs) a folder of our own is set.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from orbitalis.llm.textkernel import release

_SETTING = "spark.checkpoint.dir"
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints."""
    where = spark.conf.get(_SETTING, None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError(f"{_SETTING} must name a folder that all executors share")
        where = "file://" + (own := tempfile.mkdtemp(prefix="orbitalis-scratch-"))
        spark.conf.set(_SETTING, where)
        atexit.register(shutil.rmtree, own, True)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch table and read back with its own schema."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_folder(spark)}/orbitalis/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _written.append(path.rsplit("/", 1)[0])
    gc.collect()  # plans that only cycles of the driver's objects still hold
    release()
    return spark.read.schema(df.schema).parquet(path)


def row_key(df: DataFrame) -> tuple[DataFrame, Column]:
    """df and a column that tells its rows apart, whatever else they have in common.

    For a table that is read from Parquet files: (a hash of the file's path, the
    row's number in the file), which needs no pass and stays the same however often and
    in whatever splits the files are read.  Any other df is written once, with a
    number.  The column is a struct of two longs.
    """
    if df._jdf.queryExecution().analyzed().nodeName().startswith("LogicalRelation") and df._jdf.queryExecution().analyzed().toString().rstrip().endswith("parquet"):
        at = df.metadataColumn("_metadata")
        return df, F.struct(F.xxhash64(at["file_path"]).alias("f"), at["row_index"].alias("i"))
    name = "_row_key"
    while name in df.columns:
        name += "_"
    fixed = materialize(df.withColumn(name, F.monotonically_increasing_id()), "rows")
    return fixed, F.struct(F.lit(0).cast("long").alias("f"), F.col(name).alias("i"))


def clear(spark: SparkSession) -> int:
    """Deletes this process's scratch tables, once no result is to be read any more;
    how many there were."""
    n, jvm = len(_written), spark._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def map_rows(df: DataFrame, run, schema: StructType | None = None) -> DataFrame:
    """df.mapInArrow with plain column names inside, as mapInArrow takes no name with a
    dot; the result has df's names (and those of schema's types, else df's)."""
    plain = [f"c{i}" for i in range(len(df.columns))]
    fields = (schema or df.schema).fields
    return df.toDF(*plain).mapInArrow(run, StructType([StructField(c, f.dataType, f.nullable) for c, f in zip(plain, fields, strict=True)])).toDF(*df.columns)


_BATCH_SETTING, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lets Python workers get texts in batches of a few MB, however long they are;
    Spark's own bound is 64 MB, and a smaller one stays."""
    now = spark.conf.get(_BATCH_SETTING, "64m").lower().rstrip("b")
    size = int(now[:-1]) << {"k": 10, "m": 20, "g": 30}[now[-1]] if now[-1:] in "kmg" else int(now)
    if size <= 0 or size > _BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(_BATCH_BYTES))


def input_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
