"""Body tables derived from general tables, for tests and the query catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bodies_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From embeddings: positions and velocities are their first six numbers."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    part = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return e.select(F.col("vec_id").cast("long").alias("id"), (F.col("label") + 1).cast("double").alias("mass"), *(part(i).alias(c) for i, c in enumerate(("x", "y", "z", "vx", "vy", "vz"))))


def bodies_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From orders: many bodies of mixed mass at rest."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        F.col("o_orderkey").cast("long").alias("id"), (1 + F.col("o_custkey") % 7).cast("double").alias("mass"), F.col("o_totalprice").cast("double").alias("x"),
        (F.col("o_custkey") * 100).cast("double").alias("y"), ((F.col("o_orderkey") % 997) * 100).cast("double").alias("z"), *(F.lit(0.0).alias(v) for v in ("vx", "vy", "vz")),
    )


def elements_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From part: elliptic orbits around the Sun; every tenth is brightness only."""
    k, s = F.col("p_partkey"), F.col("p_size")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        ((s % 50) / 60.0).alias("e"), (1 + (k % 40) / 10.0).alias("a"), (k % 90).cast("double").alias("i"), (k % 360).cast("double").alias("om"), ((k * 7) % 360).cast("double").alias("w"),
        ((k * 13) % 360).cast("double").alias("ma"), (F.lit(2451544.5) - s).alias("epoch"), F.when(k % 10 == 0, 15.0 + s / 10.0).alias("H"), F.when(k % 10 == 0, 0.05 + (s % 5) / 10.0).alias("albedo"),
        F.lit(None).cast("double").alias("diameter"), F.when(k % 10 != 0, 1e20 * s).alias("mass"), F.lit("AST").alias("class"), F.concat(F.lit("part"), k % 1000).alias("name"), F.lit("Sun").alias("central_body"), k.cast("long").alias("row"),
    )
