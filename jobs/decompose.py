"""From a raw catalogue to bodies in key order, dealt to parts of equal size.

    python -m jobs.decompose SOURCE OUT [--config FILE]

Reads any table that has what a body needs, sets aside what isn't a body, and
writes below OUT

- rejected: reason (a partition), id and how many rows; bodies whose id stands
  more than once are kept once (the smallest in mass, x, y and so on)
- cells: the cells of the tree, by depth (a partition)
- bodies: in key order, with key, leaf and part (a partition)
- parts: for each part its number of bodies, mass, box and range of keys

All of it depends on the source alone, and each run replaces what an earlier one
has left, so a run may be repeated at any time.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, configured, rows_of, settings
from orbitalis.functions import keys
from orbitalis.operators import key_ranges, partition
from orbitalis.operators.domain import Domain, cubic_domain, keyed
from orbitalis.operators.scratch import cut

log = logging.getLogger("jobs.decompose")
_NUMBERS = ("mass", "x", "y", "z", "vx", "vy", "vz")


def mapped(raw: DataFrame, body: dict[str, str]) -> DataFrame:
    """The source's rows as bodies, with the reason why a row is none."""
    rows = raw.select(F.expr(body["id"]).cast("long").alias("id"), *(F.expr(body[c]).cast("double").alias(c) for c in _NUMBERS))
    finite = F.lit(True)
    for c in _NUMBERS:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    wrong = F.when(F.col("id").isNull() | (F.col("id") < 0), "id").when(~finite, "not finite").when(~(F.col("mass") > 0), "mass")
    return rows.withColumn("reason", wrong)


def run(spark: SparkSession, source: str, out: str, config: dict | None = None) -> dict[str, int]:
    """Decomposes the table at a path; how many rows were read and written where."""
    config = config or configured(__file__)
    raw = spark.read.load(source, format=config["format"], **({"header": True, "inferSchema": True} if config["format"] == "csv" else {}))
    rows = mapped(raw, config["body"])
    n = rows_of(raw, log, "read", source)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // key_ranges.PER_RANGE))
    # what a task sorts or groups stays in its memory; and rows that are in order when written aren't sorted again
    small = {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.files.maxPartitionBytes": "32m", "spark.sql.maxConcurrentOutputFileWriters": "32"}
    with settings(spark, small):
        return {"read": n} | _decomposed(spark, rows, out, config)


def _decomposed(spark: SparkSession, rows: DataFrame, out: str, config: dict) -> dict[str, int]:
    done = {}
    # one row for each id, however many there were: copies meet as partial minima, not as rows
    once = cut(rows.where("reason is null").groupBy("id").agg(F.min(F.struct(*_NUMBERS)).alias("b"), F.count("*").alias("n")))
    aside = rows.where("reason is not null").groupBy("reason", "id").agg(F.count("*").alias("n"))
    aside = aside.unionByName(once.where("n > 1").select(F.lit("repeated id").alias("reason"), "id", (F.col("n") - 1).alias("n")))
    path = f"{out}/rejected"
    aside.write.mode("overwrite").partitionBy("reason").parquet(path)
    done["rejected"] = rows_of(spark.read.schema("id long, n long, reason string").parquet(path), log, "wrote", path)  # it may be empty

    bodies = once.select("id", "b.*")
    domain = cubic_domain(bodies)
    cuts = partition.splitters(partition.key_histogram(keyed(bodies, domain), config["bits"]), config["parts"])
    bucket = F.shiftright("key", keys.KEY_BITS - config["bits"])
    placed = key_ranges.with_leaf_depth(bodies, domain, bodies.count(), config["leaf_size"])
    placed = placed.withColumn("leaf_prefix", keys.prefix_at(F.col("key"), F.col("leaf_depth"))).withColumn("bucket", bucket)
    partition.assign_parts(placed, cuts).drop("bucket").write.mode("overwrite").partitionBy("part").parquet(f"{out}/bodies")
    written = read(spark, out)
    done["bodies"] = rows_of(written, log, "wrote", f"{out}/bodies")

    cells_of(written, domain).repartitionByRange("depth", "prefix").write.mode("overwrite").partitionBy("depth").parquet(f"{out}/cells")
    done["cells"] = rows_of(spark.read.schema(CELLS).parquet(f"{out}/cells"), log, "wrote", f"{out}/cells")

    box = [f(c).alias(n + c) for f, n in ((F.min, "l"), (F.max, "h")) for c in "xyz"]
    parts = written.groupBy("part").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), *box)
    parts.coalesce(1).write.mode("overwrite").parquet(f"{out}/parts")
    done["parts"] = rows_of(spark.read.schema(parts.schema).parquet(f"{out}/parts"), log, "wrote", f"{out}/parts")
    return done


def cells_of(bodies: DataFrame, domain: Domain) -> DataFrame:
    """The tree's cells: sums of the bodies whose leaf is the cell or lies in it.  Bodies
    are read in key order, so a task sums nearly all of a cell before rows are exchanged."""
    middle = {c: lo + domain.span / 2 for c, lo in zip("xyz", domain.low, strict=True)}
    nested = bodies.select("mass", *((F.col("mass") * (F.col(c) - m)).alias("m" + c) for c, m in middle.items()), "key", "leaf_depth", F.explode(F.sequence(F.lit(0), "leaf_depth")).alias("depth"))
    prefix = keys.prefix_at(F.col("key"), F.col("depth")).alias("prefix")
    sums = nested.groupBy("depth", prefix).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("mass", "mx", "my", "mz")), F.max(F.col("depth") == F.col("leaf_depth")).alias("is_leaf"))
    return sums.select("depth", "prefix", "n", "mass", *((F.try_divide("m" + c, "mass") + m).alias("c" + c) for c, m in middle.items()), "is_leaf")


CELLS = "prefix long, n long, mass double, cx double, cy double, cz double, is_leaf boolean, depth int"
BODIES = "id long, mass double, x double, y double, z double, vx double, vy double, vz double, key long, leaf_depth int, leaf_prefix long, part int"


def read(spark: SparkSession, out: str) -> DataFrame:
    """The bodies that a run has written."""
    return spark.read.schema(BODIES).parquet(f"{out}/bodies")


if __name__ == "__main__":
    command(__doc__, run, __file__)
