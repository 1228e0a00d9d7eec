"""A map of how much work lies where in a growing folder of documents.

    python -m jobs.workmap SOURCE OUT [--config FILE]

To deal out documents like bodies, each is a point in a space of measures (the
square roots of its words and characters, and characters per word) whose mass is
its size in bytes.  Cells of that space are occupied by documents that cost about
the same to process; ranges of cells in key order with equal mass are equal
shares of the work.

The source is read as a stream of files with a checkpoint, so a run takes only
the files that are new and ends when it has them all.  Each batch of files is
written as one partition of `documents` and, summed by cell, one of `increments`;
both replace what an interrupted try of the same batch has left.  Then the sums of
all batches (cells, not documents) are merged into the map: part (a partition),
cell, documents, bytes and the centre of mass.  A run that finds nothing new
writes the same map again.  Whoever takes on a part reads its cells from the map
and their documents from `documents`.

Below OUT: checkpoint, documents (by batch), increments (by batch) and map (by part).
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, configured, rows_of
from orbitalis.functions import keys
from orbitalis.operators import cells as tree
from orbitalis.operators import partition
from orbitalis.operators.domain import Domain, keyed
from orbitalis.operators.scratch import cut

log = logging.getLogger("jobs.workmap")
_INCREMENT = "depth int, prefix long, n long, mass double, cx double, cy double, cz double, is_leaf boolean, batch long"
DOCUMENTS = "doc_id long, mass double, x double, y double, z double, key long, batch long"
MAP = "cell long, n long, bytes long, cx double, cy double, cz double, part int"


def measures(text: Column) -> tuple[Column, Column, Column, Column]:
    """A text's place in the space of measures and its mass: bytes and one more, so
    that empty and null texts count too."""
    text = F.coalesce(text, F.lit(""))
    words, chars = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("double"), F.length(text).cast("double")
    return F.sqrt(words), F.sqrt(chars), F.when(words > 0, chars / words).otherwise(0.0), (F.octet_length(text) + 1).cast("double")


def placed(docs: DataFrame, config: dict) -> DataFrame:
    """doc_id, bytes, place and key of each document."""
    x, y, z, mass = measures(F.col("text"))
    points = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mass.alias("mass"), x.alias("x"), y.alias("y"), z.alias("z"))
    return keyed(points, Domain((0.0, 0.0, 0.0), config["span"]))


def _pattern(source: str) -> str:
    """The source as a pattern: file streams take single files only by one."""
    above, _, name = source.rstrip("/").rpartition("/")
    return source if set(name) & set("*?[{") else f"{above}/{{{name}}}"


def run(spark: SparkSession, source: str, out: str, config: dict | None = None) -> dict[str, int]:
    """Adds the new files of the source to the map; how many documents, batches and cells there were."""
    config = config or configured(__file__)
    steps, depth = {"read": 0, "batches": 0}, config["depth"]
    documents, increments = f"{out}/documents", f"{out}/increments"
    for path, schema in ((documents, DOCUMENTS), (increments, _INCREMENT)):  # there, even if nothing ever comes
        spark.createDataFrame([], schema).write.mode("append").partitionBy("batch").parquet(path)

    def put(rows: DataFrame, batch: int, path: str) -> None:
        rows = rows.withColumn("batch", F.lit(batch).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    def take(docs: DataFrame, batch: int) -> None:
        put(placed(docs, config), batch, documents)
        mine = spark.read.schema(DOCUMENTS).parquet(documents).where(F.col("batch") == batch)
        put(tree.all_cells(mine, depth, first=depth).withColumn("is_leaf", F.lit(True)), batch, increments)
        steps["read"] += rows_of(mine, log, "read", f"{source}, batch {batch}")
        steps["batches"] += 1

    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", config["files"]).parquet(_pattern(source))
    query = stream.select("doc_id", "text").writeStream.foreachBatch(take).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()

    every = cut(tree.merge_records(spark.read.schema(_INCREMENT).parquet(increments).drop("batch")))
    histogram = every.select(F.col("prefix").alias("bucket"), F.col("mass").cast("long").alias("cnt"))
    cuts = partition.splitters(histogram, config["parts"])
    dealt = partition.assign_parts(every.withColumn("bucket", F.col("prefix")), cuts)
    done = dealt.select(F.col("prefix").alias("cell"), "n", F.col("mass").cast("long").alias("bytes"), "cx", "cy", "cz", "part")
    done.repartition("part").sortWithinPartitions("cell").write.mode("overwrite").partitionBy("part").parquet(f"{out}/map")
    steps["cells"] = rows_of(read_map(spark, out), log, "wrote", f"{out}/map")
    return steps


def read_map(spark: SparkSession, out: str) -> DataFrame:
    """The map as the last run has left it."""
    return spark.read.schema(MAP).parquet(f"{out}/map")


def read(spark: SparkSession, out: str, depth: int) -> DataFrame:
    """All documents taken so far with their part, and what the map says of their cell."""
    docs = spark.read.schema(DOCUMENTS).parquet(f"{out}/documents")
    mine = docs.select("doc_id", F.col("mass").cast("long").alias("doc_bytes"), keys.prefix_at(F.col("key"), depth).alias("cell"))
    return mine.join(read_map(spark, out), "cell")


if __name__ == "__main__":
    command(__doc__, run, __file__)
